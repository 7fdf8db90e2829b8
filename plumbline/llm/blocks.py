"""Whole documents dealt into blocks, and counts that blocks ask of the whole corpus.

Work on texts needs facts about the corpus (how often a word occurs, whether a passage occurs
elsewhere). A join of every word of every document would shuffle the corpus several times over.
Instead documents are dealt into blocks of a few MB; a block sends each distinct key once, with its
local count, packed by key range; the task of a key range adds the counts up and answers every block
with the totals in the order of its keys. A frequent key thus costs one entry a block, never one an
occurrence, and key ranges are even because keys are mixed hashes: no key can make a task large.
Nothing is broadcast or collected. Plans stay lazy: Spark deals the documents once and reuses that
exchange for later steps, and lost tasks are recomputed from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ship import ship

BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 64
REQUEST = "block int, part int, keys binary, counts binary"
ANSWER = "block int, part int, counts binary"
_REQUEST = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def number_of_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """A power of two: enough blocks of about ``block_bytes`` of text, from one pass over the texts' lengths."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = LEAST_BLOCKS
    while blocks * block_bytes < total:
        blocks *= 2
    return blocks


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, text): rows dealt by a hash of the id; rows without an id by their text."""
    key = F.coalesce(F.xxhash64(F.lit(1), "doc_id"), F.xxhash64(F.lit(2), "text"))
    return docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def by_key_range(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys, one for each of ``parts`` (a power of two) equal key ranges that has any."""
    bits = parts.bit_length() - 1
    at = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(at, np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)):
        yield int(part), slice(edges[part], edges[part + 1])


def request(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """Rows that ask for the corpus totals of ``keys`` (sorted, distinct), giving the block's own counts."""
    rows = [
        (block, part, keys[at].tobytes(), counts[at].astype(np.uint32).tobytes()) for part, at in by_key_range(keys, parts)
    ]
    return arrow_rows(rows, _REQUEST)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def short_request(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """As ``request``, with 32 bits a key beside its range: totals may be too high by chance, never too low."""
    shift = np.uint64(parts.bit_length() - 1)
    rows = [
        (block, part, ((keys[at] << shift) >> np.uint64(32)).astype(np.uint32).tobytes(), np.minimum(counts[at], 255).astype(np.uint8).tobytes())
        for part, at in by_key_range(keys, parts)
    ]
    return arrow_rows(rows, _REQUEST)


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry, the sum of the counts of all entries with its key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new)) if len(keys) else counts.astype(np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = sums[np.cumsum(new) - 1] if len(keys) else 0
    return out


def answered(requests: DataFrame, most: int = 2**32 - 1, short: bool = False) -> DataFrame:
    """Answers to ``request`` (or ``short_request``) rows: totals, as bytes if at ``most`` 255, else as 32 bits."""
    kind = np.uint8 if most < 256 else np.uint32
    of_key, of_count = (np.uint32, np.uint8) if short else (np.uint64, np.uint32)

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, of_key) for x in table["keys"].to_pylist()]
        counts = [np.frombuffer(x, of_count) for x in table["counts"].to_pylist()]
        found = np.minimum(totals(np.concatenate(keys), np.concatenate(counts)), most).astype(kind)
        edges = np.cumsum([0, *map(len, keys)])
        out = [found[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.Table.from_arrays([table["block"], table["part"], pa.array(out, pa.binary())], schema=_ANSWER)

    return requests.groupBy("part").applyInArrow(add_up, ANSWER)


def answer_of(table: pa.Table, kind: type) -> np.ndarray:
    """The totals for a block's keys, in the order of its sorted keys."""
    rows = sorted(zip(table["part"].to_pylist(), table["counts"].to_pylist()))
    return np.frombuffer(b"".join(x for _, x in rows), kind)


def per_block(docs: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("block").applyInArrow(work, schema)


def with_answers(
    docs: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)

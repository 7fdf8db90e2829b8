"""A Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels from keyed slot arrays.

Rows become leaves; the leaves of a group (``lang``) ascend by ``doc_id``. No sort finds a leaf's place.
Every task packs the ids that it reads into containers of 65,536 ids (sorted 16-bit offsets, or bits where
that is shorter; repeated ids with their counts); containers of one group and range are merged, a
running total over them is the directory of counts, and the rank of an id is the directory's entry plus
the container's popcount below it.

A rank is a coordinate: slot ``rank % 4096`` of chunk ``rank // 4096``. A task fills a chunk's slots and
reduces four levels of eight at once; the chunks' roots are the slots of the next round, so three rounds
reach 69 billion leaves. The way back hands every chunk the siblings above it, from the root down, and each
chunk writes its own rows' proofs. Subroots of the groups are reduced by the same rounds.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.ship import ship
from plumbline.llm.store import stored
from plumbline.operators.ordered import numbered, running_total

FANOUT = 8
ROUND = 4  # levels that a chunk reduces at once: chunks of 4,096 slots
SHARD_IDS = 200_000  # about so many ids are ranked by one task's group of containers
FLUSH_IDS = 1_000_000  # a task packs about so many ids before it sends their containers
NO_ID = -(1 << 47) - 1  # the container number of null ids: before all others
_TOP = "+"  # the group of the subroots; groups of rows begin with = or -
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sealed(*values: Column) -> Column:
    """Lower-case hex SHA-256 over values, each with its byte count before it, ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, other): each row's digest, and where a third of the ids is tampered with, the changed row's."""

    def leaf(text: Column) -> Column:
        return F.unhex(sealed(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        group_of("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"),
        F.when(tampered, leaf(F.translate("text", UPPER, LOWER))).alias("other"),
    )


def group_of(lang: str) -> Column:
    """A key that is never null and sorts as the language does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-")).alias("grp")


def _container_of(doc_id: str) -> Column:
    return F.coalesce(F.shiftright(F.col(doc_id), 16), F.lit(NO_ID))


class Container:
    """Ids of one group and range of 65,536: 16-bit offsets or bits, and counts of repeated ids."""

    def __init__(self, lows: np.ndarray, counts: np.ndarray):
        self.lows, self.counts = lows, counts

    @classmethod
    def of(cls, lows: np.ndarray, counts: np.ndarray | None = None) -> Container:
        lows, at = np.unique(lows.astype(np.uint16), return_inverse=True)
        return cls(lows, np.bincount(at, counts).astype(np.int64) if counts is not None else np.bincount(at).astype(np.int64))

    @classmethod
    def read(cls, bits: bytes, repeats: bytes) -> Container:
        if len(bits) == 8192:
            lows = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.uint16)
        else:
            lows = np.frombuffer(bits, "<u2")
        counts = np.ones(len(lows), np.int64)
        more = np.frombuffer(repeats, [("low", "<u2"), ("count", "<i8")])
        counts[np.searchsorted(lows, more["low"])] = more["count"]
        return cls(lows, counts)

    @classmethod
    def merged(cls, several: list[Container]) -> Container:
        if len(several) == 1:
            return several[0]
        return cls.of(np.concatenate([c.lows for c in several]), np.concatenate([c.counts for c in several]))

    def packed(self) -> tuple[bytes, bytes]:
        """Offsets, or 8,192 bytes of bits if that is no longer; and (offset, count) of repeated ids."""
        bits = self.lows.astype("<u2").tobytes()
        if len(bits) >= 8192:
            flags = np.zeros(1 << 16, np.uint8)
            flags[self.lows] = 1
            bits = np.packbits(flags, bitorder="little").tobytes()
        more = np.flatnonzero(self.counts > 1)
        repeats = np.zeros(len(more), [("low", "<u2"), ("count", "<i8")])
        repeats["low"], repeats["count"] = self.lows[more], self.counts[more]
        return bits, repeats.tobytes()

    def ranks(self, lows: np.ndarray) -> np.ndarray:
        """How many rows of the container have a smaller id: a popcount directory of the offsets, read by offset."""
        below = np.cumsum(self.counts) - self.counts
        return below[np.searchsorted(self.lows, lows)]


_PACKED = pa.schema([("shard", pa.int32()), ("grp", pa.string()), ("container", pa.int64()), ("bits", pa.binary()), ("repeats", pa.binary()), ("size", pa.int64())])
PACKED = "shard int, grp string, container long, bits binary, repeats binary, size long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def _runs(*keys: np.ndarray) -> Iterator[slice]:
    """Slices of rows that are equal in all of the sorted keys."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edges = np.flatnonzero(new)
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield slice(lo, hi)


def containers(rows: DataFrame, shards: int) -> DataFrame:
    """Merged containers of ``rows`` (grp, doc_id), by shard, group and range of ids, with ``size`` rows each."""
    keyed = rows.select(
        F.pmod(F.xxhash64("grp", _container_of("doc_id")), F.lit(shards)).cast("int").alias("shard"),
        "grp", _container_of("doc_id").alias("container"), F.coalesce(F.col("doc_id").bitwiseAND(65535), F.lit(0)).cast("int").alias("low"),
    )

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= FLUSH_IDS:
                yield from some(held)
                held, n = [], 0
        if n:
            yield from some(held)

    def some(batches):
        table = pa.Table.from_batches(batches)
        names = table["grp"].combine_chunks().dictionary_encode()
        grp, shard, box, low = names.indices.to_numpy(), *(table[c].to_numpy() for c in ("shard", "container", "low"))
        order = np.lexsort((box, grp))
        grp, shard, box, low = grp[order], shard[order], box[order], low[order]
        out = []
        for at in _runs(grp, box):
            out.append((int(shard[at.start]), names.dictionary[int(grp[at.start])].as_py(), int(box[at.start]), *Container.of(low[at]).packed(), at.stop - at.start))
        yield from _table(out, _PACKED).to_batches(max_chunksize=1_000)

    def merge(table: pa.Table) -> pa.Table:
        found = defaultdict(list)
        for grp, box, bits, repeats in zip(*(table[c].to_pylist() for c in ("grp", "container", "bits", "repeats"))):
            found[grp, box].append((bits, repeats))
        shard, out = table["shard"][0].as_py(), []
        for (grp, box), parts in found.items():
            whole = Container.merged([Container.read(*p) for p in parts])
            out.append((shard, grp, box, *whole.packed(), int(whole.counts.sum())))
        return _table(out, _PACKED)

    return keyed.mapInArrow(pack, PACKED).groupBy("shard").applyInArrow(merge, PACKED)


def ranked_ids(ids: DataFrame, merged: DataFrame, shards: int) -> DataFrame:
    """(grp, doc_id, rank): how many rows of the group come before each of the distinct ``ids`` (grp, doc_id)."""
    directory = running_total(merged.select("shard", "grp", "container", "size"), ["grp"], [F.col("container")], "size", "upto")
    placed = merged.join(directory.select("shard", "grp", "container", (F.col("upto") - F.col("size")).alias("before")), ["shard", "grp", "container"])
    asked = ids.select(
        F.pmod(F.xxhash64("grp", _container_of("doc_id")), F.lit(shards)).cast("int").alias("shard"), "grp", "doc_id",
        _container_of("doc_id").alias("container"), F.coalesce(F.col("doc_id").bitwiseAND(65535), F.lit(0)).cast("int").alias("low"),
    )
    schema = pa.schema([("grp", pa.string()), ("doc_id", pa.int64()), ("rank", pa.int64())])

    def answer(table: pa.Table, boxes: pa.Table) -> pa.Table:
        found = {(g, c): (bits, repeats, before) for g, c, bits, repeats, before in zip(*(boxes[k].to_pylist() for k in ("grp", "container", "bits", "repeats", "before")))}
        names = table["grp"].combine_chunks().dictionary_encode()
        grp, box, low = names.indices.to_numpy(), table["container"].to_numpy(), table["low"].to_numpy()
        order, rank = np.lexsort((box, grp)), np.zeros(len(box), np.int64)
        for at in _runs(grp[order], box[order]):
            some = order[at]
            bits, repeats, before = found[names.dictionary[int(grp[some[0]])].as_py(), int(box[some[0]])]
            rank[some] = before + Container.read(bits, repeats).ranks(low[some].astype(np.uint16))
        return pa.Table.from_arrays([table["grp"].combine_chunks(), table["doc_id"].combine_chunks(), pa.array(rank)], schema=schema)

    boxes = placed.select("shard", "grp", "container", "bits", "repeats", "before")
    return asked.groupBy("shard").cogroup(boxes.groupBy("shard")).applyInArrow(answer, "grp string, doc_id long, rank long")


def coordinates(rows: DataFrame, docs: DataFrame, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, DataFrame]:
    """(stored rows with ``rank``, (grp, n)): the place of each leaf in its group, and the groups' sizes.

    Equal rows are counted once and spread out again afterwards. Rows that share group and id but not their
    content follow each other by leaf; they are counted by the first two bytes of the leaf, so that an id of any number
    of rows is placed in small windows. Such rows are few in sound data, so their tables stay small.
    """
    n = docs.count()
    shards = max(1, -(-n // shard_ids))
    merged = stored(containers(docs.select(group_of("lang"), F.col("doc_id").cast("long").alias("doc_id")), shards), "manifest-ids")
    once = stored(rows.groupBy("grp", "doc_id", "leaf", "other").agg(F.count("*").alias("copies")), "manifest-rows")
    ids = once.groupBy("grp", "doc_id").agg(F.count("*").alias("kinds"))
    shared = ids.where("kinds > 1").select("grp", "doc_id", F.lit(True).alias("tied"))
    once = once.withColumn("id_", F.struct("doc_id"))  # a struct is never null, so null ids join as others do
    head = F.substring("leaf", 1, 2).alias("head")
    tied = once.join(shared.select("grp", F.struct("doc_id").alias("id_"), "tied"), ["grp", "id_"]).withColumn("head", head)
    heads = tied.groupBy("grp", "id_", "head").agg(F.sum("copies").alias("in_head"))
    heads = heads.withColumn("before", F.sum("in_head").over(Window.partitionBy("grp", "id_").orderBy("head")) - F.col("in_head"))
    inner = F.sum("copies").over(Window.partitionBy("grp", "id_", "head").orderBy("leaf")) - F.col("copies")
    tied = tied.withColumn("inner", inner).join(heads, ["grp", "id_", "head"]).select("grp", "id_", "leaf", (F.col("before") + F.col("inner")).alias("offset"))
    places = ranked_ids(ids.select("grp", "doc_id"), merged, shards).select("grp", F.struct("doc_id").alias("id_"), "rank")
    found = once.join(places, ["grp", "id_"]).join(tied, ["grp", "id_", "leaf"], "left")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    found = found.select("grp", "doc_id", "leaf", "other", (F.col("rank") + F.coalesce("offset", F.lit(0))).alias("at"), copy)
    found = found.select("grp", "doc_id", "leaf", "other", (F.col("at") + F.col("copy")).alias("rank"))
    sizes = merged.groupBy("grp").agg(F.sum("size").alias("n"))
    return stored(found, "manifest-leaves"), sizes


def H(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def levels_of(n: int) -> int:
    """How often n nodes must be reduced until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def reduced(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of a chunk level by level; every run of eight, the last maybe shorter, becomes its digest."""
    out = [slots]
    for _ in range(levels):
        below = out[-1]
        out.append([H(b"".join(x.hex().encode() for x in below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def slots_of(table: pa.Table, deep: int) -> tuple[np.ndarray, list[bytes]]:
    """The slots of a chunk's rows, and its digests, each in its slot."""
    slot = table["rank"].to_numpy() % FANOUT**deep
    filled: list[bytes] = [b""] * len(slot)
    for i, digest in zip(slot.tolist(), table["leaf"].to_pylist()):
        filled[i] = digest
    return slot, filled


def siblings_of(nodes: list[list[bytes]], at: int) -> list[tuple[int, list[bytes]]]:
    """(place in the run, the run's other nodes) of a slot, level by level."""
    out = []
    for level in nodes[:-1]:
        run = level[at - at % FANOUT : at - at % FANOUT + FANOUT]
        place = at % FANOUT
        out.append((place, run[:place] + run[place + 1 :]))
        at //= FANOUT
    return out


def folded(digest: bytes, way: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a digest and its siblings give."""
    for place, others in way:
        run = others[:place] + [digest] + others[place:]
        digest = H(b"".join(x.hex().encode() for x in run))
    return digest


def _write(way: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in way)


def _read(data: bytes) -> list[tuple[int, list[bytes]]]:
    out, i = [], 0
    while i < len(data):
        place, n = data[i], data[i + 1]
        out.append((place, [data[j : j + 32] for j in range(i + 2, i + 2 + 32 * n, 32)]))
        i += 2 + 32 * n
    return out


NODES = "grp string, rank long, leaf binary"
_NODES = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("leaf", pa.binary())])
WAYS = "grp string, chunk long, way binary, root binary"
_WAYS = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("way", pa.binary()), ("root", pa.binary())])


def _levels_here(n: int, past: int, deep: int) -> int:
    return max(0, min(deep, levels_of(n) - past * deep))


def chunks(nodes: DataFrame, sizes: DataFrame, deep: int) -> DataFrame:
    """``nodes`` with their chunk and their group's size. Sizes are one row a group, left to Spark's own choice of join."""
    return nodes.withColumn("chunk", F.shiftright("rank", 3 * deep)).join(sizes, "grp")


def up(nodes: DataFrame, sizes: DataFrame, past: int, deep: int) -> DataFrame:
    """The roots of all chunks after ``past`` rounds: the nodes of the next one."""

    def reduce(table: pa.Table) -> pa.Table:
        _, slots = slots_of(table, deep)
        top = reduced(slots, _levels_here(table["n"][0].as_py(), past, deep))[-1]
        return _table([(table["grp"][0].as_py(), table["chunk"][0].as_py(), top[0])], _NODES)

    some = chunks(nodes, sizes, deep).select("grp", "chunk", "n", "rank", "leaf")
    return stored(some.groupBy("grp", "chunk").applyInArrow(reduce, NODES), "manifest-nodes")


def down(nodes: DataFrame, sizes: DataFrame, past: int, deep: int, ways: DataFrame) -> DataFrame:
    """For each node, the way (siblings) from it to the root: its chunk's own levels, then the chunk's way."""

    def hand_on(table: pa.Table, way: pa.Table) -> pa.Table:
        slot, slots = slots_of(table, deep)
        tree = reduced(slots, _levels_here(table["n"][0].as_py(), past, deep))
        rest, root = way["way"][0].as_py(), way["root"][0].as_py()
        rows = [(g, r, _write(siblings_of(tree, s)) + rest, root) for g, r, s in zip(table["grp"].to_pylist(), table["rank"].to_pylist(), slot.tolist())]
        return _table(rows, _WAYS)

    some = chunks(nodes, sizes, deep).select("grp", "chunk", "n", "rank", "leaf")
    return some.groupBy("grp", "chunk").cogroup(ways.groupBy("grp", "chunk")).applyInArrow(hand_on, WAYS)


def rounds_of(sizes: DataFrame, deep: int) -> int:
    """How many rounds bring the largest group to one node; one at least."""
    most = sizes.agg(F.max("n")).first()[0] or 1
    return max(1, -(-levels_of(most) // deep))


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def manifest(docs: DataFrame, deep: int = ROUND, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row for each of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, roots, proof, and the proof's test.

    ``subroot`` is the root of the row's language, ``root`` that of all. ``proof_sha256`` is the digest of
    all siblings from leaf to root. ``folded_root`` is recomputed from the siblings and the leaf of the row, with
    A-Z of its text lower-cased where 3 divides the CRC-32 of the id; ``verified`` says if it is the root. Nulls
    are leaves' parts of their own kind: a null id comes first in its group, a null language is a group before
    all others. Rows of one group and id are ordered by leaf; equal rows each have a place of their own. Empty texts
    and texts of any length are values like others; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows, sizes = coordinates(leaves(docs), docs, shard_ids)
    sizes = stored(sizes, "manifest-sizes")
    levels = [rows.select("grp", "rank", "leaf")]
    for i in range(rounds_of(sizes, deep)):
        levels.append(up(levels[-1], sizes, i, deep))
    roots = numbered(levels[-1].select(F.col("grp").alias("of"), "leaf"), [F.col("of")], "place")
    tops = [stored(roots.select(F.lit(_TOP).alias("grp"), (F.col("place") - 1).alias("rank"), "leaf", "of"), "manifest-subroots")]
    all_of = tops[0].groupBy("grp").agg(F.count("*").alias("n"))
    for i in range(rounds_of(all_of, deep)):
        tops.append(up(tops[-1].select("grp", "rank", "leaf"), all_of, i, deep))
    ways = tops[-1].select("grp", F.col("rank").alias("chunk"), F.lit(b"").alias("way"), F.col("leaf").alias("root"))
    for i in reversed(range(len(tops) - 1)):
        ways = down(tops[i].select("grp", "rank", "leaf"), all_of, i, deep, ways)
    ways = ways.withColumnRenamed("chunk", "rank").drop("grp").join(tops[0].select("rank", "of"), "rank")
    ways = stored(ways.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("chunk"), "way", "root"), "manifest-ways")
    for i in reversed(range(1, len(levels) - 1)):
        ways = stored(down(levels[i], sizes, i, deep, ways), "manifest-ways")
    subroots = levels[-1].select("grp", F.col("leaf").alias("subroot"))
    ways = ways.join(subroots, "grp").select("grp", "chunk", "way", "root", "subroot")

    def prove(table: pa.Table, way: pa.Table) -> pa.Table:
        slot, slots = slots_of(table, deep)
        tree = reduced(slots, _levels_here(table["n"][0].as_py(), 0, deep))
        above, root, subroot = _read(way["way"][0].as_py()), way["root"][0].as_py(), way["subroot"][0].as_py()
        high = b"".join(x.hex().encode() for _, others in above for x in others)
        out = []
        for doc_id, at, leaf, other in zip(table["doc_id"].to_pylist(), slot.tolist(), table["leaf"].to_pylist(), table["other"].to_pylist()):
            own = siblings_of(tree, at)
            proof = H(b"".join(x.hex().encode() for _, others in own for x in others) + high)
            found = folded(other or leaf, own + above)
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof.hex(), found.hex(), found == root))
        return _table(out, _OUT)

    some = chunks(rows, sizes, deep).select("grp", "chunk", "n", "rank", "doc_id", "leaf", "other")
    return some.groupBy("grp", "chunk").cogroup(ways.groupBy("grp", "chunk")).applyInArrow(prove, OUT)

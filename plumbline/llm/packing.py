"""Best-fit packing of token sequences by patterns and non-negative least squares.

Lengths matter, not documents: the histogram of piece lengths has at most ``size`` entries, whatever
the corpus. Patterns of one to three lengths that fill a sequence are enumerated on a coarse grid of
lengths, repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
what is left is packed length by length, longest first, each into the open pattern it fits best. The
recipe (patterns with repeat counts) is a bounded table. Spark then numbers the pieces of each length
and reads each piece's sequence and offset from the recipe's ranges.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.ship import ship
from plumbline.llm.store import stored

SIZE = 2048
END_ID = 0
GRID = 64  # lengths are rounded up to size / GRID while patterns are fitted
SHARE_ROWS = 200_000  # the pieces of one length are numbered in shares of about so many
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# How byte-level tokenizers of this kind cut a text before merging.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of whole texts by a byte-level ``tokenizers`` file.

    The file's vocabulary also drives a faster encoder, for texts of characters below U+0250 that hold
    no special token. It is used only for a plain file (``_plain``) whose merges are in the order of the
    ids; other files and texts go to the tokenizer itself. Both give the same ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(Path(path).read_text())
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        in_order = [vocabulary[p] for p in pairs] == list(range(256, 256 + len(pairs)))
        self.fast = None
        if in_order and _plain(spec):
            ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
            self.fast = tiktoken.Encoding("bytes", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        self.slow_text = re.compile("[^\x00-\u024f]|" + "|".join(map(re.escape, self.special or ["[^\x00-\u024f]"])))

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit values."""
        if not text:
            return b""
        if self.fast is None or self.slow_text.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _plain(spec: dict) -> bool:
    """Whether a file does nothing but cut texts by ``CUT`` and merge bytes."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")]
    bytes_only = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    return model.get("type") == "BPE" and not any(odd) and spec.get("normalizer") is None and bytes_only


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text): its ids and an end id, cut only if longer than ``size``.

    All pieces of a cut document have ``size`` tokens but the first, which may be shorter. Null and
    empty texts are the end id alone; repeated rows are packed each; other columns are ignored.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                some = batch.slice(lo, 64)
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encoder.ids(text or "") + END_ID.to_bytes(4, "little")
                    edges = [0, *range(len(ids) // 4 % size or min(size, len(ids) // 4), len(ids) // 4 + 1, size)]
                    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        rows.append((doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def fitted(patterns: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative x that makes |target - patterns x| small: projected gradient with momentum."""
    x = np.zeros(patterns.shape[1])
    ahead, speed = x.copy(), 1.0
    step = 1 / np.linalg.norm(patterns.T @ patterns, 2) if len(x) < 400 else 1 / (np.linalg.norm(patterns, 2) ** 2)
    for _ in range(rounds):
        moved = np.maximum(0, ahead - step * (patterns.T @ (patterns @ ahead - target)))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = moved + (speed - 1) / faster * (moved - x)
        x, speed = moved, faster
    return x


def recipe(histogram: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) that use every piece of the histogram exactly once."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v})
    out: Counter[tuple[int, ...]] = Counter()
    out[(size,)] += left.pop(size, 0)
    width = -(-size // grid)
    every = sorted(left)
    cells: dict[int, list[int]] = {}
    for length in sorted(left):
        cells.setdefault(-(-length // width), []).append(length)
    kinds = [(a, b, c) for a in range(grid + 1) for b in range(a, grid + 1) for c in range(b, grid + 1) if a + b + c == grid and {a, b, c} - {0} <= cells.keys()]
    if kinds:
        matrix = np.zeros((grid + 1, len(kinds)))
        for j, kind in enumerate(kinds):
            for cell in kind:
                matrix[cell, j] += cell > 0
        target = np.array([sum(left[x] for x in cells.get(cell, ())) for cell in range(grid + 1)], float)
        repeats = np.floor(fitted(matrix, target) + 1e-6).astype(int)
        for j in np.argsort(-repeats):
            want = int(repeats[j])
            while want > 0:
                # The longest lengths of the cells that still have pieces; the last one fills the room best.
                taken: Counter[int] = Counter()
                lengths, room = [], size
                chosen = [c for c in sorted(kinds[j], reverse=True) if c]
                for i, cell in enumerate(chosen):
                    among = cells[cell] if i < len(chosen) - 1 else every[: bisect_right(every, room)]
                    found = next((x for x in reversed(among) if left[x] > taken[x]), None)
                    if found is None:
                        break
                    taken[found] += 1
                    lengths.append(found)
                    room -= found
                else:
                    times = min(want, *(left[x] // n for x, n in taken.items()))
                    for x, n in taken.items():
                        left[x] -= n * times
                    out[tuple(sorted(lengths, reverse=True))] += times
                    want -= times
                    continue
                break
    out.update(_best_fit(left, size))
    return sorted((lengths, n) for lengths, n in out.items() if n)


def _best_fit(left: Counter[int], size: int) -> Counter[tuple[int, ...]]:
    """Packs lengths, longest first, each into the open pattern with the least room it fits in; many at a time."""
    open_ones: dict[int, Counter[tuple[int, ...]]] = {}
    rooms = np.zeros(size + 1, bool)
    for length in sorted((x for x in left if left[x]), reverse=True):
        todo = left[length]
        while todo:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                kind, n = next(iter(open_ones[room].items()))
                each = min(room // length, -(-todo // n))  # how many go into one sequence
                times = min(n, todo // each)
                _move(open_ones, rooms, room, kind, times, -1)
                _move(open_ones, rooms, room - each * length, kind + (length,) * each, times, 1)
                todo -= times * each
            else:
                each = min(size // length, todo)
                times = todo // each
                _move(open_ones, rooms, size - each * length, (length,) * each, times, 1)
                todo -= times * each
    out: Counter[tuple[int, ...]] = Counter()
    for kinds in open_ones.values():
        out.update(kinds)
    return out


def _move(open_ones, rooms, room: int, kind: tuple[int, ...], times: int, sign: int) -> None:
    kinds = open_ones.setdefault(room, Counter())
    kinds[kind] += sign * times
    if not kinds[kind]:
        del kinds[kind]
    rooms[room] = bool(kinds)


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """``pieces`` of ``docs`` with the sequence each is packed into and its offset there, gapless from 0."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, size), "pieces")
    shares = max(64, -(-cut.count() // SHARE_ROWS))
    shared = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)).cast("int"))
    by_share = shared.groupBy("length", "share").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in by_share.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    plan = recipe(histogram, size)
    slots, used, sequence = [], Counter(), 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    ranges = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_share.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = shared.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "share"])
    numbered = numbered.withColumn("rank", F.col("place") + F.col("before"))
    # The slot of a rank: slots of a length in an array, found by the last one that begins at or before it.
    by_length = ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "sequence", "offset"))).alias("slots"))
    placed = numbered.join(F.broadcast(by_length), "length")  # bounded by the recipe
    slot = F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("rank")), -1)
    return placed.withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.col("rank") - F.col("slot.lo")).alias("sequence_id"), F.col("slot.offset").alias("offset"),
    )

"""Repeated passages across documents: seed and extend.

Seeds are winnowed: of the 28 runs of 8 words in a window of 35 words the one with the smallest hash
is its anchor, so equal windows have equal anchors at equal places. Anchors that occur once in the
corpus are dropped; the others are extended to both sides, to every window of 35 words they anchor,
and windows whose whole word sequence starts at two places or more are repeats. Overlapping windows
of a document merge into maximal repeats.

Both "does it occur elsewhere" questions are asked by block (see ``blocks``): a passage that
thousands of documents share costs one entry a block, no pairs of documents are made, and no
frequency is too high. Equality of windows is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm.once import unused
from plumbline.llm.words import Words, ngram_hashes, words_of

WINDOW = 35
SEED = 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:long,words:long>>, kept string"
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
        ("repeats", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), ("kept", pa.string()),
    ]
)


def minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``width`` values its smallest, and where the first of these is."""
    at, low, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[: len(low) - step]
        low, at = np.where(right, low[step:], low[: len(low) - step]), np.where(right, at[step:], at[: len(at) - step])
        have += step
    return low, at


def _windows(texts: pa.ChunkedArray, window: int, seed: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the starts of windows within one text; each window's anchor hash and place; its own hash."""
    words = words_of(texts, lower=False)
    n = len(words.hash)
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(words.first[1:], words.counts))
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return words, starts, none, starts, none
    low, at = minima(ngram_hashes(words.hash, seed), window - seed + 1)
    return words, starts, low[starts], at[starts], ngram_hashes(words.hash, window)[starts]


def _anchors(anchor: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a block and at how many places each stands."""
    return np.unique(anchor[np.unique(place, return_index=True)[1]], return_counts=True)


def _repeated(keys: np.ndarray, answer: np.ndarray, values: np.ndarray) -> np.ndarray:
    return answer[np.searchsorted(keys, values)] >= 2 if len(keys) else np.zeros(len(values), bool)


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, removed words, the repeats and what is left.

    A repeat is (first word, words), maximal: it covers every word of overlapping or adjoining windows.
    ``kept`` joins the other words by one space (null without ``with_text``). Null and empty texts
    have no words; texts shorter than the window keep all; repeated rows repeat each other; other
    columns of ``docs`` are ignored.
    """
    parts = B.number_of_blocks(docs)
    dealt = B.dealt(docs, parts)

    def ask_anchors(table: pa.Table) -> pa.Table:
        _, _, anchor, place, _ = _windows(table["text"], window, seed)
        return B.request(table["block"][0].as_py(), *_anchors(anchor, place), parts)

    def known(table: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
        mine = table.filter(pa.compute.equal(table["kind"], kind))
        return B.answer_of(mine, np.uint8) if len(keys) else np.zeros(0, np.uint8)

    def extended(table: pa.Table, answers: pa.Table):
        words, starts, anchor, place, whole = _windows(table["text"], window, seed)
        keys, _ = _anchors(anchor, place)
        worth = _repeated(keys, known(answers, 0, keys), anchor)
        starts, whole = starts[worth], whole[worth]
        return words, starts, whole, *np.unique(whole, return_counts=True)

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        *_, keys, counts = extended(table, answers)
        return B.request(table["block"][0].as_py(), keys, np.minimum(counts, 2), parts)

    def cover(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, starts, whole, keys, _ = extended(table, answers)
        starts = starts[_repeated(keys, known(answers, 1, keys), whole)]
        edge = np.bincount(starts, minlength=len(words.hash) + 1) - np.bincount(
            starts + window, minlength=len(words.hash) + 1
        )[: len(words.hash) + 1]
        covered = np.cumsum(edge)[: len(words.hash)] > 0
        rows = []
        for i, doc_id in enumerate(table["doc_id"].to_pylist()):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            out = covered[lo:hi]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(turns[::2], turns[1::2])]
            # Gaps between the repeats, as byte ranges; their words are joined by one space.
            keep = zip([lo, *(lo + turns[1::2])], [*(lo + turns[::2]), hi])
            gaps = (words.buf[words.start[a] : words.end[b - 1]].tobytes().split() for a, b in keep if b > a)
            kept = b" ".join(b" ".join(x) for x in gaps)
            rows.append((doc_id, hi - lo, int(out.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
        return B.arrow_rows(rows, _RESULT)

    def kind(answers: DataFrame, k: int) -> DataFrame:
        return answers.withColumn("kind", F.lit(k))

    anchors = kind(B.answered(B.per_block(dealt, ask_anchors, B.REQUEST), 2), 0)
    windows = kind(B.answered(B.with_answers(dealt, anchors, ask_windows, B.REQUEST), 2), 1)
    return B.with_answers(dealt, anchors.unionByName(windows), cover, RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a document of which nothing is left goes.

    Documents without a repeat stay as they are, byte by byte. All columns are kept; ``n_chars``, if
    there, follows the text. Ids must be distinct.
    """
    kept = unused(docs, "kept")
    found = repeated_passages(docs).where("n_removed > 0").select("doc_id", F.col("kept").alias(kept))
    joined = docs.join(found, "doc_id", "left").where(F.coalesce(F.col(kept) != "", F.lit(True)))
    out = joined.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

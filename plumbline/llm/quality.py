"""Quality of documents by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (A-Z lower-cased, hashed), and beside them its form: hashed runs of three
character classes (lower-case letters, capitals and digits are one class each, other ASCII characters
stand for themselves), and shares of repeated words and capitals. Terms are weighted by log frequency
and by inverse document frequency over all documents, and a truncated singular value decomposition of a
bounded, documented sample of labelled rows turns them into short vectors. The labelled vectors are broadcast (their number and length are parameters);
every document's cosine to every one of them is computed exactly, in blocks, and its nearest
neighbours vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.sampling import hashed_share
from plumbline.llm.ship import ship
from plumbline.llm.words import text_bytes, words_of

SAMPLE = 4000  # labelled rows to learn from, those with the smallest hash of their id
LATENT = 64
NEIGHBOURS = 11
SHARPNESS = 8  # power of the similarity that a vote weighs
ACCEPTED = 0.3
RUNS = 2048
STEPS = 20
FORM = RUNS + 3 * STEPS
WORDS = 8192
TERMS = FORM + WORDS
BLOCK = 256

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128


def terms(texts: pa.Array) -> np.ndarray:
    """Term weights of each text; null and empty texts have none."""
    buf, edges = text_bytes(texts)
    words = words_of(texts, lower=True)
    slots = (words.hash % np.uint64(WORDS)).astype(np.int64)
    out = np.zeros((len(texts), TERMS), np.float32)

    def stepped(row: int, group: int, share: float) -> None:
        out[row, RUNS + group * STEPS + min(int(share * STEPS), STEPS - 1)] = 1

    for i in range(len(texts)):
        raw = buf[edges[i] : edges[i + 1]]
        own = words.hash[words.first[i] : words.first[i + 1]]
        if len(raw) >= 3:
            c = _CLASS[raw]
            run = c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(320738761) ^ c[2:] * np.uint32(2246822519)
            seen = np.bincount((run * np.uint32(2654435761)) >> np.uint32(21), minlength=RUNS)
            out[i, :RUNS] = np.log1p(seen) / np.log1p(len(raw))
        if len(own):
            stepped(i, 0, len(np.unique(own)) / len(own))
            stepped(i, 1, float(np.mean(own[1:] == own[:-1])) if len(own) > 1 else 0.0)
            stepped(i, 2, float(np.mean(_CLASS[raw] == 65)))
            seen = np.bincount(slots[words.first[i] : words.first[i + 1]], minlength=WORDS)
            out[i, FORM:] = np.log1p(seen) / np.log1p(len(own))
    return out


def _packed(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row).astype(np.uint16)
    return at.tobytes() + row[at].astype(np.float16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    row, n = np.zeros(TERMS, np.float32), len(data) // 4
    row[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float16, n, 2 * n)
    return row


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of each term, over all rows of ``docs``; a task sends one row a term."""

    def count(batches):
        n, held = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                held += np.count_nonzero(terms(batch.column("text").slice(lo, BLOCK)), axis=0)
            n += len(batch)
        yield pa.RecordBatch.from_pydict({"term": np.arange(TERMS + 1), "n": np.append(held, n)})

    sums = np.zeros(TERMS + 1)
    for row in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        sums[row.term] = row.n
    return (np.log((1 + sums[-1]) / (1 + sums[:-1])) + 1).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Voters:
    """Labelled vectors, the way into their space, and the share of accepted rows among them."""

    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        latent = unit(unit(rows * self.scale) @ self.axes)
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        voted = total > 1e-12
        out[voted] = (weight * self.labels[best]).sum(1)[voted] / total[voted]
        return np.clip(out, 0.0, 1.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, latent: int = LATENT) -> Voters:
    """Voters from at most ``sample`` labelled rows that are not held out.

    Rows of ``labels`` (doc_id, quality) without an id or a quality take no part; of several for one
    id the highest counts, and of several texts of one id the one whose hash is least. Without labelled
    rows every score is 0.5.
    """
    ship(docs.sparkSession)
    eligible = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    )
    chosen = hashed_share(eligible, "doc_id", sample).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    of_sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def compute(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                some = batch.slice(lo, BLOCK)
                rows = [_packed(x) for x in terms(some.column("text"))]
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "quality": some.column("quality"), "row": pa.array(rows, pa.binary())})

    one_each = of_sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sorted(one_each.mapInArrow(compute, "doc_id long, quality int, row binary").collect(), key=lambda r: r.doc_id)
    if not found:
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, latent), np.float32), np.zeros((0, latent), np.float32), np.zeros(0), 0.5)
    scale = inverse_frequencies(docs)

    def weighted():
        """The sample's weighted unit rows, a block at a time: stored sparse, a few hundred terms each."""
        for lo in range(0, len(found), BLOCK):
            rows = np.stack([_unpacked(r.row) for r in found[lo : lo + BLOCK]])
            rows *= scale
            yield unit(rows)

    # Truncated decomposition by subspace iteration.
    axes = np.random.Generator(np.random.PCG64(9)).standard_normal((TERMS, latent + 8)).astype(np.float32)
    for _ in range(8):
        product = np.zeros_like(axes)
        for rows in weighted():
            product += rows.T @ (rows @ axes)
        axes, _ = np.linalg.qr(product)
    _, _, turn = np.linalg.svd(np.concatenate([rows @ axes for rows in weighted()]), full_matrices=False)
    axes = (axes @ turn.T[:, :latent]).astype(np.float32)
    vectors = unit(np.concatenate([rows @ axes for rows in weighted()]))
    labels_of = np.array([float(r.quality > 0) for r in found])
    return Voters(scale, axes, vectors, labels_of, float(labels_of.mean()))


def _voted(voters, texts: pa.Array) -> np.ndarray:
    parts = [voters.scores(terms(texts.slice(lo, BLOCK))) for lo in range(0, len(texts), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    Only the text makes a score. A null, empty or very short text without terms gets the share of
    accepted rows among the labelled. Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": _voted(shared.value, batch.column("text"))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(vote, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_voted(shared.value, batch.column("text")) >= ACCEPTED))

    return docs.mapInArrow(keep, docs.schema)

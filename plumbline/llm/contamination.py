"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item is contained if a document holds at least ``percent`` of its distinct 5-word shingles. Items are
partitioned by size (powers of two of their shingle count). Every item is sketched by its smallest
shingle hashes, as many as its partition's largest item may miss and one more: a document that contains
the item must hold at least one of them, so no containing document is lost, however long it is. (A
fixed number of minima with banding, tuned to a Jaccard value, would lose short items in long
documents, whose Jaccard value is near zero.) Documents contribute those of their shingle hashes that
are not above the largest sketch hash; a join on the hash gives candidates, in which real shingles
are then compared. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.once import once
from plumbline.llm.store import stored

N = 5
PERCENT = 80
BROADCAST_ROWS = 500_000  # of two or three numbers each: below 20 MB
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _runs(of: Column, one: Callable[[Column], Column], whole: Column, none: str, n: int) -> Column:
    """``one`` of each run of n words, or ``whole`` alone for one to n - 1 words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(of) - n), one)
    return F.when(F.size(of) >= n, runs).when(F.size(of) > 0, F.array(whole)).otherwise(F.array().cast(none))


def shingle_hashes(of: Column, n: int = N) -> Column:
    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(of, i + k) for k in range(n)])

    return F.array_distinct(_runs(of, hashed, F.xxhash64(of), "array<bigint>", n))


def shingles(of: Column, n: int = N) -> Column:
    def text(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(of, i + k) for k in range(n)])

    return F.array_distinct(_runs(of, text, F.array_join(of, " "), "array<string>", n))


def _if_short(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it was counted to be short; joined by shuffle otherwise, with the same result."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of which a document holds ``percent`` of the shingles or more.

    ``docs``: (doc_id, text); ``items``: (item_id, text). Texts of fewer than n words are one shingle,
    their whole sequence, which only equal short texts share. Null, empty and wordless texts contain
    nothing and are in nothing. Rows without an id take no part. Rows that repeat an id with another
    text count as one document (or item), its best share is returned, of equal shares the longer. Other columns
    are ignored.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), once(words(F.col("text"))).alias("w")).where("item_id is not null and size(w) > 0")
    known = stored(known.select("item_id", shingles(F.col("w"), n).alias("item_shingles"), shingle_hashes(F.col("w"), n).alias("h")).distinct(), "items")
    size = F.size("h")
    partition = F.ceil(F.log2(size)).cast("int")  # sizes of (2**(p-1), 2**p]
    may_miss = F.floor(F.pow(F.lit(2), partition) * (100 - percent) / 100).cast("int")
    sketch = F.slice(F.array_sort("h"), F.lit(1), F.least(size, may_miss + 1))
    sketches = known.select("item_id", size.alias("n"), F.explode(sketch).alias("hash"))
    facts = sketches.agg(F.count("*"), F.max("hash"), F.min("n")).first()
    rows, highest, least = facts[0], facts[1], facts[2]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    split = texts.select("doc_id", once(words(F.col("text"))).alias("w"))
    hashes = split.select("doc_id", once(shingle_hashes(F.col("w"), n)).alias("h"))
    low = hashes.select("doc_id", F.size("h").alias("doc_n"), F.explode(F.filter("h", lambda x: x <= F.lit(highest if rows else 0))).alias("hash"))
    low = low.where(F.col("doc_n") * 100 >= F.lit((least or 0) * percent))
    met = low.join(_if_short(sketches, rows), "hash").where(F.col("doc_n") * 100 >= F.col("n") * percent)
    candidates = stored(met.select("doc_id", "item_id").distinct(), "candidates")
    pairs = texts.join(_if_short(candidates, candidates.count()), "doc_id")
    exact = pairs.join(_if_short(known.select("item_id", "item_shingles"), 10 * rows), "item_id")
    split = exact.select("doc_id", "item_id", "item_shingles", once(words(F.col("text"))).alias("w"))
    own = split.select("doc_id", "item_id", "item_shingles", once(shingles(F.col("w"), n)).alias("doc_shingles"))
    count = once(F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long"))
    shared = own.select("doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"), count.alias("n_shared"))
    best = shared.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    both, rank = F.struct("n_shingles", "n_shared"), F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared")
    return best.groupBy("doc_id", "item_id").agg(F.max_by(both, rank).alias("best")).select("doc_id", "item_id", "best.*")


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    found = contained_items(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)

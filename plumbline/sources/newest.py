"""Newest row per key, kept up with each landing instead of computed from all history.

The state holds one row per key, in buckets of keys. A landing reads and writes only the buckets its
keys fall into; all other buckets stay the files they are. Since the newest of newest rows is the
newest row, landings may come late, overlap and repeat. A commit log (``commits``) decides between
landings at once: one that others overtook in a bucket of its own merges again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.latest import latest_per_key
from plumbline.session import scratch_path
from plumbline.sources.commits import ATTEMPT, MAX_TRIES, CommitLog, Conflict, new_attempt

BUCKET = "_bucket"
BUCKETS = 256
MAX_BUCKETS = 10_000
_PARTS = f"{BUCKET} BIGINT, n_rows BIGINT"


def _current(log: CommitLog, upto: int | None = None, touched: Sequence[int] | None = None) -> list[str]:
    """Folders of the newest version of each bucket, at most one a bucket."""
    parts = log.parts("parts", _PARTS, upto=upto)
    if touched is not None:
        parts = parts.where(F.col(BUCKET).isin(list(touched)))
    rows = parts.groupBy(BUCKET).agg(F.max_by(ATTEMPT, "number").alias("a")).collect()
    return [f"{log.folder('data', r.a)}/{BUCKET}={r[BUCKET]}" for r in rows]


def land(
    batch: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> list[int]:
    """Merge ``batch`` into the state below ``root``; return the buckets that were written again.

    Newest is highest on ``order`` (NULL lowest), rows equal there by their other columns, as in
    ``latest_per_key``. ``bucket`` is a whole number made of ``keys`` alone, always the same one for a
    table, e.g. a range of ids if a landing carries neighbours; by default a hash, which spreads a large
    landing over all ``BUCKETS``. A NULL bucket is bucket -1. An empty batch changes nothing.
    """
    spark, columns, schema = batch.sparkSession, batch.columns, batch.schema
    number = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if bucket is None else F.coalesce(bucket, F.lit(-1))
    placed = latest_per_key(batch, keys, order).withColumn(BUCKET, number.cast("bigint"))
    path = scratch_path(spark, "landing")
    placed.write.parquet(path)
    landed = spark.read.parquet(path)
    touched = sorted(r[0] for r in landed.select(BUCKET).distinct().limit(MAX_BUCKETS + 1).collect())
    if len(touched) > MAX_BUCKETS:
        raise ValueError(f"a landing touches more than {MAX_BUCKETS} buckets")
    if not touched:
        return []
    log, attempt, seen = CommitLog(spark, root), None, 0
    for _ in range(MAX_TRIES):
        upto = log.last()
        others = log.parts("parts", _PARTS, seen, upto).where(F.col(BUCKET).isin(touched))
        if attempt is None or not others.isEmpty():
            merged, held = landed, _current(log, upto, touched)
            if held:
                of_bucket = spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*held)
                state = of_bucket.select(*columns).withColumn(BUCKET, number.cast("bigint"))
                merged = landed.select(*columns, BUCKET).unionByName(state)
                merged = latest_per_key(merged, keys, order)
            attempt = new_attempt()
            # Ranges of (bucket, key): a large bucket is several tasks, small ones share one.
            spread = merged.repartitionByRange(BUCKET, *keys)
            spread.write.partitionBy(BUCKET).parquet(log.folder("data", attempt))
            counts = spark.read.parquet(log.folder("data", attempt)).groupBy(F.col(BUCKET).cast("bigint").alias(BUCKET))
            counts.agg(F.count("*").alias("n_rows")).coalesce(1).write.parquet(log.folder("parts", attempt))
        seen = upto
        if log.commit(upto + 1, attempt):
            return touched
    raise Conflict(f"{root}: no landing after {MAX_TRIES} tries")


def newest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest row of every key; ``schema`` as for ``spark.read.schema``."""
    held = _current(CommitLog(spark, root))
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*held)
    return rows.drop(ATTEMPT, BUCKET)

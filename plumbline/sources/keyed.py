"""Insert if absent into a table that several writers append to at once.

An append writes its new rows to files of disjoint key ranges and lists each file's range. Another
append reads only the files whose range its own keys fall into. A commit log (``commits``) decides
between appends at once: the slower one looks at what was committed meanwhile, drops what it now
finds, and tries the next number. A stopped append leaves files that no entry names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import checks
from plumbline.operators.joins import broadcast_if_short
from plumbline.operators.latest import latest_per_key
from plumbline.session import scratch_path
from plumbline.sources.commits import ATTEMPT, MAX_TRIES, CommitLog, Conflict, new_attempt


def _ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file, n_rows, low, high) of the files that ``rows`` are read from; low and high are key structs."""
    key = F.struct(*keys)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def _range_schema(batch: DataFrame, keys: Sequence[str]) -> str:
    key = batch.select(F.struct(*keys).alias("k")).schema["k"].dataType.simpleString()
    return f"file STRING, n_rows BIGINT, low {key}, high {key}"


def files_met(log: CommitLog, batch: DataFrame, keys: Sequence[str], after: int, upto: int) -> list[str]:
    """Files of the entries in (``after``, ``upto``] that may hold a key of ``batch``, a frame read from
    files sorted into key ranges. As many paths as files overlap the batch; the table's files are compared
    where they are listed."""
    mine = _ranges(batch, keys).select(F.col("low").alias("_low"), F.col("high").alias("_high"))
    held = log.parts("files", _range_schema(batch, keys), after, upto)
    meets = (F.col("low") <= F.col("_high")) & (F.col("_low") <= F.col("high"))
    return [r.file for r in held.join(broadcast_if_short(mine), meets, "left_semi").select("file").collect()]


def _write_sorted(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """``df`` in files of disjoint key ranges, read again."""
    df.repartitionByRange(*keys).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_once(df: DataFrame, root: str, keys: Sequence[str]) -> int:
    """Append the rows whose key the table below ``root`` does not hold; return how many were new.

    A key column must not be NULL. Of rows with one key the highest on the other columns, in their
    order, is taken. Any number of writers may append at once: every key is added once.
    """
    spark, columns = df.sparkSession, df.columns
    checks.enforce([checks.not_null(df, keys, name="append keys are not null")])
    rows = _write_sorted(latest_per_key(df, keys, []), keys, scratch_path(spark, "append"))
    log, seen, attempt, count = CommitLog(spark, root), 0, None, 0
    for _ in range(MAX_TRIES):
        upto = log.last()
        met = files_met(log, rows, keys, seen, upto) if upto > seen else []
        if met or attempt is None:
            held = spark.read.schema(df.schema).parquet(*met).select(*keys) if met else None
            fresh = rows if held is None else rows.join(held, list(keys), "left_anti").select(*columns)
            attempt = new_attempt()
            rows = _write_sorted(fresh, keys, log.folder("data", attempt))
            _ranges(rows, keys).coalesce(1).write.parquet(log.folder("files", attempt))
            count = spark.read.parquet(log.folder("files", attempt)).agg(F.sum("n_rows")).first()[0] or 0
        if not count:
            return 0
        seen = upto
        if log.commit(upto + 1, attempt):
            return count
    raise Conflict(f"{root}: no append after {MAX_TRIES} tries")


def read_appended(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all committed appends; ``schema`` as for ``spark.read.schema``."""
    return CommitLog(spark, root).parts("data", schema).drop(ATTEMPT, "number")

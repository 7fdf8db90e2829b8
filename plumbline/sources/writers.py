"""Writing snapshots, reloads and runs without a transactional table format.

Every attempt of a reload, run or publication writes to a folder of its own; one short record,
written last, names that attempt and makes it current, so a failed attempt is never read and can
be repeated with the same arguments. Attempts are ordered by the clock of the driver that starts
them; two drivers must not load the same target at once. ``append_if_absent`` writes into its
target, as one Spark job: a stopped append leaves nothing, but two at once may both add a key.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from plumbline.operators import checks
from plumbline.operators.latest import latest_per_key

RUN_PARTS = ("transfers", "allocations")
HEADER = "runs"
MART = "mart"
MANIFEST = "version STRING, table_name STRING, row_count BIGINT, loaded_at TIMESTAMP"
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def compact_stamp(at: datetime) -> str:
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y%m%dT%H%M%SZ")


def _run_id(at: datetime) -> str:
    """Sorts as time does, down to the microsecond."""
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y%m%dT%H%M%S%fZ")


def _attempt() -> str:
    """A new attempt's name; names sort as attempts begin."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _counted_write(df: DataFrame, path: str, mode: str, partition_by: Sequence[str] = ()) -> int:
    """Write, and count the rows on the way rather than in a second pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table; a table that cannot be read is an error, not absent."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return False
        raise
    return True


def append_if_absent(
    df: DataFrame, target: str, keys: Sequence[str], partition_by: Sequence[str] = ()
) -> int:
    """Append the rows whose key the target does not hold; return how many were new.

    A key column must not be NULL. Of rows with one key the highest on the other columns, in their
    order, is taken. A partitioned target (its partition columns must be part of the key) is read
    only in the partitions the batch touches, so an append does not grow slower as the target grows.
    """
    spark = df.sparkSession
    outside = [c for c in partition_by if c not in keys]
    if outside:
        raise ValueError(f"partition columns {outside} must be part of the key")
    checks.enforce([checks.not_null(df, keys, name="append keys are not null")])
    new = latest_per_key(df, keys, [])
    if exists(spark, target):
        held = spark.read.parquet(target)
        if partition_by:
            held = held.join(df.select(*partition_by).distinct(), list(partition_by), "left_semi")
        new = new.join(held.select(*keys), list(keys), "left_anti")
    return _counted_write(new, target, "append", partition_by)


def reload_tables(
    frames: Mapping[str, DataFrame],
    root: str,
    at: datetime,
    rules: Sequence[checks.Check] = (),
) -> dict[str, int]:
    """Replace all tables together. Every rule is checked before the first write; each table is
    written to the folder of this attempt, and manifest rows, written last in one job, switch over.

    The last load wins, whatever its ``at``; a load that failed can be repeated with the same one."""
    checks.enforce([checks.non_empty(df, f"{name} has rows") for name, df in frames.items()])
    if rules:
        checks.enforce(rules)
    version = _attempt()
    counts = {
        name: _counted_write(df, f"{root}/{name}/version={version}", "errorifexists")
        for name, df in frames.items()
    }
    _record(next(iter(frames.values())).sparkSession, root, version, counts, at)
    return counts


def _record(spark: SparkSession, root: str, version: str, counts: Mapping[str, int], at: datetime | None) -> None:
    rows = [(version, name, n, at) for name, n in counts.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    """The attempt that loaded ``name`` below ``root`` last, None if there is none."""
    if not exists(spark, f"{root}/_manifest"):
        return None
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").where(F.col("table_name") == name)
    return manifest.agg(F.max("version")).first()[0]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a reloaded table."""
    version = current_version(spark, root, name)
    if version is None:
        raise LookupError(f"{name} was never loaded below {root}")
    return spark.read.parquet(f"{root}/{name}/version={version}")


def write_snapshot_csv(df: DataFrame, folder: str, name: str, at: datetime) -> str:
    """Headed CSV snapshot in a folder named after the UTC time; times in ISO form. Written again for
    the same time, as by a repeated job, it is replaced."""
    path = f"{folder}/{name}_{compact_stamp(at)}"
    iso = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    writer = df.write.option("timestampNTZFormat", iso)
    writer.mode("overwrite").csv(path, header=True, escape='"', timestampFormat=f"{iso}xxx")
    return path


def write_run(
    transfers: DataFrame, allocations: DataFrame, summary: DataFrame, root: str, run_at: datetime
) -> dict[str, int]:
    """Store one run. All three parts share ``run_at`` and the attempt that wrote them; the header
    row, written last, is what makes the attempt visible. A run may have no transfers. Storing a
    ``run_at`` again replaces that run."""
    ids = {"run_id": F.lit(_run_id(run_at)), "attempt": F.lit(_attempt())}
    tagged = [df.withColumns({"run_at": F.lit(run_at), **ids}) for df in (transfers, allocations, summary)]
    counts = {}
    for name, df in zip((*RUN_PARTS, HEADER), tagged, strict=True):
        counts[name] = _counted_write(df, f"{root}/{name}", "append", ["run_id", "attempt"])
    return counts


def read_latest_run(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, transfers, allocations) of the newest run, as its last finished attempt wrote them;
    LookupError if there is none. Only that attempt's partitions are read."""
    if not exists(spark, f"{root}/{HEADER}"):
        raise LookupError(f"no run below {root}")
    header = spark.read.parquet(f"{root}/{HEADER}")
    newest = header.agg(F.max(F.struct("run_id", "attempt")).alias("r")).first().r
    if newest is None:
        raise LookupError(f"no run below {root}")

    def part(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{root}/{name}")
        mine = (F.col("run_id") == newest.run_id) & (F.col("attempt") == newest.attempt)
        return rows.where(mine).drop("run_id", "attempt")

    edges = part("transfers").orderBy("from_region", "to_region", "cadre")
    return part(HEADER), edges, part("allocations").orderBy("region")


def publish(df: DataFrame, name: str, kind: str, path: str | None = None) -> DataFrame:
    """Staging and intermediate results as views, marts as stored tables.

    With ``path`` a new version is written beside the old one and then made current, so a frame that
    reads the mart can be published over it. Without, Spark refuses a frame that reads the table."""
    if kind == "view":
        df.createOrReplaceTempView(name)
        return df
    if kind != "table":
        raise ValueError(f"kind must be 'view' or 'table', not {kind!r}")
    if path is None:
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    version = _attempt()
    rows = _counted_write(df, f"{path}/{MART}/version={version}", "errorifexists")
    _record(df.sparkSession, path, version, {MART: rows}, None)
    return read_table(df.sparkSession, path, MART)

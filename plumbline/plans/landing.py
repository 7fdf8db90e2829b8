"""From landed files to the tables the two products start from: validate, then store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.operators import checks, grid
from plumbline.session import scratch_path
from plumbline.sources import readers, writers

# A record is one answer of one pull; the same record pulled again is a new row.
OBSERVATION_KEYS = ("record_id", "fetched_at")


@dataclass(frozen=True)
class Landed:
    """What a landing did: rows that were new, findings that do not stop it, and requests without an answer."""

    new_rows: int
    findings: list[tuple[str, int]]
    failed_pairs: DataFrame
    snapshot: str


def land_observations(
    spark: SparkSession,
    pages: str,
    indicators: DataFrame,
    entities: DataFrame,
    target: str,
    snapshots: str,
    at: datetime,
    year_range: tuple[int, int],
    page_size: int,
) -> Landed:
    """Append the observations of landed pages to ``target`` and write a CSV snapshot of them.

    A page that does not parse, a missing value or a landing without any row stops the job before
    anything is stored. Landing the same pages again adds nothing; a later pull of the same records
    adds rows, of which staging takes the newest. ``failed_pairs`` are the requested (entity,
    indicator) pairs for which no page landed.
    """
    asked = readers.read_pages(spark, pages)
    path = scratch_path(spark, "landed")
    readers.load_observation_pages(asked, indicators, entities, year_range).write.parquet(path)
    rows = spark.read.parquet(path)
    findings = checks.enforce([checks.non_empty(rows, "landed observations"), readers.full_pages(asked, page_size)])
    new = writers.append_if_absent(rows, target, OBSERVATION_KEYS)
    snapshot = writers.write_snapshot_csv(rows, snapshots, "observations", at)
    answered = asked.select("location_id", "indicator_id")
    failed = grid.missing_pairs(entities.select("location_id"), indicators.select("indicator_id"), answered, "location_id")
    return Landed(new, findings, failed, snapshot)


@dataclass(frozen=True)
class Input:
    """A commented CSV input: where it is, its exact columns, and the rules its rows must keep."""

    path: str
    schema: T.StructType
    rules: Callable[[DataFrame], Sequence[checks.Check]] = lambda df: ()


def counts_not_negative(*columns: str) -> Callable[[DataFrame], Sequence[checks.Check]]:
    """A rule that every named count is there and at least 0."""

    def rules(df: DataFrame) -> list[checks.Check]:
        return [checks.not_null(df, columns), *[checks.in_range(df, c, 0) for c in columns]]

    return rules


def load_inputs(spark: SparkSession, inputs: Mapping[str, Input], root: str, at: datetime) -> dict[str, int]:
    """Validate all inputs, then replace all tables below ``root`` together; return their row counts.

    A wrong header, a malformed row (named with its file), a broken rule or an input without rows in
    any of them leaves every table as it was.
    """
    frames = {}
    for name, given in inputs.items():
        df = readers.read_commented_csv(spark, given.path, given.schema)
        checks.exact_schema(df, given.schema)
        frames[name] = df.select(*[F.col(f.name) for f in given.schema])
    rules = [rule for name, given in inputs.items() for rule in given.rules(frames[name])]
    return writers.reload_tables(frames, root, at, rules)

"""Latest row per key, and how often keys have rival records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row that is highest on ``order`` (NULL lowest) for each key.

    Written as an aggregate rather than ``row_number() = 1``: every task first reduces its own
    rows to one per key, so a key holding a third of all rows sends one row per task through the
    shuffle. Rows equal on ``order`` are told apart by their other columns, so a re-run task
    picks the same row.

    Select the columns you need first: the row travels as one struct, whose fields Spark does not
    prune.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    unordered = [c for c in rest if "map<" in df.schema[c].dataType.simpleString() or "variant" in df.schema[c].dataType.simpleString()]
    if unordered:  # not comparable: they travel beside the row, and do not tell equal rows apart
        told = [*order, *[c for c in rest if c not in unordered]]
        best = F.max_by(F.struct(*df.columns), F.struct(*told) if told else F.lit(1)).alias("_row")
        return df.groupBy(*keys).agg(best).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])
    ranked = [c for c in order if c not in keys]
    best = F.max(F.struct(*ranked, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def latest_wins(
    df: DataFrame,
    record: Sequence[str],
    fetched: str,
    key: Sequence[str],
    updated: str,
    steady: bool = False,
) -> DataFrame:
    """Newest snapshot of each record, then newest record of each business key.

    A tie on ``updated`` goes to the highest record id. Set ``steady`` only if a record never
    changes its key and a later fetch never carries an earlier ``updated``: then the newest
    snapshot of the winning record is the highest (updated, record, fetched) of the key, which
    takes one exchange instead of two and lets filters on the key reach the scan.
    """
    if steady:
        tie = [fetched] if fetched != updated else []
        return latest_per_key(df, key, [updated, *record, *tie])
    snapshots = latest_per_key(df, record, [fetched])
    return latest_per_key(snapshots, key, [updated, *record])


def conflict_profile(df: DataFrame, key: Sequence[str], record: str, by: Column | str) -> DataFrame:
    """Per period: business keys, and those that hold more than one distinct record.

    "More than one" is min <> max, which combines on the map side and shuffles once;
    counting distinct records per key would shuffle every (key, record) pair first.
    """
    by = F.col(by) if isinstance(by, str) else by
    per_key = df.groupBy(*key, by.alias("_by")).agg(
        (F.min(record) < F.max(record)).alias("_conflict")
    )
    return per_key.groupBy(F.col("_by").alias("period")).agg(
        F.count("*").alias("keys"), F.count_if("_conflict").alias("conflicts")
    )

"""Data-quality checks with ``warn`` and ``error`` severity.

A check is a name, a severity and a lazy frame of failing rows. ``report`` turns any number of
them into rows (check, severity, failing_rows, sample); ``enforce`` raises if an error-severity
check has failing rows. ``rule_report`` answers many row-level rules in a single scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.scalars import check_domain, pct_diff
from plumbline.operators import aggregates
from plumbline.operators.joins import missing_members


class CheckFailed(ValueError):
    """An error-severity check found failing rows."""


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    failing: DataFrame

    def __post_init__(self):
        if self.severity not in ("warn", "error"):
            raise ValueError(f"severity must be 'warn' or 'error', not {self.severity!r}")


def _label(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


# --- checks --------------------------------------------------------------------------------


def unique(df: DataFrame, cols: Sequence[str], severity="error", name=None) -> Check:
    """Keys that occur more than once; a key with a NULL is no key, see ``not_null``."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    twice = df.where(whole).groupBy(*cols).agg(F.count("*").alias("rows")).where("rows > 1")
    return Check(name or f"unique({','.join(cols)})", severity, twice)


def not_null(df: DataFrame, cols: Sequence[str], severity="error", name=None) -> Check:
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return Check(name or f"not_null({','.join(cols)})", severity, df.where(any_null))


def primary_key(df: DataFrame, cols: Sequence[str]) -> list[Check]:
    return [unique(df, cols), not_null(df, cols)]


def rule(df: DataFrame, bad: Column | str, severity: str, name: str) -> Check:
    """Rows for which ``bad`` holds. With ``warn`` a failing row is a finding, not a defect."""
    return Check(name, severity, df.where(bad))


def in_range(df: DataFrame, col: str, lo: float, strict=False, severity="error", name=None) -> Check:
    """Values below ``lo`` (or at it, if ``strict``). NULL passes; ``not_null`` is the check for it."""
    ok = F.col(col) > lo if strict else F.col(col) >= lo
    return Check(name or f"in_range({col})", severity, df.where(~ok))


def in_domain(df: DataFrame, col: str, allowed: Sequence, severity="error", name=None) -> Check:
    return Check(name or f"in_domain({col})", severity, df.where(~check_domain(col, allowed)))


def row_count(df: DataFrame, n: int, severity="error", name="row_count") -> Check:
    return Check(name, severity, aggregates.count_not(df, n))


def non_empty(df: DataFrame, name="non_empty") -> Check:
    empty = df.limit(1).agg(F.count("*").alias("rows")).where("rows = 0")
    return Check(name, "error", empty)


def foreign_key(child: DataFrame, parent: DataFrame, col: str, parent_col: str | None = None,
                severity="error", name=None) -> Check:
    """Child values with no parent. Children are reduced to distinct values before the join."""
    children = child.select(col).where(F.col(col).isNotNull()).distinct()
    parents = parent.select(F.col(parent_col or col).alias(col))
    return Check(name or f"foreign_key({col})", severity, children.join(parents, col, "left_anti"))


def reconcile(df: DataFrame, col: str, expected: Column | float, tol: float,
              severity="error", name="reconcile") -> Check:
    """One row when the column's sum is off the expected total by more than ``tol``."""
    return Check(name, severity, reconciliation(df, col, expected).where(F.col("pct_diff") > tol))


def reconciliation(df: DataFrame, col: str, expected: Column | float) -> DataFrame:
    expected = expected if isinstance(expected, Column) else F.lit(float(expected))
    return df.agg(F.sum(col).cast("double").alias("actual")).withColumn(
        "expected", expected.cast("double")
    ).withColumn("pct_diff", pct_diff("actual", "expected"))


def tables_agree(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str],
                 severity="error", name="tables_agree") -> Check:
    """Keys in only one copy, or whose fields differ; NULL equals NULL.

    Full outer join on the key, so each copy is read and shuffled once.
    """
    left = a.select(*key, F.struct(*fields).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*key, F.struct(*fields).alias("_b"), F.lit(True).alias("_in_b"))
    differing = F.filter(
        F.array(
            *[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]
        ),
        lambda f: f.isNotNull(),
    )
    problem = (
        F.when(F.col("_in_b").isNull(), "only in left")
        .when(F.col("_in_a").isNull(), "only in right")
        .when(F.size(differing) > 0, F.concat(F.lit("differs: "), F.array_join(differing, ",")))
    )
    rows = left.join(right, list(key), "full").select(*key, problem.alias("problem"))
    return Check(name, severity, rows.where("problem is not null"))


def coverage(df: DataFrame, col: str, members: DataFrame, excluded: Sequence = (),
             severity="error", name="coverage") -> Check:
    """Listed members that are missing, and excluded members that are present."""
    missing = missing_members(members, df, col).withColumn("problem", F.lit("missing"))
    present = df.where(F.col(col).isin(*excluded)) if excluded else df.where(F.lit(False))
    present = present.select(col).distinct().withColumn("problem", F.lit("excluded"))
    return Check(name, severity, missing.unionByName(present))


def exact_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raise unless names and types are exactly those of ``schema``, in any order."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        missing, extra = sorted(want.keys() - have.keys()), sorted(have.keys() - want.keys())
        typed = sorted(c for c in want.keys() & have.keys() if want[c] != have[c])
        raise CheckFailed(f"schema differs: missing {missing}, extra {extra}, other type {typed}")


def zero_sum(signed: DataFrame, by: Sequence[str], qty: str, severity="error", name="zero_sum") -> Check:
    """Groups whose signed moves do not add up to nothing."""
    totals = signed.groupBy(*by).agg(F.sum(qty).alias("net"))
    return Check(name, severity, totals.where("net <> 0"))


def floor_kept(holdings: DataFrame, edges: DataFrame, keys: Sequence[str], region: str, n: str,
               strict=True, severity="error", name="floor_kept") -> Check:
    """(region, cadre) pairs that give more than they may: below one where there was at least one,
    or below zero where there was none.

    ``strict`` judges outflow alone; otherwise inflow may make up for it. ``keys`` are the
    columns beside the region, e.g. the problem and the cadre.
    """
    moves = edges.select(
        *keys, F.explode(F.array(
            F.struct(F.col(f"from_{region}").alias(region), (-F.col("headcount")).alias("d")),
            F.struct(F.col(f"to_{region}").alias(region), F.col("headcount").alias("d")),
        )).alias("_m"),
    ).select(*keys, "_m.*")
    if strict:
        moves = moves.where("d < 0")
    moved = moves.groupBy(*keys, region).agg(F.sum("d").alias("_moved"))
    after = F.col(n) + F.coalesce("_moved", F.lit(0))
    rows = holdings.join(moved, [*keys, region], "left").withColumn("after", after).drop("_moved")
    return Check(name, severity, rows.where(((F.col(n) >= 1) & (F.col("after") < 1)) | (F.col("after") < 0)))


def known_ends(holdings: DataFrame, edges: DataFrame, keys: Sequence[str], region: str,
               severity="error", name="known_ends") -> Check:
    """Edges of which an end is no (region, cadre) of ``holdings``; a NULL end is unknown."""
    ends = holdings.select(*keys, region).distinct()
    sides = [
        edges.join(ends.withColumnRenamed(region, side), [*keys, side], "left_anti").select(*edges.columns)
        for side in (f"from_{region}", f"to_{region}")
    ]
    return Check(name, severity, sides[0].unionAll(sides[1]).distinct())


def improved(df: DataFrame, before: str, after: str, severity="error", name="improved") -> Check:
    """One row when the population variance did not fall."""
    pair = df.agg(F.var_pop(before).alias("before"), F.var_pop(after).alias("after"))
    return Check(name, severity, pair.where(~(F.col("after") < F.col("before"))))


# --- outcomes ------------------------------------------------------------------------------


def report(checks: Sequence[Check]) -> DataFrame:
    """(check, severity, failing_rows, sample); the sample is the smallest failing row as text."""
    parts = [
        c.failing.agg(
            F.count("*").alias("failing_rows"), F.min(_label(c.failing.columns)).alias("sample")
        ).select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "failing_rows", "sample")
        for c in checks
    ]
    return reduce(DataFrame.unionAll, parts)


def enforce(checks: Sequence[Check]) -> list[tuple[str, int]]:
    """Raise on failing error checks; return (name, failing rows) of failing warn checks."""
    rows = report(checks).where("failing_rows > 0").collect()
    errors = [f"{r['check']}: {r.failing_rows} failing, e.g. {r['sample']}" for r in rows if r.severity == "error"]
    if errors:
        raise CheckFailed("; ".join(errors))
    return [(r["check"], r.failing_rows) for r in rows]


def rule_report(
    df: DataFrame, rules: Mapping[str, tuple[Column, str]], key: Sequence[str]
) -> DataFrame:
    """``report`` for many row-level rules (name -> (bad-row condition, severity)) in one scan."""
    label = _label(key)
    one = df.agg(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(severity).alias("severity"),
                F.count_if(bad).alias("failing_rows"),
                F.min(F.when(bad, label)).alias("sample"),
            ).alias(f"_{i}")
            for i, (name, (bad, severity)) in enumerate(rules.items())
        ]
    )
    return one.select(F.inline(F.array(*one.columns)))

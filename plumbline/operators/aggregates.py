"""Counts, ratios, variances and distribution profiles. All combine on the map side."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.operators.grid import bounded_values, distinct_values
from plumbline.operators.joins import tag, with_scalar
from plumbline.operators.selection import order_statistics

# A basket of up to this many indicators is counted as the bits of one long.
MAX_BITS = 62


def basket_size(dim: DataFrame, flag: Column | str, out: str = "basket_size") -> DataFrame:
    return dim.where(flag).agg(F.count("*").alias(out))


def periods(facts: DataFrame, period: str) -> DataFrame:
    return distinct_values(facts, period)


def reported_counts(
    facts: DataFrame,
    basket: DataFrame,
    keys: Sequence[str],
    indicator: str,
    out: str = "reported",
) -> DataFrame:
    """Distinct basket indicators per key. Facts outside the basket do not count.

    ``basket`` is a one-column frame. A short basket becomes a filter the scan can use, and each
    indicator one bit of a long: OR-ing bits needs a single exchange and no distinct.
    """
    members = bounded_values(basket.select(indicator), MAX_BITS)
    if members is None:
        return tag(facts, basket, indicator).groupBy(*keys).agg(
            F.count_distinct(indicator).alias(out)
        )
    if not members:
        return facts.where(F.lit(False)).groupBy(*keys).agg(F.count("*").alias(out))
    place = F.array_position(F.array(*[F.lit(m) for m in members]), F.col(indicator)) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))
    return (
        facts.where(F.col(indicator).isin(members))
        .groupBy(*keys)
        .agg(F.bit_count(F.bit_or(bit)).cast("bigint").alias(out))
    )


def bound_summary(
    detail: DataFrame,
    keys: Sequence[str],
    indicator: str,
    value: str,
    period: str,
    flag: str = "is_impossible",
    extreme: str = "is_extreme",
) -> DataFrame:
    """All filtered aggregates of the plausibility detail in one pass.

    Keys whose rows are all plausible stay, with count 0 and NULL maxima.
    """
    hit = F.col(flag)
    return detail.groupBy(*keys).agg(
        F.count_if(hit).alias("incidents"),
        F.count_if(F.col(extreme)).alias("extreme_incidents"),
        F.count_distinct(F.when(hit, F.col(indicator))).alias("indicators_affected"),
        F.max(F.when(hit, F.col(value))).alias("max_value"),
        F.max(F.when(hit, F.col(period))).alias("latest_incident"),
        (F.count_if(hit) > 0).alias("impossible_flag"),
    )


def target_ratio(df: DataFrame, num: str, den: str, by: Sequence[str] = (), out="target_ratio"):
    """Ratio of sums (not the mean of ratios), per problem if ``by`` is given."""
    share = (F.sum(num).cast("double") / F.sum(den)).alias(out)
    return df.groupBy(*by).agg(share)


def flow_totals(edges: DataFrame, end: str, by: Sequence[str], qty: str, out: str) -> DataFrame:
    """Headcount leaving (``end`` = source column) or arriving (target column) per ``end`` and ``by``."""
    return edges.groupBy(*by, end).agg(F.sum(qty).alias(out))


def pop_variance(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "variance") -> DataFrame:
    return df.groupBy(*by).agg(F.var_pop(col).alias(out))


def count_not(df: DataFrame, n: int) -> DataFrame:
    """One row with the actual count when it is not ``n``, else no row."""
    return df.agg(F.count("*").alias("actual_rows")).where(F.col("actual_rows") != n)


def column_sums(df: DataFrame, expected: Mapping[str, float], rows: int | None = None) -> DataFrame:
    """One row per guarded total: name, actual, expected, whether equal. One pass over ``df``."""
    guards = {**{c: (F.sum(c), v) for c, v in expected.items()}}
    if rows is not None:
        guards["row_count"] = (F.count("*"), rows)
    sums = df.agg(*[agg.cast("double").alias(name) for name, (agg, _) in guards.items()])
    long = sums.unpivot([], list(guards), "guard", "actual")
    wanted = F.create_map(*[x for n, (_, v) in guards.items() for x in (F.lit(n), F.lit(float(v)))])
    return long.withColumn("expected", wanted[F.col("guard")]).withColumn(
        "ok", F.col("actual").eqNullSafe(F.col("expected"))
    )


def headline(scorecard: DataFrame, score: str = "score") -> DataFrame:
    return scorecard.agg(
        F.coalesce(F.max(score), F.lit(0)).alias("max_score"),
        F.count_if(F.col(score) > 0).alias("flagged"),
        F.count("*").alias("total"),
    )


def quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """Exact, interpolated quantiles: rows (q, value); none if there is no value.

    By selection (``selection.order_statistics``): a few passes of counts and sketches, so values are
    neither sorted nor shuffled. The passes run when this is called.
    """

    def spots(n: int) -> list[tuple[int, int, float]]:
        at = [float(q) * (n - 1) for q in qs]
        return [(math.floor(s), math.ceil(s), s - math.floor(s)) for s in at] if n else []

    n, found = order_statistics(df, col, lambda n: [k for low, high, _ in spots(n) for k in (low, high)])
    kind = df.schema[col].dataType
    schema = T.StructType([T.StructField("q", T.DoubleType()), T.StructField("_a", kind), T.StructField("_b", kind), T.StructField("_f", T.DoubleType())])
    rows = [(float(q), found[low], found[high], f) for q, (low, high, f) in zip(qs, spots(n))]
    spark = df.sparkSession
    return spark.createDataFrame(rows, schema).select("q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value"))


def quantile_cutoff(df: DataFrame, col: str, q: float, out: str = "cutoff") -> DataFrame:
    return quantiles(df, col, [q]).select(F.col("value").alias(out))


def profile(df: DataFrame, col: str, threshold: float, margin: float, below: bool) -> DataFrame:
    """One row: count, min, median, max, rows within ``margin`` of the threshold, rows crossing it."""
    x = F.col(col)
    crossing = (x < threshold) if below else (x >= threshold)
    # The distance is rounded so that 0.43 - 0.33 does not miss a margin of 0.1 by a stray bit.
    near = F.round(F.abs(x - threshold), 9) <= margin
    counts = df.agg(
        F.count(x).alias("rows"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.count_if(near).alias("near_threshold"),
        F.count_if(crossing).alias("crossing"),
    )
    return with_scalar(counts, quantile_cutoff(df, col, 0.5, "median_value"))


def subset_share(df: DataFrame, measure: Column | str, member: Column) -> DataFrame:
    """Share of a total that the rows of a subset cover; NULL for an empty total."""
    measure = F.col(measure) if isinstance(measure, str) else measure
    part = F.coalesce(F.sum(F.when(member, measure)), F.lit(0)).cast("double")
    return df.agg(
        part.alias("covered"),
        F.sum(measure).cast("double").alias("total"),
        F.try_divide(part, F.sum(measure).cast("double")).alias("share"),
    )

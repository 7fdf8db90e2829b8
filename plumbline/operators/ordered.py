"""Running totals, carried values and row numbers over a global order.

A plain window puts one whole group into one task. That is right while groups are known to be
small. By default the groups are counted first; where one is too large, or with ``slices`` set, the same results come from a range-partitioned order instead: each
slice is scanned on its own, and one short row per slice carries the total or value across the
slice borders. The slices are cut reliably first, so that a lost executor cannot move a border.

Rows of equal order are told apart by a hash of the whole row, and equal rows by the partition they come
from, so a value that most rows share is dealt over many slices like any other. Which of several
rows of equal order comes first is as open as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.session import cut

_START, _HERE = Window.unboundedPreceding, Window.currentRow
MAX_GROUP_ROWS = 1_000_000
DIGITS = 12  # decimal places that sums of doubles keep


def slices_for(df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> int | None:
    """None if every group fits one task, else the number of slices for all rows, since all of them,
    not the largest group's alone, are dealt over the slices."""
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    top, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (top or 0) <= max_group_rows:
        return None
    return max(2, -(-total // max_group_rows) * 4)


def _slices(df: DataFrame, keys: Sequence[str], slices: int | str | None) -> int | None:
    return slices_for(df, keys) if slices == "auto" else slices


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int) -> DataFrame:
    tie = [F.xxhash64(*df.columns), F.spark_partition_id()]
    told = df.withColumns({"_tie": tie[0], "_from": tie[1]})
    ranged = told.repartitionByRange(slices, *[F.col(k) for k in keys], *order, "_tie", "_from")
    return cut(ranged.drop("_tie", "_from").withColumn("_slice", F.spark_partition_id()))


def _summable(df: DataFrame, qty: str) -> tuple[Column, str]:
    """``qty`` as it is summed, and its type. Fractions are summed as decimals of ``DIGITS`` places, so that a total
    does not depend on the order of its parts."""
    kind = df.schema[qty].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.col(qty).cast(f"decimal(38,{DIGITS})"), "double"
    return F.col(qty), ""


def with_previous(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str]) -> DataFrame:
    """Value of the previous row per key: ``cols`` maps input column -> output column.

    The previous row is the nearest earlier one that exists, not the period minus one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({out: F.lag(c).over(w) for c, out in cols.items()})


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    qty: str,
    out: str,
    slices: int | str | None = "auto",
) -> DataFrame:
    """Inclusive running sum of ``qty`` along ``order`` within each group of ``keys``.

    Doubles are read to 12 decimal places and summed as decimals, so slices give the same digits; sums beyond
    26 digits before the point are an error."""
    slices = _slices(df, keys, slices)
    value, kind = _summable(df, qty)
    total = (lambda c: c.cast(kind)) if kind else (lambda c: c)
    if slices is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_START, _HERE)
        return df.withColumn(out, total(F.sum(value).over(w)))
    rows = _sliced(df, keys, order, slices)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(_START, _HERE)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(_START, -1)
    carried = (
        rows.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        rows.withColumn("_local", F.sum(value).over(local))
        .join(carried, [*keys, "_slice"])
        .withColumn(out, total(F.col("_local") + F.col("_before")))
        .select(*df.columns, out)
    )


def numbered(df: DataFrame, order: Sequence[Column], out: str = "rank", slices: int | str | None = "auto"):
    """Row number over the global order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(ones, [], order, "_one", out, slices).drop("_one")


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    out: str,
    slices: int | str | None = "auto",
) -> DataFrame:
    """Pieces where a left interval ``[lo, hi)`` meets a right one within the same key.

    Intervals of one side must not overlap each other. Instead of a range join, which pairs
    everything with everything, both sides' starts are merged into one order and each start sees
    the last interval opened on either side: at most one piece per start. ``out`` is the length.
    """
    lcols = [c for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys]
    empty_l = F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType)
    empty_r = F.lit(None).cast(right.select(F.struct(*rcols)).schema[0].dataType)
    starts = left.select(
        *keys, F.col(lo).alias("_at"), F.lit(0).alias("_side"),
        F.struct(*lcols).alias("_l"), empty_r.alias("_r"),
    ).unionAll(
        right.select(
            *keys, F.col(lo).alias("_at"), F.lit(1).alias("_side"),
            empty_l.alias("_l"), F.struct(*rcols).alias("_r"),
        )
    )
    order = [F.col("_at").asc(), F.col("_side").asc()]
    slices = _slices(starts, keys, slices)
    if slices is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        seen = w.rowsBetween(_START, _HERE)
        merged = starts.select(
            *keys, "_at",
            F.last("_l", ignorenulls=True).over(seen).alias("_l"),
            F.last("_r", ignorenulls=True).over(seen).alias("_r"),
            F.lead("_at").over(w).alias("_next"),
        )
    else:
        rows = _sliced(starts, keys, order, slices)
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        seen = w.rowsBetween(_START, _HERE)
        by_slice = Window.partitionBy(*keys).orderBy("_slice")
        earlier = by_slice.rowsBetween(_START, -1)
        # At most one interval of a side starts at a given point, so max_by has no ties.
        carried = (
            rows.groupBy(*keys, "_slice")
            .agg(
                F.max_by("_l", F.when(F.col("_side") == 0, F.col("_at"))).alias("_ll"),
                F.max_by("_r", F.when(F.col("_side") == 1, F.col("_at"))).alias("_lr"),
                F.min("_at").alias("_first"),
            )
            .select(
                *keys, "_slice",
                F.last("_ll", ignorenulls=True).over(earlier).alias("_cl"),
                F.last("_lr", ignorenulls=True).over(earlier).alias("_cr"),
                F.lead("_first").over(by_slice).alias("_cn"),
            )
        )
        merged = (
            rows.select(
                *keys, "_slice", "_at",
                F.last("_l", ignorenulls=True).over(seen).alias("_l"),
                F.last("_r", ignorenulls=True).over(seen).alias("_r"),
                F.lead("_at").over(w).alias("_next"),
            )
            .join(carried, [*keys, "_slice"])
            .select(
                *keys, "_at",
                F.coalesce("_l", "_cl").alias("_l"),
                F.coalesce("_r", "_cr").alias("_r"),
                F.coalesce("_next", "_cn").alias("_next"),
            )
        )
    # least() skips a NULL _next, so the last start runs to the nearer end.
    end = F.least("_next", F.col(f"_l.{hi}"), F.col(f"_r.{hi}"))
    inner_l = [c for c in lcols if c not in (lo, hi)]
    inner_r = [c for c in rcols if c not in (lo, hi)]
    return (
        merged.where(F.col("_l").isNotNull() & F.col("_r").isNotNull())
        .withColumn(out, end - F.col("_at"))
        .where(F.col(out) > 0)
        .select(
            *keys,
            *[F.col(f"_l.{c}").alias(c) for c in inner_l],
            *[F.col(f"_r.{c}").alias(c) for c in inner_r],
            out,
        )
    )

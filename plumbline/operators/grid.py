"""Dense entity x axis grids: every entity gets a row for every axis value, gaps included.

The grid itself is never shuffled. What is known about an entity is gathered into one short
array (at most one element per axis value), joined to the entity once, and only then spread
out; the missing elements are added row by row. The result stays partitioned by entity, so a
window or aggregate per entity that follows needs no exchange either.

That needs the axis as a literal list, which is read to the driver only up to ``max_axis``
values. A longer axis takes the two-sided way of ``_pair_tiles`` instead. The limit decides on the
plan only: both ways return the same rows. In both, the axis is its distinct non-null values, and
counts off the axis are no part of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MAX_AXIS = 5000
TILE_ENTITIES, TILE_VALUES = 10_000, 1_000


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def bounded_values(values: DataFrame, limit: int = MAX_AXIS) -> list | None:
    """The single column of ``values`` as a sorted list without NULL, or None if there are more than
    ``limit``."""
    known = values.where(F.col(values.columns[0]).isNotNull())
    rows = known.distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else None


def _axis_array(values: list, like: DataFrame, axis: str) -> Column:
    kind = like.schema[axis].dataType
    return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind.simpleString()}>")


def _pair_tiles(entities: DataFrame, axis_df: DataFrame) -> DataFrame:
    """Pairs for an axis too long to carry in each row.

    The two sides meet in tiles of a bounded number of rows, as many as their row counts need, and
    each side is copied along the other direction. A task sees a fixed share of both sides.
    """
    rows = -(-max(entities.count(), 1) // TILE_ENTITIES)
    cols = -(-max(axis_df.count(), 1) // TILE_VALUES)

    def dealt(df: DataFrame, tiles: int):
        return F.pmod(F.xxhash64(*df.columns), F.lit(tiles)).cast("int")

    def every(tiles: int):
        return F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    left = entities.select("*", dealt(entities, rows).alias("_r"), every(cols).alias("_c"))
    right = axis_df.select("*", dealt(axis_df, cols).alias("_c"), every(rows).alias("_r"))
    return left.join(right, ["_r", "_c"]).drop("_r", "_c")


def dense_grid(
    entities: DataFrame,
    axis_df: DataFrame,
    max_axis: int = MAX_AXIS,
) -> DataFrame:
    """Every entity with every value of the one-column frame ``axis_df``."""
    axis = axis_df.columns[0]
    values = bounded_values(axis_df, max_axis)
    if values is None:
        return _pair_tiles(entities, distinct_values(axis_df, axis))
    return entities.withColumn(axis, F.explode(_axis_array(values, axis_df, axis)))


def filled_grid(
    entities: DataFrame,
    counts: DataFrame,
    axis_df: DataFrame,
    key: str,
    measure: str,
    max_axis: int = MAX_AXIS,
) -> DataFrame:
    """``dense_grid`` with ``measure`` from ``counts`` (one row per key and axis value), 0 if absent or
    null."""
    axis = axis_df.columns[0]
    values = bounded_values(axis_df, max_axis)
    zero = F.lit(0).cast(counts.schema[measure].dataType)
    if values is None:
        grid = _pair_tiles(entities, distinct_values(axis_df, axis))
        met = grid.join(counts.select(key, axis, measure), [key, axis], "left")
        return met.select(*entities.columns, axis, F.coalesce(measure, zero).alias(measure))
    known = counts.where(F.col(axis).isin(values)).groupBy(key).agg(
        F.collect_list(F.struct(F.col(axis).alias("a"), F.coalesce(measure, zero).alias("m"))).alias("_known")
    )
    seen = F.coalesce(F.transform("_known", lambda e: e["a"]), F.array().cast(_array_of(axis_df, axis)))
    gaps = F.transform(
        F.array_except(_axis_array(values, axis_df, axis), seen),
        lambda a: F.struct(a.alias("a"), zero.alias("m")),
    )
    spread = F.explode(F.when(F.col("_known").isNull(), gaps).otherwise(F.concat("_known", gaps)))
    return (
        entities.join(known, key, "left")
        .select(*entities.columns, spread.alias("_e"))
        .select(*entities.columns, F.col("_e.a").alias(axis), F.col("_e.m").alias(measure))
    )


def _array_of(df: DataFrame, col: str) -> str:
    return f"array<{df.schema[col].dataType.simpleString()}>"


def expected_pairs(dim_a: DataFrame, dim_b: DataFrame) -> DataFrame:
    """The request grid: every row of ``dim_a`` with every value of the one-column ``dim_b``."""
    return dense_grid(dim_a, dim_b)


def missing_pairs(
    dim_a: DataFrame,
    dim_b: DataFrame,
    landed: DataFrame,
    key: str,
    max_axis: int = MAX_AXIS,
) -> DataFrame:
    """Expected pairs with no landed row. Whole sets are compared per entity, so the full request
    grid is not built to find a few gaps in it; only an axis over ``max_axis`` values is met in
    tiles, which does build all pairs."""
    axis = dim_b.columns[0]
    values = bounded_values(dim_b, max_axis)
    pairs = landed.select(key, axis).distinct()
    if values is None:
        gaps = _pair_tiles(dim_a, distinct_values(dim_b, axis)).join(pairs, [key, axis], "left_anti")
        return gaps.select(*dim_a.columns, axis)
    seen = pairs.where(F.col(axis).isin(values)).groupBy(key).agg(F.collect_list(axis).alias("_seen"))
    gaps = F.array_except(
        _axis_array(values, dim_b, axis), F.coalesce("_seen", F.array().cast(_array_of(dim_b, axis)))
    )
    return dim_a.join(seen, key, "left").select(*dim_a.columns, F.explode(gaps).alias(axis))

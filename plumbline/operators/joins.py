"""Joins of the audit and levelling plans, and the differences between two sets of members.

Only tag dimensions and totals are ever marked for broadcast, and only after their rows and bytes
were counted against a limit. Everywhere else Spark decides: it broadcasts a side whose measured size is
below its threshold (at planning for files, at run time for computed frames) and otherwise
sorts and merges, splitting skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 16 << 20


def broadcast_if_short(dim: DataFrame, limit: int = MAX_BROADCAST_ROWS, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``dim`` marked for broadcast if it has at most ``limit`` rows of at most ``most`` bytes as text
    together, else as it is.

    A dimension built in the session has no size Spark could plan with. Unmarked, the facts
    would be shuffled by a key of few values before Spark learns how short the other side is.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(c).cast("string") for c in dim.columns])))
    rows, size = dim.select(width.alias("w")).limit(limit + 1).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(dim) if rows <= limit and (size or 0) <= most else dim


def tag(facts: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join to the tag dimension; facts the dimension does not know drop out."""
    return facts.join(broadcast_if_short(dim), on, "inner")


def untagged(facts: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The facts ``tag`` drops."""
    keys = dim.select(on) if isinstance(on, str) else dim.select(*on)
    return facts.join(broadcast_if_short(keys), on, "left_anti")


def join_on_name(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Inner join on an already normalised name; names without a partner drop out."""
    return left.join(right, name, "inner")


def unmatched_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Distinct names that ``join_on_name`` drops silently."""
    return left.select(name).distinct().join(right.select(name), name, "left_anti")


def join_trimmed(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Inner join on trimmed names. Both sides are trimmed first, so it is a plain key join."""
    trimmed = F.trim(name).alias(name)
    lhs = left.select(*[trimmed if c == name else F.col(c) for c in left.columns])
    rhs = right.select(*[trimmed if c == name else F.col(c) for c in right.columns])
    return lhs.join(rhs, name, "inner")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame. A scalar subquery, so no join is planned and more
    than one row is an error."""
    if len(scalar.columns) == 1:
        return df.withColumn(scalar.columns[0], scalar.scalar())
    packed = scalar.select(F.struct(*scalar.columns).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, "_s.*")


def missing_members(expected: DataFrame, actual: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Distinct expected members with no actual row."""
    cols = [on] if isinstance(on, str) else list(on)
    return expected.select(*cols).distinct().join(actual.select(*cols), cols, "left_anti")


def symmetric_diff(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Members of only one side, with ``side`` saying which; one shuffle of both sides."""
    cols = [on] if isinstance(on, str) else list(on)
    both = a.select(*cols, F.lit(1).alias("_m")).unionByName(b.select(*cols, F.lit(2).alias("_m")))
    return (
        both.groupBy(*cols)
        .agg(F.bit_or("_m").alias("_m"))
        .where("_m <> 3")
        .select(*cols, F.when(F.col("_m") == 1, "left").otherwise("right").alias("side"))
    )


def children_at_level(
    df: DataFrame, parent: Column | int, level: int, parent_col="parent_id", level_col="level"
) -> DataFrame:
    """Members below one parent at exactly one level."""
    return df.where((F.col(parent_col) == parent) & (F.col(level_col) == level))


def basket_from_catalogue(
    df: DataFrame, source: Column | str, flag: Column | str, source_col="source"
) -> DataFrame:
    """Catalogue entries of one source whose flag is set; NULL is not set."""
    return df.where(F.col(source_col) == source).where(flag)

"""Pairs of intervals that overlap, where the intervals of one side may overlap each other.

A range condition alone makes Spark compare everything with everything. Here every interval has a
level, the smallest power of two that holds its length, and lies in at most two bins of that width. A pair
meets at the higher of its two levels: the longer interval is entered in its own bins, the shorter one as
a guest in the bins of every longer level that the other side has. Two equi-joins cover all pairs
(longer or equal on the left; longer on the right), and of the bins that a pair shares only the one
that holds its reference point, the later start, reports it. Intervals in a bin are at most about as long as the
bin, so most of what meets overlaps, and work follows the result.

Bins with many entries are split: the entries of either side are dealt over parts, and each part of one
side meets each part of the other exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.joins import broadcast_if_short

SPLIT_ROWS = 500_000
_BIN = ["_level", "_bin"]


def level_of(length: Column) -> Column:
    """The smallest k with 2**k >= length, for lengths of 1 and more; exact for all 64-bit lengths."""
    return F.when(length > 1, F.length(F.bin(length - 1))).otherwise(0)


def _sized(df: DataFrame, keys: Sequence[str], lo: str, hi: str, name: str) -> DataFrame:
    """Non-empty intervals as (keys, lo, hi, level, the row's other columns in one struct)."""
    start, end = F.col(lo).cast("long"), F.col(hi).cast("long")
    rest = [c for c in df.columns if c not in (*keys, lo, hi)]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("_none"))
    rows = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (end > start))
    return rows.select(*keys, start.alias(f"_lo{name}"), end.alias(f"_hi{name}"), level_of(end - start).alias(f"_own{name}"), row.alias(f"_row{name}"))


def _levels(sized: DataFrame, name: str) -> list[int]:
    """The levels that occur: 63 at most."""
    return sorted(r[0] for r in sized.select(f"_own{name}").distinct().collect())


def entered(sized: DataFrame, name: str, levels: Column) -> DataFrame:
    """One row for each bin of each of ``levels`` that an interval touches: two a level at most."""
    first, last = F.expr(f"shiftright(_lo{name}, _level)"), F.expr(f"shiftright(_hi{name} - 1, _level)")
    return sized.withColumn("_level", F.explode(levels)).withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))


def _hot(entries: DataFrame, keys: Sequence[str], split_rows: int, out: str) -> DataFrame:
    counts = entries.groupBy(*keys, *_BIN).agg(F.count("*").alias("_n")).where(F.col("_n") > split_rows)
    return counts.select(*keys, *_BIN, F.ceil(F.col("_n") / split_rows).cast("int").alias(out))


def _dealt(entries: DataFrame, hot: DataFrame, on: list[str], name: str, own: str, other: str) -> DataFrame:
    """Entries of hot bins: each in one part of its own side, and once for every part of the other side."""
    salt = F.pmod(F.xxhash64(f"_lo{name}", f"_hi{name}", f"_row{name}", F.spark_partition_id()), F.col(own)).cast("int")
    marked = entries.join(broadcast_if_short(hot), on, "left")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
    return marked.withColumn(f"_at{own}", F.coalesce(salt, F.lit(0))).withColumn(f"_at{other}", parts).drop(own, other)


def split(left: DataFrame, right: DataFrame, keys: Sequence[str], split_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides' entries and the columns to join them by; bins above ``split_rows`` entries a side are dealt out."""
    on = [*keys, *_BIN]
    hot = _hot(left, keys, split_rows, "_lparts").join(_hot(right, keys, split_rows, "_rparts"), on, "full")
    if hot.isEmpty():
        return left, right, on
    left = _dealt(left, hot, on, "l", "_lparts", "_rparts")
    right = _dealt(right, hot, on, "r", "_rparts", "_lparts")
    return left, right, [*on, "_at_lparts", "_at_rparts"]


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    out: str,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Every pair of a left and a right row with equal ``keys`` whose intervals ``[lo, hi)`` overlap.

    ``lo`` and ``hi`` are whole numbers (days, seconds, positions). ``out`` is the length of the overlap,
    beside both sides' other columns, whose names must differ. Each pair is returned once; equal rows are pairs
    of their own. Null keys, null ends and empty intervals meet nothing.
    """
    lcols = [c for c in left.columns if c not in (*keys, lo, hi)]
    rcols = [c for c in right.columns if c not in (*keys, lo, hi)]
    if clash := set(lcols) & set(rcols):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    a, b = _sized(left, keys, lo, hi, "l"), _sized(right, keys, lo, hi, "r")
    la, lb = _levels(a, "l"), _levels(b, "r")

    def from_level(levels: list[int], test) -> Column:
        return F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), test)

    # The left interval is the longer or an equal one; then the right one is the longer.
    sides = [
        (entered(a, "l", F.array("_ownl")), entered(b, "r", from_level(la, lambda x: x >= F.col("_ownr")))),
        (entered(a, "l", from_level(lb, lambda x: x > F.col("_ownl"))), entered(b, "r", F.array("_ownr"))),
    ]
    start, end = F.greatest("_lol", "_lor"), F.least("_hil", "_hir")
    met = []
    for one, two in sides:
        one, two, on = split(one, two, keys, split_rows)
        pairs = one.join(two, on).where((end > start) & (F.expr("shiftright(greatest(_lol, _lor), _level)") == F.col("_bin")))
        met.append(
            pairs.select(*keys, *[F.col(f"_rowl.{c}").alias(c) for c in lcols], *[F.col(f"_rowr.{c}").alias(c) for c in rcols], (end - start).alias(out))
        )
    return met[0].unionAll(met[1])

"""Exact order statistics without sorting: a sketch brackets a rank, a counting pass verifies and narrows.

One aggregate over the column returns, for each rank still sought, how many values lie below, at and
between two cut points, and a mergeable quantile sketch of those between. The counts are exact, so a bracket is
known to hold its rank or is replaced by the part that does; the sketch only proposes the next cut
points. Each pass leaves about a thousandth of the values. When few are left they alone are fetched. Every task sends one
row of counts and sketches a pass: values are neither sorted nor shuffled, however many there are
and however often one of them repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

KEEP = 100_000
GRID = 512
ACCURACY = 10_000
MAX_PASSES = 200  # a stuck bracket is halved by value each second pass


@dataclass
class Bracket:
    """A rank's place: the values strictly between ``low`` and ``high`` (None: no bound), ``before`` of them below."""

    rank: int
    low: object = None
    high: object = None
    before: int = 0
    inside: int | None = None
    grid: Sequence | None = None
    ends: tuple | None = None  # least and largest value inside
    stuck: bool = False
    value: object = None
    known: bool = False

    def cuts(self) -> tuple | None:
        """Two values around the rank that the sketch proposes; their middle where it no longer tells values apart."""
        if not self.grid:
            return None
        if self.stuck:
            low, high = self.ends
            middle = (low + high) // 2 if isinstance(low, int) else min(max(low / 2 + high / 2, low), high)
            if isinstance(low, Decimal):  # on a digit that the column has
                middle = min(max(middle.quantize(low, ROUND_FLOOR), low), high)
            return middle, middle
        at = (self.rank - self.before) / self.inside * GRID
        slack = 2 + 2 * GRID / ACCURACY
        near = self.grid[max(0, int(at - slack))], self.grid[min(GRID, int(at + 1 + slack))]
        return tuple(min(max(c, self.ends[0]), self.ends[1]) for c in near)

    def narrow(self, n: int, grid: Sequence | None, ends: tuple, counts: tuple[int, int, int] | None, cuts: tuple | None) -> None:
        """Takes over what a pass has counted."""
        if cuts is None:
            self.inside, self.grid, self.ends = n, grid, ends
            return
        lower, at_low, at_high = counts
        low, high = cuts
        r, were = self.rank - self.before, self.inside
        if r < lower:
            self.high, self.inside, self.grid = low, lower, None
        elif r < lower + at_low:
            self.value, self.known = low, True
        elif r < lower + at_low + n:
            self.low, self.high, self.before, self.inside = low, high, self.before + lower + at_low, n
            self.grid, self.ends = grid, ends
        elif low != high and r < lower + at_low + n + at_high:
            self.value, self.known = high, True
        else:
            skipped = lower + at_low + (n + at_high if low != high else 0)
            self.low, self.before, self.inside, self.grid = high, self.before + skipped, were - skipped, None
        self.stuck = not self.known and self.inside > were // 2


def _between(x: Column, low, high, kind: DataType) -> Column:
    inside = ~F.isnan(x) if isinstance(kind, (DoubleType, FloatType)) else F.lit(True)
    if low is not None:
        inside &= x > F.lit(low).cast(kind)
    if high is not None:
        inside &= x < F.lit(high).cast(kind)
    return inside


def counted(values: DataFrame, wanted: list[tuple]) -> DataFrame:
    """One row: for each (low, high, cuts) the counts and the sketch of the next region."""
    x, kind, out = F.col("x"), values.schema["x"].dataType, []
    probes = [i / GRID for i in range(GRID + 1)]
    for i, (low, high, cuts) in enumerate(wanted):
        whole = _between(x, low, high, kind)
        region = whole & _between(x, *cuts, kind) if cuts else whole
        inside = F.when(region, x)
        out += [F.count_if(region).alias(f"n{i}"), F.percentile_approx(inside, probes, ACCURACY).alias(f"g{i}")]
        out += [F.min(inside).alias(f"min{i}"), F.max(inside).alias(f"max{i}")]
        if cuts:
            a, b = (F.lit(c).cast(kind) for c in cuts)
            out += [F.count_if(whole & (x < a)).alias(f"l{i}"), F.count_if(whole & (x == a)).alias(f"a{i}"), F.count_if(whole & (x == b)).alias(f"b{i}")]
    nan = F.count_if(F.isnan("x")) if isinstance(kind, (DoubleType, FloatType)) else F.lit(0)
    return values.agg(*out, nan.alias("nan"))


def order_statistics(df: DataFrame, col: str, ranks_of: Callable[[int], Sequence[int]], keep: int = KEEP) -> tuple[int, dict[int, object]]:
    """The number of non-null values of a numeric column, and the values at the ranks (from 0) that
    ``ranks_of`` that number asks for. NaN is above all other values, as in Spark's order."""
    values = df.select(F.col(col).alias("x")).where(F.col(col).isNotNull())
    first = counted(values, [(None, None, None)]).first()
    n, nans = first["n0"], first["nan"]
    wanted = sorted(set(ranks_of(n + nans)))
    found: dict[int, object] = {k: float("nan") for k in wanted if k >= n}
    ends = first["min0"], first["max0"]
    brackets = [Bracket(k, inside=n, grid=first["g0"], ends=ends) for k in wanted if k < n]
    open_: list[Bracket] = []
    for _ in range(MAX_PASSES):
        open_ = [b for b in brackets if not b.known]
        large = [b for b in open_ if b.inside > keep]
        if not large:
            break
        asked = list(dict.fromkeys((b.low, b.high, b.cuts()) for b in large))
        row = counted(values, asked).first()
        for b in large:
            cuts = b.cuts()
            i = asked.index((b.low, b.high, cuts))
            b.narrow(row[f"n{i}"], row[f"g{i}"], (row[f"min{i}"], row[f"max{i}"]), (row[f"l{i}"], row[f"a{i}"], row[f"b{i}"]) if cuts else None, cuts)
    else:
        raise RuntimeError(f"{col}: no rank found in {MAX_PASSES} passes")
    if open_:
        kind = values.schema["x"].dataType
        few = values.where(F.array_contains(F.array(*[_between(F.col("x"), b.low, b.high, kind) for b in open_]), True))
        held = sorted((r["x"], r["count"]) for r in few.groupBy("x").count().collect())
        for b in open_:
            left = b.rank - b.before
            for value, count in held:
                if (b.low is None or value > b.low) and (b.high is None or value < b.high):
                    if left < count:
                        b.value = value
                        break
                    left -= count
    return n + nans, found | {b.rank: b.value for b in brackets}

"""Exact zero-sum levelling of staff-to-denominator ratios, as relations.

Regions k have g_k heads, a denominator p_k and movable capacity per cadre. Wanted are whole
net changes n_k, summing to zero, that minimise sum |(g_k + n_k) / p_k - T|, T = sum g / sum p.
That is a separable convex allocation, for which taking the best unit first is optimal
(Gross 1956; Ibaraki and Katoh 1988). Units of equal worth form a segment, so every region
contributes at most three donor and three receiver segments, whatever its size:

    excess e = g - T p        donor                       receiver
    e > 0                     floor(e) units worth +1/p,  all units worth -1/p
                              one worth (2 frac - 1)/p,
                              the rest worth -1/p
    e < 0                     all units worth -1/p        as the donor above, with -e

Both sides are ordered by worth; the i-th best donor unit meets the i-th best receiver unit
while their worths add up to a gain. Worths are scaled by sum p and rounded to nine decimals
before they are compared, so the order does not hang on the last bit of a division.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.scalars import floor_cap, unpivot_measures
from plumbline.operators.joins import broadcast_if_short
from plumbline.operators.ordered import overlaps, running_total

_GAIN = 1e-9  # fixed value: smallest scaled gain for which a unit still moves
_WORTH_DIGITS = 9


def capacity(
    staff: DataFrame, ids: Sequence[str], cadres: Sequence[str], keep: int = 1
) -> DataFrame:
    """Wide cadre columns -> (ids, cadre, n, cap); ``cap`` leaves ``keep`` behind in each pair."""
    long = unpivot_measures(staff, ids, cadres)
    return long.withColumn("cap", floor_cap("n", keep))


def candidate_arcs(caps: DataFrame, problem: str, region: str) -> DataFrame:
    """The arcs a transfer may use, by their sending end: (region, cadre) with the upper bound
    every one of its arcs carries and the number of other regions it reaches.

    The pairs themselves are not written out; each sending end reaches all other regions.
    """
    regions = caps.select(problem, region).distinct().groupBy(problem).agg(F.count("*").alias("_n"))
    return caps.join(broadcast_if_short(regions), problem).select(
        problem, region, "cadre", F.col("cap").alias("upper_bound"), (F.col("_n") - 1).alias("targets")
    )


def _segments(excess: Column, weight: Column, room: Column) -> Column:
    """The up to three (worth, lo, hi) pieces of one side of a region, stacked from unit 0."""
    whole = F.floor(F.greatest(excess, F.lit(0.0))).cast("bigint")
    frac = F.greatest(excess, F.lit(0.0)) - whole
    first = F.least(whole, room)
    second = F.least(whole + F.when(frac > 0, F.lit(1)).otherwise(F.lit(0)), room)
    part = F.round((2 * frac - 1) * weight, _WORTH_DIGITS)
    full = F.round(weight, _WORTH_DIGITS)
    start = F.lit(0).cast("bigint")
    pieces = F.array(
        F.struct(full.alias("worth"), start.alias("s_lo"), first.alias("s_hi")),
        F.struct(part.alias("worth"), first.alias("s_lo"), second.alias("s_hi")),
        F.struct((-full).alias("worth"), second.alias("s_lo"), room.alias("s_hi")),
    )
    return F.filter(pieces, lambda s: s["s_hi"] > s["s_lo"])


def _placed(pieces: DataFrame, problem: str, order: Sequence[Column], slices: int | None) -> DataFrame:
    """Lay the pieces end to end along ``order``: half-open unit positions [lo, hi)."""
    total = running_total(pieces, [problem], order, "qty", "hi", slices)
    return total.withColumn("lo", F.col("hi") - F.col("qty"))


def transfers(
    regions: DataFrame,
    caps: DataFrame,
    problem: str = "problem",
    region: str = "region",
    total: str = "grand_total",
    denominator: str = "denominator",
    slices: int | None = None,
) -> DataFrame:
    """Edges (problem, cadre, from_region, to_region, headcount > 0) of an optimal levelling.

    ``regions`` has one row per region; ``caps`` one per (region, cadre) with ``cap``. A donor's
    units are dealt over its cadres in cadre order before the two sides meet, so each piece
    already carries its cadre and one merge suffices. With ``slices`` (see ``ordered``) no
    problem has to fit a single task.
    """
    sums = regions.groupBy(problem).agg(
        F.sum(total).alias("_g"), F.sum(denominator).cast("double").alias("_p")
    )
    room = caps.groupBy(problem).agg(F.sum("cap").alias("_room"))
    # Regions must not be shuffled by a problem id that may be one for all.
    totals = broadcast_if_short(sums.join(room, problem))
    base = regions.join(totals, problem).select(
        problem, region, "_room",
        F.round(F.col(total) - F.col("_g") / F.col("_p") * F.col(denominator), _WORTH_DIGITS).alias("_e"),
        (F.col("_p") / F.col(denominator)).alias("_w"),
    )

    stack = Window.partitionBy(problem, region).orderBy("cadre")
    stacked = (
        caps.where("cap > 0")
        .withColumn("_hi", F.sum("cap").over(stack.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_out", F.sum("cap").over(Window.partitionBy(problem, region)))
        .select(problem, region, "cadre", (F.col("_hi") - F.col("cap")).alias("_lo"), "_hi", "_out")
    )
    lo, hi = F.greatest("s_lo", "_lo"), F.least("s_hi", "_hi")
    donors = (
        base.join(stacked, [problem, region])
        .select(
            problem, region, "cadre", "_lo", "_hi",
            F.inline(_segments(F.col("_e"), F.col("_w"), F.col("_out"))),
        )
        .select(problem, region, "cadre", "worth", lo.alias("_at"), (hi - lo).alias("qty"))
        .where("qty > 0")
    )
    receivers = base.select(
        problem, region, F.inline(_segments(-F.col("_e"), F.col("_w"), F.col("_room")))
    ).select(problem, region, "worth", F.col("s_lo").alias("_at"), (F.col("s_hi") - F.col("s_lo")).alias("qty"))

    order = [F.col("worth").desc(), F.col(region).asc(), F.col("_at").asc()]
    give = _placed(donors, problem, order, slices).select(
        problem, F.col(region).alias(f"from_{region}"), "cadre", F.col("worth").alias("_wd"), "lo", "hi"
    )
    take = _placed(receivers, problem, order, slices).select(
        problem, F.col(region).alias(f"to_{region}"), F.col("worth").alias("_wr"), "lo", "hi"
    )
    met = overlaps(give, take, [problem], "lo", "hi", "headcount", slices)
    return (
        met.where(F.col("_wd") + F.col("_wr") > _GAIN)
        .groupBy(problem, "cadre", f"from_{region}", f"to_{region}")
        .agg(F.sum("headcount").alias("headcount"))
    )


def signed_moves(edges: DataFrame, keys: Sequence[str], region: str = "region") -> DataFrame:
    """Each edge as a departure (negative) and an arrival (positive)."""
    ends = F.array(
        F.struct(F.col(f"from_{region}").alias(region), (-F.col("headcount")).alias("delta")),
        F.struct(F.col(f"to_{region}").alias(region), F.col("headcount").alias("delta")),
    )
    return edges.select(*keys, F.inline(ends))


def net_change(
    edges: DataFrame, regions: DataFrame, problem: str = "problem", region: str = "region"
) -> DataFrame:
    """Outbound, inbound and net heads of every region; untouched regions stay with 0."""
    delta = F.col("delta")
    moved = (
        signed_moves(edges, [problem], region)
        .groupBy(problem, region)
        .agg(
            F.sum(F.greatest(-delta, F.lit(0))).alias("outbound"),
            F.sum(F.greatest(delta, F.lit(0))).alias("inbound"),
        )
    )
    out, into = F.coalesce("outbound", F.lit(0)), F.coalesce("inbound", F.lit(0))
    return (
        regions.select(problem, region)
        .join(moved, [problem, region], "left")
        .select(problem, region, out.alias("outbound"), into.alias("inbound"), (into - out).alias("net"))
    )

"""The zero-sum reallocation: whole heads to move so that staff-to-denominator ratios level out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import deviation, map_codes, population_proxy, ratio
from plumbline.operators import checks
from plumbline.operators.aggregates import target_ratio
from plumbline.operators.joins import broadcast_if_short, join_trimmed
from plumbline.operators.levelling import capacity, net_change, signed_moves, transfers
from plumbline.operators.ordered import MAX_GROUP_ROWS, slices_for
from plumbline.session import cut

# Outcome codes of a run and their labels. The exact method always ends with 0.
STATUS_LABELS = {
    0: "optimal_within_2pct_gap",
    1: "iteration_or_time_limit_reached",
    2: "infeasible",
    3: "unbounded",
    4: "other",
}
SUCCESS_LABELS = ("optimal_within_2pct_gap",)
RECONCILIATION_TOLERANCE = 0.05


def population_proxies(
    counts: DataFrame, densities: DataFrame, name: str, count: str, density: str, scale: float = 10000
) -> DataFrame:
    """Denominator of each name from its count and density; names with density 0 drop out."""
    both = join_trimmed(counts, densities, name)
    return both.where(F.col(density) > 0).withColumn(
        "population_proxy", population_proxy(count, density, scale)
    )


def levelling_input(
    staff: DataFrame,
    denominators: DataFrame | None = None,
    problem: str = "problem",
    region: str = "region",
    total: str = "grand_total",
    denominator: str = "denominator",
) -> DataFrame:
    """Regions with both a headcount and a denominator, their ratio, target and deviation.

    Without ``denominators`` the staff rows carry the denominator themselves. The joined rows are
    cut: here the plan turns from large facts to one row per region, and the target needs the
    rows a second time.
    """
    keys = [problem, region]
    rows = staff if denominators is None else staff.join(denominators.select(*keys, denominator), keys)
    rows = cut(rows.withColumn("ratio", ratio(total, denominator)))
    targets = target_ratio(rows, total, denominator, [problem])
    signed, absolute = deviation("ratio", "target_ratio")
    # One row per problem: regions must not be shuffled by a problem id that may be one for all.
    return rows.join(broadcast_if_short(targets), problem).withColumns({"deviation": signed, "abs_deviation": absolute})


def input_checks(
    rows: DataFrame, problem: str = "problem", region: str = "region", expected_rows: int | None = None
) -> list[checks.Check]:
    """What a levelling input must satisfy as a table: one row per region, complete columns and,
    if given, the expected number of regions, so that a region lost on the way is noticed."""
    todo = [
        *checks.primary_key(rows, [problem, region]),
        checks.not_null(rows, ["grand_total", "denominator", "ratio"]),
    ]
    return todo if expected_rows is None else [*todo, checks.row_count(rows, expected_rows)]


def _guarded(regions: DataFrame, cadres: Sequence[str], region: str) -> DataFrame:
    """Raise on a negative count or a denominator that is not positive, as the rows pass by."""
    ok = (F.col("denominator") > 0) & (F.col("grand_total") >= 0)
    for cadre in cadres:
        ok = ok & (F.col(cadre) >= 0)
    stop = F.raise_error(F.concat(F.lit("not a levelling input: region "), F.col(region).cast("string")))
    kind = regions.schema["grand_total"].dataType
    return regions.withColumn("grand_total", F.when(ok, F.col("grand_total")).otherwise(stop.cast(kind)))


@dataclass(frozen=True)
class Levelled:
    """A solved levelling; ``regions`` and ``edges`` are stored, so reading them is cheap."""

    regions: DataFrame
    caps: DataFrame
    edges: DataFrame


def level(
    regions: DataFrame,
    cadres: Sequence[str],
    problem: str = "problem",
    region: str = "region",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> Levelled:
    """Level each problem, moving heads of the named cadre columns only.

    The input is read several times and therefore cut; the size of the largest problem decides
    between plain windows and range-sliced ones.
    """
    regions = cut(_guarded(regions, cadres, region))
    caps = capacity(regions, [problem, region], cadres)
    slices = slices_for(caps, [problem], max_group_rows)
    return Levelled(regions, caps, cut(transfers(regions, caps, problem, region, slices=slices)))


def allocations(
    regions: DataFrame,
    edges: DataFrame,
    problem: str = "problem",
    region: str = "region",
    total: str = "grand_total",
    denominator: str = "denominator",
) -> DataFrame:
    """Before and after of every region, recomputed from the edges alone."""
    moved = net_change(edges, regions, problem, region).select(problem, region, "net")
    after = F.col(total) + F.col("net")
    return (
        regions.join(moved, [problem, region])
        .withColumns({"grand_total_after": after, "ratio_before": ratio(total, denominator)})
        .withColumn("ratio_after", ratio("grand_total_after", denominator))
        .select(
            problem, region, denominator, F.col(total).alias("grand_total_before"),
            "grand_total_after", "ratio_before", "ratio_after",
        )
    )


def verification(
    done: Levelled, problem: str = "problem", region: str = "region", n: str = "n", strict: bool = True
) -> list[checks.Check]:
    """Independent checks of a levelling, from its edges and the untouched inputs: every end is a known
    region and cadre, what known regions send they receive, and no pair gives more than it may."""
    ends = done.regions.select(problem, region)
    known = signed_moves(done.edges, [problem, "cadre"], region).join(ends, [problem, region])
    return [
        checks.known_ends(done.caps, done.edges, [problem, "cadre"], region),
        checks.zero_sum(known, [problem, "cadre"], "delta"),
        checks.floor_kept(done.caps, done.edges, [problem, "cadre"], region, n, strict),
        checks.rule(done.edges, "headcount <= 0", "error", "positive_edges"),
    ]


def run_summary(rows: DataFrame, problem: str = "problem", status: int = 0) -> DataFrame:
    """Variances and total deviation before and after, and the outcome label, per problem.

    Labels are the fixed ones of the published runs; the exact method ends with code 0, whose label
    speaks of a gap although there is none."""
    target = target_ratio(rows, "grand_total_before", "denominator", [problem])
    gap = lambda c: F.sum(F.abs(F.col(c) - F.col("target_ratio")))
    return (
        rows.join(broadcast_if_short(target), problem)
        .groupBy(problem)
        .agg(
            F.var_pop("ratio_before").alias("variance_before"),
            F.var_pop("ratio_after").alias("variance_after"),
            gap("ratio_before").alias("deviation_before"),
            gap("ratio_after").alias("deviation_after"),
            F.sum(F.greatest(F.col("grand_total_after") - F.col("grand_total_before"), F.lit(0)))
            .alias("heads_moved"),
        )
        .withColumn("solver_status", map_codes(F.lit(status), STATUS_LABELS))
    )


def verify(
    regions: DataFrame, caps: DataFrame, edges: DataFrame, problem: str = "problem",
    region: str = "region", n: str = "n", strict: bool = True,
) -> DataFrame:
    """Check edges from any source against the inputs; raise on a violation, else the
    before/after rows of all regions."""
    checks.enforce(verification(Levelled(regions, caps, edges), problem, region, n, strict))
    return allocations(regions, edges, problem, region)

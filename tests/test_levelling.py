import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.operators.levelling import candidate_arcs, net_change
from plumbline.plans import reallocation as plan

KEYS = ["problem", "region"]
CADRES = ["c1", "c2"]

# Published inputs of 26 regions as (heads, movable heads above the floor, facilities,
# facilities per 10,000 population).
REGIONS_26 = [
    (24, 8, 3, 0.38), (443, 186, 28, 1.47), (225, 71, 11, 0.5), (178, 82, 28, 2.54),
    (45, 8, 1, 0.08), (144, 15, 21, 2.21), (224, 38, 10, 0.69), (99, 35, 6, 0.6),
    (156, 73, 3, 0.17), (198, 71, 11, 0.77), (144, 44, 24, 2.4), (408, 151, 24, 0.72),
    (221, 33, 6, 0.44), (4, 2, 1, 0.08), (112, 36, 25, 1.68), (136, 30, 3, 0.2),
    (266, 107, 24, 1.72), (53, 17, 5, 0.48), (85, 31, 4, 0.32), (531, 160, 31, 0.47),
    (23, 8, 1, 0.12), (25, 0, 2, 0.22), (36, 7, 17, 1.17), (78, 0, 4, 0.29),
    (15, 6, 2, 0.17), (42, 18, 34, 5.23),
]


def solve(spark, data, max_group_rows=1_000_000):
    """data: (problem, region, grand_total, denominator, c1, c2)."""
    rows = spark.createDataFrame(
        data, "problem string, region string, grand_total long, denominator double, c1 long, c2 long"
    )
    staff, den = rows.drop("denominator"), rows.select(*KEYS, "denominator")
    inp = plan.levelling_input(staff, den)
    return plan.level(inp, CADRES, max_group_rows=max_group_rows)


def best_deviation(regions):
    """Smallest possible sum of deviations, by trying every net change."""
    target = sum(r[0] for r in regions) / sum(r[1] for r in regions)
    rooms = [sum(max(c - 1, 0) for c in r[2:]) for r in regions]
    top, best = sum(rooms), None
    for net in itertools.product(*[range(-f, top + 1) for f in rooms[:-1]]):
        last = -sum(net)
        if last < -rooms[-1]:
            continue
        cost = sum(
            abs((r[0] + n) / r[1] - target) for r, n in zip(regions, [*net, last], strict=True)
        )
        best = cost if best is None else min(best, cost)
    return best


def test_reaches_the_brute_force_optimum(spark):
    rng = random.Random(5)
    problems = {}
    for p in range(60):
        regions = []
        for _ in range(rng.choice([2, 3, 3])):
            c1, c2 = rng.randint(0, 4), rng.randint(0, 3)
            regions.append((c1 + c2 + rng.randint(0, 5), float(rng.randint(1, 30)), c1, c2))
        problems[f"p{p:02d}"] = regions
    data = [(p, f"r{i}", *r) for p, regions in problems.items() for i, r in enumerate(regions)]
    done = solve(spark, data)
    checks.enforce(plan.verification(done))
    summary = plan.run_summary(plan.allocations(done.regions, done.edges))
    got = {r.problem: r for r in summary.collect()}
    for p, regions in problems.items():
        assert got[p].deviation_after == pytest.approx(best_deviation(regions), abs=1e-9), p
        assert got[p].deviation_after <= got[p].deviation_before + 1e-12
    both = net_change(done.edges, done.regions).where("outbound > 0 and inbound > 0")
    assert both.count() == 0


def test_published_regions(spark):
    data = [
        ("state", f"r{i:02d}", heads, n / density * 10000, room + 1 if room else 0, 0)
        for i, (heads, room, n, density) in enumerate(REGIONS_26)
    ]
    done = solve(spark, data)
    checks.enforce(plan.input_checks(done.regions, expected_rows=26))
    rows = plan.verify(done.regions, done.caps, done.edges)
    run = plan.run_summary(rows).first()
    assert run.variance_before == pytest.approx(3.510086703597e-07, rel=1e-9)
    assert run.variance_after == pytest.approx(2.531321393e-08, rel=1e-8)
    assert run.deviation_before == pytest.approx(0.01309085885648, rel=1e-9)
    assert run.deviation_after == pytest.approx(0.00209811633140, rel=1e-9)
    assert run.heads_moved == 785
    assert rows.count() == 26
    target = done.regions.select("target_ratio").first()[0]
    assert target == pytest.approx(0.000967658359704, rel=1e-9)
    assert plan.STATUS_LABELS[0] == run.solver_status
    arcs = candidate_arcs(done.caps, *KEYS).agg(F.sum("targets"), F.sum("upper_bound")).first()
    assert arcs[:] == (26 * 25 * 2, 1237)
    checks.enforce([checks.improved(rows, "ratio_before", "ratio_after"), checks.row_count(rows, 26)])
    proxies = done.regions.select("denominator")
    checks.enforce([checks.reconcile(proxies, "denominator", 329.0 / 0.8 * 10000, plan.RECONCILIATION_TOLERANCE)])


def test_slices_change_nothing(spark):
    rng = random.Random(8)
    data = [
        ("big", f"r{i:03d}", rng.randint(5, 60), float(rng.choice([100, 100, 100, 150, 333])), rng.randint(0, 9), rng.randint(0, 9))
        for i in range(120)
    ] + [("small", "a", 10, 10.0, 5, 5), ("small", "b", 2, 10.0, 1, 1)]
    plain, sliced = solve(spark, data), solve(spark, data, max_group_rows=40)
    pick = lambda d: sorted(tuple(r) for r in d.edges.collect())
    assert pick(plain) == pick(sliced) and len(pick(plain)) > 20


def test_bad_input_is_refused(spark):
    for bad in [("p", "b", 4, 0.0, 1, 0), ("p", "b", -4, 9.0, 1, 0), ("p", "b", 4, 9.0, -1, 0)]:
        with pytest.raises(PySparkException):
            solve(spark, [("p", "a", 10, 100.0, 5, 0), bad])
    twice = spark.createDataFrame(
        [("p", "a", 1, 2.0, 0.5)] * 2, "problem string, region string, grand_total int, denominator double, ratio double"
    )
    with pytest.raises(checks.CheckFailed, match="unique"):
        checks.enforce(plan.input_checks(twice))
    with pytest.raises(checks.CheckFailed, match="row_count"):
        checks.enforce(plan.input_checks(twice.limit(1), expected_rows=26))


def test_nothing_to_move(spark):
    done = solve(spark, [("p", "a", 10, 100.0, 5, 0), ("p", "b", 20, 200.0, 9, 0)])
    assert done.edges.count() == 0
    rows = plan.allocations(done.regions, done.edges).collect()
    assert {(r.region, r.grand_total_before, r.grand_total_after) for r in rows} == {("a", 10, 10), ("b", 20, 20)}


def _case(spark, transfers):
    regions = spark.createDataFrame(
        [("p", "a", 10, 100.0), ("p", "b", 4, 100.0)], "problem string, region string, grand_total long, denominator double"
    )
    caps = spark.createDataFrame(
        [("p", "a", "c1", 3, 2), ("p", "b", "c1", 1, 0)], "problem string, region string, cadre string, n long, cap long"
    )
    edges = spark.createDataFrame(
        transfers, "problem string, cadre string, from_region string, to_region string, headcount long"
    )
    return regions, caps, edges


def test_verify_accepts_and_recomputes(spark):
    rows = plan.verify(*_case(spark, [("p", "c1", "a", "b", 2)])).orderBy("region").collect()
    assert [(r.grand_total_after, r.ratio_after) for r in rows] == [(8, 0.08), (6, 0.06)]


def test_planted_floor_violation_is_caught(spark):
    with pytest.raises(checks.CheckFailed, match="floor_kept"):
        plan.verify(*_case(spark, [("p", "c1", "a", "b", 3)]))


def test_inflow_may_only_make_up_for_outflow_when_not_strict(spark):
    case = _case(spark, [("p", "c1", "b", "a", 1), ("p", "c1", "a", "b", 1)])
    with pytest.raises(checks.CheckFailed, match="floor_kept"):
        plan.verify(*case)
    plan.verify(*case, strict=False)


def test_a_transfer_to_nowhere_breaks_the_zero_sum(spark):
    with pytest.raises(checks.CheckFailed, match="zero_sum"):
        plan.verify(*_case(spark, [("p", "c1", "a", "elsewhere", 1)]))


def test_proxies_drop_zero_density(spark):
    counts = spark.createDataFrame([(" A", 3), ("B", 2)], "place string, n int")
    densities = spark.createDataFrame([("A ", 0.5), ("B", 0.0)], "place string, d double")
    got = plan.population_proxies(counts, densities, "place", "n", "d").collect()
    assert [(r.place, r.population_proxy) for r in got] == [("A", 60000.0)]

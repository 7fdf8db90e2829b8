import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, grid, joins, latest, ordered


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_latest_wins_takes_newest_snapshot_then_newest_record(spark):
    df = spark.createDataFrame(
        [
            (1, "a", 2020, 10.0, 1, 1),  # superseded by a later fetch of record 1
            (1, "a", 2020, 11.0, 1, 2),
            (2, "a", 2020, 12.0, 1, 1),  # tie on updated: the higher record id wins
            (3, "a", 2021, 13.0, 9, 1),
            (4, "a", 2021, 14.0, 5, 1),
            (5, "b", 2020, None, 1, 1),
        ],
        "record int, key string, year int, value double, updated int, fetched int",
    )
    kept = latest.latest_wins(df, ["record"], "fetched", ["key", "year"], "updated")
    assert kept.columns == df.columns
    assert rows(kept.select("record", "value"), "record") == [(2, 12.0), (3, 13.0), (5, None)]


def test_steady_records_need_one_step_only(spark):
    rng = random.Random(2)
    owner = {r: (rng.choice("abc"), rng.choice([2020, 2021])) for r in range(40)}
    data, clock = [], {r: 0 for r in owner}
    for fetched in range(6):
        for r in rng.sample(sorted(owner), 20):
            clock[r] += rng.choice([0, 0, 1, 2])
            data.append((r, *owner[r], rng.random(), clock[r], fetched))
    df = spark.createDataFrame(data, "record int, key string, year int, value double, updated int, fetched int")
    args = (df, ["record"], "fetched", ["key", "year"], "updated")
    both = [rows(latest.latest_wins(*args, steady=s), "key", "year") for s in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 6


def test_latest_puts_null_last(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 3, "y")], "k int, o int, v string")
    assert rows(latest.latest_per_key(df, ["k"], ["o"])) == [(1, 3, "y")]


def test_conflict_profile(spark):
    df = spark.createDataFrame(
        [("a", 1, 2023), ("a", 1, 2023), ("b", 2, 2023), ("b", 3, 2023), ("a", 1, 2024)], "k string, r int, y int"
    )
    assert rows(latest.conflict_profile(df, ["k"], "r", "y"), "period") == [(2023, 2, 1), (2024, 1, 0)]


@pytest.mark.parametrize("max_axis", [grid.MAX_AXIS, 1])
def test_grids_are_the_same_either_way(spark, max_axis):
    ent = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "e int, name string")
    days = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 6)], "day date")
    counts = spark.createDataFrame(
        [(1, date(2024, 1, 2), 3), (1, date(2024, 1, 5), 1), (6, date(2024, 1, 1), 2), (99, date(2024, 1, 1), 9)],
        "e int, day date, n int",
    )
    full = rows(grid.dense_grid(ent, days, max_axis), "e", "day")
    assert len(full) == 35 and len(set(full)) == 35
    filled = rows(grid.filled_grid(ent, counts, days, "e", "n", max_axis), "e", "day")
    assert len(filled) == 35
    assert sum(r[3] for r in filled) == 6 and (1, "n1", date(2024, 1, 5), 1) in filled
    gaps = rows(grid.missing_pairs(ent.select("e"), days, counts, "e", max_axis), "e", "day")
    assert len(gaps) == 32 and (1, date(2024, 1, 2)) not in gaps and (0, date(2024, 1, 3)) in gaps


def test_expected_pairs(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([("x",), ("y",)], "b string")
    assert rows(grid.expected_pairs(a, b), "a", "b") == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


@pytest.mark.parametrize("size", [3, 70])
def test_reported_counts_with_bits_and_with_distinct(spark, size):
    facts = spark.createDataFrame(
        [("u", 1, 0), ("u", 1, 0), ("u", 1, 2), ("u", 2, 1), ("v", 1, 999)], "e string, p int, i int"
    )
    basket = spark.range(size).select(F.col("id").cast("int").alias("i"))
    assert rows(aggregates.reported_counts(facts, basket, ["e", "p"], "i"), "e", "p") == [("u", 1, 2), ("u", 2, 1)]


def test_empty_basket_reports_nothing(spark):
    facts = spark.createDataFrame([("u", 1)], "e string, i int")
    empty = spark.createDataFrame([], "i int")
    assert rows(aggregates.reported_counts(facts, empty, ["e"], "i")) == []


@pytest.mark.parametrize("slices", [None, 5])
def test_running_total_and_numbers(spark, slices):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.random(), rng.randint(1, 9)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, o double, q long")
    got = rows(ordered.running_total(df, ["k"], [F.col("o").asc()], "q", "t", slices), "k", "o")
    want, total = [], {}
    for k, o, q in sorted(data):
        total[k] = total.get(k, 0) + q
        want.append((k, o, q, total[k]))
    assert got == want
    ranks = rows(ordered.numbered(df, [F.col("o").desc()], "r", slices).select("o", "r"), "r")
    assert ranks == [(o, i + 1) for i, o in enumerate(sorted((d[1] for d in data), reverse=True))]


def _brute_overlaps(left, right):
    out = []
    for k, lo, hi, a in left:
        for k2, lo2, hi2, b in right:
            size = min(hi, hi2) - max(lo, lo2)
            if k == k2 and size > 0:
                out.append((k, a, b, size))
    return sorted(out)


@pytest.mark.parametrize("slices", [None, 4])
def test_overlaps_equal_brute_force(spark, slices):
    rng = random.Random(11)

    def chain(key):
        at, out = rng.randint(0, 3), []
        for i in range(rng.randint(1, 40)):
            size = rng.randint(1, 6)
            out.append((key, at, at + size, f"{key}{i}"))
            at += size + rng.choice([0, 0, 0, 2])
        return out

    left = [r for k in "xyz" for r in chain(k)]
    right = [r for k in "xyw" for r in chain(k)]
    schema = "k string, lo long, hi long, "
    got = ordered.overlaps(
        spark.createDataFrame(left, schema + "a string"),
        spark.createDataFrame(right, schema + "b string"),
        ["k"], "lo", "hi", "n", slices,
    )
    assert sorted(rows(got)) == _brute_overlaps(left, right)


def test_slices_for(spark):
    df = spark.range(10).withColumn("k", F.lit("a"))
    assert ordered.slices_for(df, ["k"]) is None
    assert ordered.slices_for(df, ["k"], 3) == 16
    assert ordered.slices_for(df.where("false"), []) is None


def test_previous_is_the_previous_row(spark):
    df = spark.createDataFrame([("a", 2015, 1.0), ("a", 2018, 2.0), ("b", 2018, 3.0)], "e string, y int, v double")
    got = ordered.with_previous(df, ["e"], "y", {"v": "pv", "y": "py"})
    assert rows(got, "e", "y") == [
        ("a", 2015, 1.0, None, None), ("a", 2018, 2.0, 1.0, 2015), ("b", 2018, 3.0, None, None)
    ]


def test_joins(spark):
    facts = spark.createDataFrame([(1, " a "), (2, "b"), (3, "c")], "i int, name string")
    dim = spark.createDataFrame([(1, "t"), (2, "u")], "i int, tag string")
    assert rows(joins.tag(facts, dim, "i"), "i") == [(1, " a ", "t"), (2, "b", "u")]
    assert rows(joins.untagged(facts, dim, "i")) == [(3, "c")]
    pop = spark.createDataFrame([("a", 5), ("b ", 6)], "name string, p int")
    assert rows(joins.join_trimmed(facts, pop, "name"), "name") == [("a", 1, 5), ("b", 2, 6)]
    assert rows(joins.unmatched_names(facts, pop, "name"), "name") == [(" a ",), ("b",), ("c",)]
    assert rows(joins.join_on_name(facts, pop, "name")) == []
    assert rows(joins.symmetric_diff(facts, dim.unionAll(dim), "i")) == [(3, "left")]
    assert rows(joins.missing_members(facts, dim, "i")) == [(3,)]
    scalar = dim.agg(F.max("i").alias("m"), F.count("*").alias("c"))
    assert rows(joins.with_scalar(facts, scalar), "i")[0] == (1, " a ", 2, 2)


def test_hierarchy_and_catalogue(spark):
    tree = spark.createDataFrame(
        [(1, "root", None, 1), (2, "state", 1, 2), (3, "local", 2, 3), (4, "district", 2, 5)],
        "location_id int, name string, parent_id int, level int",
    )
    assert rows(joins.children_at_level(tree, 2, 3).select("name")) == [("local",)]
    cat = spark.createDataFrame([(1, "s", True), (2, "s", None), (3, "t", True)], "i int, source string, f boolean")
    assert rows(joins.basket_from_catalogue(cat, "s", "f").select("i")) == [(1,)]


def test_bound_summary_keeps_clean_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, 120.0, 2020, True, False), ("a", 1, 130.0, 2021, True, True), ("a", 2, 90.0, 2022, False, False),
         ("b", 1, 50.0, 2020, False, False)],
        "e string, i int, v double, y int, is_impossible boolean, is_extreme boolean",
    )
    got = rows(aggregates.bound_summary(df, ["e"], "i", "v", "y"), "e")
    assert got == [("a", 2, 1, 1, 130.0, 2021, True), ("b", 0, 0, 0, None, None, False)]


def test_profile_and_quantiles(spark):
    values = [0.375, 0.42, 0.5, 0.583, 0.583, 0.833, None]
    df = spark.createDataFrame([(v,) for v in values], "f double")
    got = aggregates.profile(df, "f", 0.33, 0.1, below=True).first()
    assert (got["rows"], got.min_value, got.max_value, got.near_threshold, got.crossing) == (6, 0.375, 0.833, 2, 0)
    assert got.median_value == pytest.approx((0.5 + 0.583) / 2)
    exact = {r.q: r.value for r in aggregates.quantiles(df, "f", [0.0, 0.1, 1.0]).collect()}
    assert exact[0.0] == 0.375 and exact[1.0] == 0.833 and exact[0.1] == pytest.approx(0.3975)


def test_totals(spark):
    df = spark.createDataFrame([("a", 3, True), ("b", 1, False)], "k string, n int, f boolean")
    assert aggregates.subset_share(df, "n", F.col("k") == "a").first()[:] == (3.0, 4.0, 0.75)
    assert rows(aggregates.count_not(df, 2)) == [] and rows(aggregates.count_not(df, 3)) == [(2,)]
    got = rows(aggregates.column_sums(df, {"n": 4}, 3), "guard")
    assert got == [("n", 4.0, 4.0, True), ("row_count", 2.0, 3.0, False)]
    assert aggregates.target_ratio(df.withColumn("d", F.lit(8)), "n", "d").first()[0] == 0.25
    assert aggregates.headline(df.withColumn("score", F.col("n") - 1)).first()[:] == (2, 1, 2)
    assert aggregates.headline(df.where("false").withColumn("score", F.lit(1))).first()[:] == (0, 0, 0)

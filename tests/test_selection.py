"""Order statistics against sorting, with few values kept so that every branch is met; and global orders with ties."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, ordered, selection


def statistics(df, keep, ranks):
    return selection.order_statistics(df, "v", ranks, keep)


@pytest.mark.parametrize("shape", ["even", "ties", "skewed", "two", "long", "decimal"])
def test_equal_to_sorting(spark, shape):
    rng = random.Random(shape)
    n = 20_000
    values = {
        "even": lambda: [rng.random() for _ in range(n)],
        "ties": lambda: [rng.choice([0.5, 0.5, 0.5, rng.random(), -0.0]) for _ in range(n)],
        "skewed": lambda: [math.exp(rng.gauss(0, 9)) * rng.choice([1, -1]) for _ in range(n)],
        "two": lambda: [1.0] * (n // 2) + [2.0] * (n // 2),
        "long": lambda: [2**62 + rng.randrange(3_000) for _ in range(n)],
        "decimal": lambda: [Decimal(rng.randrange(10**20)).scaleb(-4) for _ in range(n)],
    }[shape]()
    kind = {"long": "long", "decimal": "decimal(30,4)"}.get(shape, "double")
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 7, f"v {kind}")
    asked = [0, 1, n // 10, n // 2 - 1, n // 2, n // 2 + 1, n - 2, n - 1]
    count, found = statistics(df, 500 if shape == "long" else 40, lambda _: asked)
    assert count == n and [found[k] for k in asked] == [sorted(values)[k] for k in asked]


def test_nan_is_largest(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, float("nan"), 1.0, None, float("inf"), float("nan")]], "v double")
    count, found = statistics(df, 1, lambda n: range(n))
    assert count == 5 and [found[k] for k in range(3)] == [1.0, 3.0, math.inf] and math.isnan(found[3]) and math.isnan(found[4])


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert statistics(df, 1, lambda n: [])[0] == 0
    assert aggregates.quantiles(df, "v", [0.5]).collect() == []


def test_quantiles_equal_percentile(spark):
    df = spark.range(300_000).select((F.rand(4) * 1e6).alias("v"))
    qs = [0.0, 0.1, 0.333, 0.5, 0.999, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, qs)))).first()[0]
    assert [r["value"] for r in aggregates.quantiles(df, "v", qs).orderBy("q").collect()] == pytest.approx(want, rel=1e-14)


def test_passes_neither_sort_nor_shuffle_values(spark):
    values = spark.range(10_000).select(F.rand(4).alias("x"))
    plan = selection.counted(values, [(None, None, None), (0.1, 0.9, (0.4, 0.5))])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("Exchange") == 1
    assert plan.index("partial_percentile_approx") > plan.index("Exchange")  # the plan's lower part comes last


def test_one_value_on_most_rows_is_dealt_over_slices(spark):
    rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(77).alias("o"), (F.col("id") % 3).alias("g"), F.lit(1).alias("q"))
    sized = [r["count"] for r in ordered._sliced(rows, [], [F.col("o").asc()], 8).groupBy("_slice").count().collect()]
    assert len(sized) == 8 and max(sized) <= 2 * 40_000 / 8
    got = ordered.numbered(rows, [F.col("o").asc()], "r", 8)
    want = ordered.numbered(rows, [F.col("o").asc()], "r", None)
    same = lambda df: df.groupBy("o").agg(F.min("r"), F.max("r"), F.sum("r")).orderBy("o").collect()
    assert same(got) == same(want)


def test_equal_rows_are_dealt_by_where_they_come_from(spark):
    rows = spark.range(0, 16_000, 1, 8).select(F.lit(5).alias("o"))
    sized = [r["count"] for r in ordered._sliced(rows, [], [F.col("o").asc()], 4).groupBy("_slice").count().collect()]
    assert max(sized) <= 2 * 16_000 / 4
    assert sorted(r["r"] for r in ordered.numbered(rows, [F.col("o").asc()], "r", 4).collect()) == list(range(1, 16_001))


def test_totals_of_doubles_do_not_depend_on_slices(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.choice([0.1, 1e9 + 0.3, -1e-7, 1e12 + 0.7, -1e12])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, o int, q double")
    plain = ordered.running_total(df, ["k"], [F.col("o").asc()], "q", "t", None).orderBy("o").collect()
    assert plain == ordered.running_total(df, ["k"], [F.col("o").asc()], "q", "t", 6).orderBy("o").collect()

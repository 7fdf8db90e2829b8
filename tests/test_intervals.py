"""Overlapping pairs against brute force: any lengths, hot bins, odd rows, and the plan."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import intervals

LEFT, RIGHT = "k string, a long, lo long, hi long", "k string, b long, lo long, hi long"


def brute(left, right):
    out = []
    for k, a, lo, hi in left:
        for q, b, at, to in right:
            if k is not None and k == q and None not in (lo, hi, at, to) and min(hi, to) > max(lo, at) and hi > lo and to > at:
                out.append((k, a, b, min(hi, to) - max(lo, at)))
    return sorted(out)


def pairs(spark, left, right, **how):
    return intervals.interval_pairs(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "lo", "hi", "met", **how)


def rows(rng, n, most):
    out = []
    for i in range(n):
        lo = rng.randrange(-300, 300)
        out.append((rng.choice("xy"), i, lo, lo + rng.choice([1, 2, 3, rng.randrange(1, most), 5 * most])))
    return out


@pytest.mark.parametrize("split_rows", [10**6, 15])
def test_random_lists(no_broadcast, split_rows):
    rng = random.Random(split_rows)
    left, right = rows(rng, 160, 40), rows(rng, 200, 9)
    left += left[:5] + [("x", 900, 3, 3), ("x", 901, 9, 2), (None, 902, 0, 9), ("x", 903, None, 9), ("x", 904, 0, None), ("x", 905, -(2**61), 2**61)]
    found = pairs(no_broadcast, left, right, split_rows=split_rows)
    assert sorted(map(tuple, found.collect())) == brute(left, right)


def test_empty_sides(spark):
    assert pairs(spark, [], [("x", 1, 0, 5)]).collect() == []
    assert pairs(spark, [("x", 1, 0, 5)], []).collect() == []


def test_equal_names_are_refused(spark):
    same = spark.createDataFrame([("x", 1, 0, 5)], LEFT)
    with pytest.raises(ValueError):
        intervals.interval_pairs(same, same, ["k"], "lo", "hi", "met")


def test_a_hot_bin_is_split(spark):
    """A third of all left rows and many right rows in one bin: no part holds more than a share, no pair is lost or doubled."""
    left = [("x", i, 8, 15) for i in range(600)] + [("x", i, 16 * i, 16 * i + 5) for i in range(1, 1200)]
    right = [("x", i, 9 + i % 3, 14) for i in range(90)]
    a = intervals.entered(intervals._sized(spark.createDataFrame(left, LEFT), ["k"], "lo", "hi", "l"), "l", F.array("_ownl"))
    b = intervals.entered(intervals._sized(spark.createDataFrame(right, RIGHT), ["k"], "lo", "hi", "r"), "r", F.array(F.lit(3)))
    one, two, on = intervals.split(a, b, ["k"], 50)
    assert one.groupBy(*on).count().agg(F.max("count")).first()[0] <= 100
    assert two.groupBy(*on).count().agg(F.max("count")).first()[0] <= 100
    found = pairs(spark, left, right, split_rows=50)
    assert sorted(map(tuple, found.collect())) == brute(left, right)


def test_plan_has_no_nested_loop_and_work_follows_the_result(no_broadcast):
    n = 20_000
    left = no_broadcast.range(n).select(F.lit("x").alias("k"), F.col("id").alias("a"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 12).alias("hi"))
    right = left.withColumnRenamed("a", "b")
    found = intervals.interval_pairs(left, right, ["k"], "lo", "hi", "met")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 3 * n - 2
    a = intervals.entered(intervals._sized(left, ["k"], "lo", "hi", "l"), "l", F.array("_ownl"))
    most = a.groupBy("_level", "_bin").count().agg(F.max("count")).first()[0]
    assert most <= 4

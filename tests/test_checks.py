import pytest
from pyspark.sql import functions as F, types as T

from plumbline.operators import checks as Q


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [("a", 1, 10.0), ("b", 2, -1.0), ("b", 3, 0.0), (None, 4, None)], "k string, n int, v double"
    )


def failing(check):
    return check.failing.count()


def test_each_check_finds_its_defect(spark, df):
    assert failing(Q.unique(df, ["k"])) == 1 and failing(Q.unique(df, ["n"])) == 0
    assert failing(Q.not_null(df, ["k", "v"])) == 1
    assert [failing(c) for c in Q.primary_key(df, ["k"])] == [1, 1]
    assert failing(Q.in_range(df, "v", 0)) == 1 and failing(Q.in_range(df, "v", 0, strict=True)) == 2
    assert failing(Q.in_domain(df, "k", ["a", "b"])) == 1
    assert failing(Q.row_count(df, 4)) == 0 and failing(Q.row_count(df, 5)) == 1
    assert failing(Q.non_empty(df)) == 0 and failing(Q.non_empty(df.where("false"))) == 1
    parent = spark.createDataFrame([("a",)], "k string")
    assert failing(Q.foreign_key(df, parent, "k")) == 1
    assert failing(Q.reconcile(df, "n", 10.4, 0.05)) == 0 and failing(Q.reconcile(df, "n", 11.0, 0.05)) == 1
    members = spark.createDataFrame([("a",), ("z",)], "k string")
    found = {tuple(r) for r in Q.coverage(df, "k", members, ["b"]).failing.collect()}
    assert found == {("z", "missing"), ("b", "excluded")}
    assert failing(Q.zero_sum(df.withColumn("q", F.lit(1)), ["k"], "q")) == 3
    pairs = spark.createDataFrame([(1.0, 2.0), (5.0, 3.0)], "b double, a double")
    assert failing(Q.improved(pairs, "b", "a")) == 0 and failing(Q.improved(pairs, "a", "b")) == 1


def test_tables_agree(spark):
    a = spark.createDataFrame([(1, "x", 0.05), (2, "y", None), (3, "z", 0.04)], "id int, name string, f double")
    assert failing(Q.tables_agree(a, a, ["id"], ["name", "f"])) == 0
    b = spark.createDataFrame([(1, "x", 0.04), (2, "why", None), (4, "w", 0.1)], "id int, name string, f double")
    got = {r.id: r.problem for r in Q.tables_agree(a, b, ["id"], ["name", "f"]).failing.collect()}
    assert got == {1: "differs: f", 2: "differs: name", 3: "only in left", 4: "only in right"}


def test_severity_decides_between_report_and_stop(df):
    warn = Q.rule(df, "v < 0", "warn", "negative")
    assert Q.enforce([warn, Q.unique(df, ["n"])]) == [("negative", 1)]
    with pytest.raises(Q.CheckFailed, match=r"unique\(k\): 1 failing, e.g. b\|2"):
        Q.enforce([warn, Q.unique(df, ["k"])])
    with pytest.raises(ValueError):
        Q.rule(df, "v < 0", "fatal", "x")


def test_reports(df):
    got = Q.report([Q.rule(df, "v < 0", "warn", "negative"), Q.unique(df, ["n"])]).collect()
    assert [tuple(r) for r in got] == [("negative", "warn", 1, "b|2|-1.0"), ("unique(n)", "error", 0, None)]
    rules = {"negative": (F.col("v") < 0, "warn"), "no key": (F.col("k").isNull(), "error")}
    got = Q.rule_report(df, rules, ["n"]).collect()
    assert [tuple(r) for r in got] == [("negative", "warn", 1, "2"), ("no key", "error", 1, "4")]


def test_exact_schema(df):
    fields = [T.StructField("v", T.DoubleType()), T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())]
    Q.exact_schema(df, T.StructType(fields))
    for bad in (fields[:2], [*fields, T.StructField("x", T.LongType())], [*fields[:2], T.StructField("n", T.LongType())]):
        with pytest.raises(Q.CheckFailed):
            Q.exact_schema(df, T.StructType(bad))

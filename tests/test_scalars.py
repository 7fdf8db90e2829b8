from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from plumbline.functions import scalars as S, text


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(
    "label,year",
    [("2024", 2024), (" 2024 ", 2024), (" 2024\n", 2024), ("Jun 2026", None), ("2014", None),
     ("2026", None), ("20244", None), ("", None), (None, None), ("2015", 2015), ("2025", 2025)],
)
def test_parse_year(spark, label, year):
    assert one(spark, label, "string", S.parse_year("x", 2015, 2025)) == year


def test_trim_is_blanks_only_and_strip_is_all(spark):
    df = spark.createDataFrame([("\t a ",)], "x string")
    assert S.trim_keys(df, ["x"]).first()[0] == "\t a"
    assert df.select(S.strip("x")).first()[0] == "a"


def test_coerce_raises_or_quarantines(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", None)], "a string, b string")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    with pytest.raises(PySparkException):
        S.coerce(df, schema).collect()
    rows = S.coerce(df, schema, "quarantine").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, False), (None, None, True)]
    with pytest.raises(ValueError):
        S.coerce(df, schema, "ignore")


def test_fractions_and_drops(spark):
    df = spark.createDataFrame(
        [(1, 24, 0.8, 0.4), (None, 24, 0.0, 0.5), (3, 0, None, 0.5), (1, 32, 0.0032, 0.0031)],
        "n int, size int, prev double, cur double",
    )
    rows = df.select(S.safe_fraction("n", "size"), S.relative_drop("prev", "cur")).collect()
    # 1/32 and 1/32 again: both end in a 5 and go up, as decimals do.
    assert [tuple(r) for r in rows] == [(0.0417, 0.5), (0.0, None), (None, None), (0.0313, 0.0313)]


def test_bounds(spark):
    df = spark.createDataFrame(
        [(100.0, 1000.0, 0.05), (100.1, 1000.0, 0.05), (2000.0, 1000.0, 0.05), (2000.1, 1000.0, 0.05)],
        "v double, q double, f double",
    )
    flags = df.select(*S.bound_flags("v", "q", "f"), *S.implied_counts("v", "q", "f")).collect()
    assert [tuple(r)[:2] for r in flags] == [(False, False), (True, False), (True, False), (True, True)]
    assert tuple(flags[1])[2:] == (50.0, 50.1)


def test_proxy_and_floor(spark):
    df = spark.createDataFrame([(28, 1.47, 5), (3, 0.0, 1), (1, 1.0, 0)], "n int, d double, c int")
    rows = df.select(S.population_proxy("n", "d"), S.floor_cap("c")).collect()
    assert rows[0][0] == pytest.approx(28 / 1.47 * 10000)
    assert rows[1][0] is None
    assert [r[1] for r in rows] == [4, 0, 0]


def test_flags_stay_unknown_and_score_counts_them_as_zero(spark):
    df = spark.createDataFrame(
        [(0.2, None), (0.5, None), (0.5, 0.5), (0.33, 0.49), (None, None)], "f double, d double"
    )
    below, sharp, either = S.attrition_flags("f", "d", 0.33, 0.5)
    rows = df.select(either, S.weighted_score([(either, 3), (F.lit(2), 1), (F.lit(None).cast("int"), 2)])).collect()
    assert [r[0] for r in rows] == [True, None, True, False, None]
    assert [r[1] for r in rows] == [5, 2, 5, 2, 2]


def test_reasons(spark):
    df = spark.createDataFrame([(True, 39754.0), (False, 12345678.25), (None, 0.5)], "a boolean, v double")
    text_ = S.reasons([(F.col("a"), "first %s%%", [S.plain_number("v")]), (F.col("v") > 1, "second", [])])
    assert [r[0] for r in df.select(text_).collect()] == ["first 39754%; second", "second", ""]
    assert [r[0] for r in df.select(S.plain_number("v")).collect()] == ["39754", "12345678.25", "0.5"]
    assert one(spark, 58.35, "double", S.one_decimal("x")) == "58.4"


def test_to_integral(spark):
    assert one(spark, 2.9999999, "double", S.to_integral("x")) == 3
    assert one(spark, None, "double", S.to_integral("x")) is None
    with pytest.raises(PySparkException, match="not integral"):
        one(spark, 2.5, "double", S.to_integral("x"))


def test_codes_and_domain(spark):
    labels = {0: "ok", 1: "late"}
    assert [one(spark, n, "int", S.map_codes("x", labels)) for n in (0, 1, 7)] == ["ok", "late", "unknown_status_7"]
    assert [one(spark, v, "string", S.check_domain("x", ["a"])) for v in ("a", "b", None)] == [True, False, False]


def test_display(spark):
    assert one(spark, 1234567.0, "double", S.fmt_thousands("x")) == "1,234,567"
    assert one(spark, None, "double", S.fmt_thousands("x")) == ""
    assert one(spark, 0.5833, "double", S.fmt_percent("x")) == "58.3%"
    assert one(spark, None, "boolean", S.fmt_yes_no("x")) == "no"
    assert one(spark, 0.00096765836, "double", S.fmt_six_decimals("x")) == "0.000968"
    assert one(spark, 3, "int", S.pct_of_max("x", F.lit(7))) == 42.9
    assert one(spark, 3, "int", S.pct_of_max("x", F.lit(0))) == 0.0
    at = datetime(2025, 1, 31, 23, 59, 58, tzinfo=timezone.utc)
    assert one(spark, at, "timestamp", S.utc_stamp("x")) == "20250131T235958Z"
    assert one(spark, at, "timestamp", S.utc_display("x")) == "2025-01-31 23:59 UTC"


def test_small_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 2, 3)], "id int, a double, x int, y int")
    assert S.project(df, {"key": "id", "twice": F.col("a") * 2}).first().asDict() == {"key": 1, "twice": 20.0}
    assert df.select(*S.deviation("a", F.lit(12.0))).first()[:] == (-2.0, 2.0)
    assert df.select(S.pct_diff("a", F.lit(8.0)), S.ratio("x", "a")).first()[:] == (0.25, 0.2)
    long = S.unpivot_measures(df, ["id"], ["x", "y"]).collect()
    assert sorted(tuple(r) for r in long) == [(1, "x", 2), (1, "y", 3)]
    stamped = S.stamp(df, "src", datetime(2025, 1, 1, tzinfo=timezone.utc)).first()
    assert stamped.source_label == "src" and stamped.fetched_at is not None


def test_markup(spark):
    html = "<p>a<b> bold </b> \n<script>x()</script>&amp; c</p>"
    assert one(spark, html, "string", text.visible_text("x")) == " a bold x() &amp; c "
    assert one(spark, "<a href=\"x\">'&'</a>", "string", text.html_escape("x")) == (
        "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    )


def test_links_and_pairs(spark):
    page = '<link href="/js/chunk.1.js"><script src="/js/app.2.js"></script><script src="/js/chunk.1.js">'
    found = text.extract_links("x", r'(?:src|href)="(/js/[^"]+\.js)"', "/js/app.", F.lit("https://h/"))
    assert one(spark, page, "string", found) == ["https://h/js/app.2.js", "https://h/js/chunk.1.js"]
    pair = text.extract_pair("x", 'A"?:"([^"]+)"', 'B"?:"([^"]+)"')
    assert tuple(one(spark, 'A:"1",B":"2",A:"3"', "string", pair)) == ("1", "2")
    assert one(spark, 'A:"1"', "string", pair) is None

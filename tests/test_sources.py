import json
import tempfile
import zipfile
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from plumbline.operators import checks
from plumbline.plans import report
from plumbline.session import cut, scratch_path, shared_folder
from plumbline.sources import readers, writers

AT = datetime(2025, 3, 1, 8, 30, 0, 250000, tzinfo=UTC)
LATER = datetime(2025, 3, 1, 8, 30, 1, tzinfo=UTC)


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def schema(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


STANDARD = schema(("standard", T.StringType(), False), ("per_site", T.IntegerType(), False))


def test_commented_csv(spark, folder):
    path = folder / "s.csv"
    path.write_text(
        '# cited from a report\n  # and a second line\nper_site,standard\n4,Nurse\n\n# in between\n'
        '5,"Support (Assistant (2), Security (2))"\n1,"say ""hi"" #1"\n'
    )
    got = readers.read_commented_csv(spark, str(path), STANDARD).orderBy("per_site").collect()
    assert [tuple(r) for r in got] == [
        ('say "hi" #1', 1), ("Nurse", 4), ("Support (Assistant (2), Security (2))", 5)
    ]


@pytest.mark.parametrize(
    "body,error",
    [("standard,per_site,extra\na,1,2\n", checks.CheckFailed), ("standard\na\n", checks.CheckFailed),
     ("standard,renamed\na,1\n", checks.CheckFailed), ("standard,per_site\na,many\n", Exception),
     ("standard,per_site\na,\n", PySparkException), ("# nothing\n", checks.CheckFailed)],
)
def test_commented_csv_stops_on_bad_input(spark, folder, body, error):
    path = folder / "s.csv"
    path.write_text(body)
    with pytest.raises(error):
        readers.read_commented_csv(spark, str(path), STANDARD).collect()


def test_seed(spark, folder):
    path = folder / "seed.csv"
    path.write_text('id,name,flag,fraction,note\n16,"Rate (<5 years, site)",true,,\n5,Visit,true,0.05,5% of all\n')
    kinds = schema(("id", T.IntegerType(), True), ("name", T.StringType(), True), ("flag", T.BooleanType(), True),
                   ("fraction", T.DoubleType(), True), ("note", T.StringType(), True))
    got = [tuple(r) for r in readers.read_seed(spark, str(path), kinds).orderBy("id").collect()]
    assert got == [(5, "Visit", True, 0.05, "5% of all"), (16, "Rate (<5 years, site)", True, None, None)]


def test_zip_member(spark, folder):
    for i, rows in enumerate(["North, Daura ,10.5,9,12\nKano,Bichi,1,1,1\n", " North ,Zango,3,2,4\n"]):
        with zipfile.ZipFile(folder / f"{i}.zip", "w") as z:
            z.writestr("adm/level3.csv", "state,local,mean,q025,q975\n" + rows)
    rename = {"state": "state", "local": "name", "mean": "population_mean", "q975": "population_q975"}
    got = readers.load_population_snapshot(
        spark, str(folder), "adm/level3.csv", ("state", "North"), rename, "census", AT
    )
    assert [tuple(r)[:5] for r in got.orderBy("name").collect()] == [
        ("North", "Daura", 10.5, 12.0, "census"), ("North", "Zango", 3.0, 4.0, "census")
    ]
    assert checks.enforce([checks.row_count(got, 34, "warn")]) == [("row_count", 1)]


def test_pages(spark, folder):
    def result(i, period, value="1.5"):
        return {"id": i, "period": period, "value": value, "updated_at": "2025-01-02T03:04:05Z"}

    periods = ["2024", " 2024 ", "Jun 2026", "2014", "2026", "20244", ""]
    pages = [
        dict(indicator_id=5, datasource_id=6, location_id=1, fetched_at="2025-03-01T00:00:00Z",
             results=[result(i, p) for i, p in enumerate(periods)]),
        dict(indicator_id=5, datasource_id=6, location_id=2, fetched_at="2025-03-01T00:00:00Z", results=[]),
    ]
    (folder / "p.json").write_text("\n".join(json.dumps(p) for p in pages))
    landed = readers.read_pages(spark, str(folder / "p.json"))
    indicators = spark.createDataFrame([(5, "visits")], "indicator_id int, indicator_name string")
    entities = spark.createDataFrame([(1, "A"), (2, "B")], "location_id int, location_name string")
    got = readers.load_observation_pages(landed, indicators, entities, (2015, 2025)).orderBy("record_id").collect()
    assert [(r.record_id, r.year, r.value, r.location_name) for r in got] == [(0, 2024, 1.5, "A"), (1, 2024, 1.5, "A")]
    assert readers.full_pages(landed, 7).failing.count() == 1
    for value in ("n/a", None):
        wrong = F.transform("results", lambda r: r.withField("value", F.lit(value).cast("string")))  # noqa: B023
        with pytest.raises(PySparkException):
            bad = landed.withColumn("results", wrong)
            readers.load_observation_pages(bad, indicators, entities, (2015, 2025)).collect()


def test_append_if_absent(spark):
    df = spark.createDataFrame([(1, "d1", "x"), (2, "d1", "y"), (2, "d1", "y")], "id int, day string, v string")
    target = scratch_path(spark, "t")
    assert writers.append_if_absent(df, target, ["id", "day"], ["day"]) == 2
    more = spark.createDataFrame([(1, "d1", "changed"), (1, "d2", "new")], "id int, day string, v string")
    assert writers.append_if_absent(more, target, ["id", "day"], ["day"]) == 1
    assert writers.append_if_absent(more, target, ["id", "day"], ["day"]) == 0
    got = {tuple(r) for r in spark.read.parquet(target).select("id", "day", "v").collect()}
    assert got == {(1, "d1", "x"), (2, "d1", "y"), (1, "d2", "new")}
    with pytest.raises(ValueError):
        writers.append_if_absent(more, target, ["id"], ["day"])


def test_reload_validates_everything_before_the_first_write(spark):
    a = spark.createDataFrame([(1,), (2,)], "n int")
    root = scratch_path(spark, "r")
    assert writers.reload_tables({"a": a, "b": a}, root, AT) == {"a": 2, "b": 2}
    assert writers.reload_tables({"a": a.where("n = 1"), "b": a}, root, LATER) == {"a": 1, "b": 2}
    assert writers.read_table(spark, root, "a").count() == 1
    with pytest.raises(checks.CheckFailed):
        writers.reload_tables({"a": a, "b": a.where("false")}, root, datetime(2026, 1, 1, tzinfo=UTC))
    with pytest.raises(checks.CheckFailed):
        rule = checks.in_range(a, "n", 2)
        writers.reload_tables({"a": a}, root, datetime(2026, 1, 1, tzinfo=UTC), [rule])
    assert writers.read_table(spark, root, "a").count() == 1
    with pytest.raises(LookupError):
        writers.read_table(spark, root, "c")


def test_snapshot(spark, folder):
    df = spark.createDataFrame([(1, 'a,"b"', AT)], "id int, s string, at timestamp")
    path = writers.write_snapshot_csv(df, str(folder), "obs", AT)
    assert path.endswith("/obs_20250301T083000Z")
    lines = [f.read_text() for f in Path(path).glob("*.csv")]
    assert [text for text in lines if text != "id,s,at\n"] == ['id,s,at\n1,"a,""b""",2025-03-01T08:30:00.250000+00:00\n']


def test_runs(spark):
    root = scratch_path(spark, "runs")
    with pytest.raises(LookupError):
        writers.read_latest_run(spark, root)
    edges = spark.createDataFrame([("c", "b", "a", 2), ("c", "a", "b", 1)], "cadre string, from_region string, to_region string, headcount int")
    alloc = spark.createDataFrame([("b", 1), ("a", 2)], "region string, grand_total_after int")
    head = spark.createDataFrame([(2.0, 1.0, "optimal_within_2pct_gap")], "variance_before double, variance_after double, solver_status string")
    assert writers.write_run(edges, alloc, head, root, LATER) == {"transfers": 2, "allocations": 2, "runs": 1}
    assert writers.write_run(edges.where("false"), alloc, head, root, AT)["transfers"] == 0  # an older run
    summary, moved, rows = writers.read_latest_run(spark, root)
    assert [r.from_region for r in moved.collect()] == ["a", "b"]
    assert [r.region for r in rows.collect()] == ["a", "b"]
    shown = report.run_table(summary).first()
    assert shown.run_at_text == "2025-03-01 08:30 UTC" and shown.improved == "improved" and shown.succeeded
    runs = spark.read.parquet(f"{root}/runs").select("run_id")
    assert checks.foreign_key(spark.read.parquet(f"{root}/transfers"), runs, "run_id").failing.count() == 0


def test_mart(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "k string, v double")
    path = scratch_path(spark, "mart")
    assert writers.publish(df, "mart_view", "view") is df and spark.table("mart_view").count() == 2
    writers.publish(df, "mart", "table", path)
    kinds = schema(("v", T.DoubleType(), False), ("k", T.StringType(), False))
    assert [tuple(r) for r in readers.read_mart(spark, path, kinds, ["k"], rows=2).collect()] == [(2.0, "a"), (1.0, "b")]
    with pytest.raises(checks.CheckFailed):
        readers.read_mart(spark, path, kinds, ["k"], rows=3)
    with pytest.raises(checks.CheckFailed):
        readers.read_mart(spark, path, schema(("k", T.StringType(), False)), ["k"])
    with pytest.raises(ValueError):
        writers.publish(df, "x", "index")


def test_cut_keeps_rows_and_drops_lineage(spark):
    df = cut(spark.range(5).where("id > 1"))
    assert df.count() == 3
    assert "Range" not in df._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert shared_folder(spark)

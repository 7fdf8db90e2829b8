"""Landing jobs end to end, the defects that stop them, and a late pull that changes the scorecard."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import types as T

from plumbline.operators import checks
from plumbline.plans import jobs, landing
from plumbline.session import scratch_path
from plumbline.sources import writers

AT = datetime(2025, 6, 1, tzinfo=UTC)


def pages(folder, values, fetched, drop=()):
    folder.mkdir()
    lines = []
    for e in range(3):
        for i in (1, 2):
            if (e, i) in drop:
                continue
            results = [
                {"id": 1000 * e + 100 * i + y, "period": f" {2000 + y} ", "value": values.get((e, i, y), "80"), "updated_at": "2025-05-01 00:00:00"}
                for y in (23, 24)
            ] + [{"id": 9, "period": "Jun 2024", "value": "1", "updated_at": "2025-05-01 00:00:00"}]
            lines.append(json.dumps({"indicator_id": i, "datasource_id": 6, "location_id": e, "fetched_at": fetched.isoformat(), "results": results}))
    (folder / "part.json").write_text("\n".join(lines))
    return str(folder)


@pytest.fixture(scope="module")
def dims(spark):
    indicators = spark.sql(
        "select * from values (1, 'one', true, true, 0.05D), (2, 'two', true, false, cast(null as double)) "
        "as t(indicator_id, indicator_name, in_reporting_basket, in_impossibility_test, population_fraction)"
    )
    entities = spark.createDataFrame([(i, f"E{i}") for i in range(3)], "location_id int, location_name string")
    return indicators, entities


def test_landing_and_a_late_pull(spark, dims, tmp_path):
    indicators, entities = dims
    target, snapshots, root = (scratch_path(spark, n) for n in ("obs", "snapshots", "audit"))
    population = spark.createDataFrame([(f"E{i}", 1000.0, 1200.0, AT) for i in range(3)], "location_name string, population_mean double, population_q975 double, fetched_at timestamp")

    def land(folder, at):
        return landing.land_observations(spark, folder, indicators, entities, target, snapshots, at, (2015, 2025), 3)

    def scores():
        jobs.audit_job(spark.read.parquet(target), population, entities, indicators, root, AT)
        return {r.location_name: r.score for r in writers.read_table(spark, root, "scorecard").collect()}

    first = land(pages(tmp_path / "one", {(1, 1, 24): "150"}, AT, drop={(2, 2)}), AT)
    assert first.new_rows == 10 and first.findings == [("full_pages", 5)]
    assert [tuple(r) for r in first.failed_pairs.collect()] == [(2, 2)]
    assert spark.read.csv(first.snapshot, header=True).count() == 10
    assert land(str(tmp_path / "one"), AT).new_rows == 0
    before = scores()
    later = AT + timedelta(days=3)
    assert land(pages(tmp_path / "two", {(0, 1, 24): "150"}, later), later).new_rows == 12
    after = scores()
    assert before["E1"] > 0 == before["E0"] and after["E0"] > 0 == after["E1"]


def test_landing_without_rows_or_with_bad_values_stores_nothing(spark, dims, tmp_path):
    target = scratch_path(spark, "obs")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "p.json").write_text(json.dumps({"indicator_id": 1, "datasource_id": 6, "location_id": 1, "fetched_at": AT.isoformat(), "results": []}))
    for folder, error in ((str(tmp_path / "none"), checks.CheckFailed), (pages(tmp_path / "bad", {(0, 1, 24): "many"}, AT), Exception)):
        with pytest.raises(error):
            landing.land_observations(spark, folder, *dims, target, scratch_path(spark, "s"), AT, (2015, 2025), 100)
        assert not writers.exists(spark, target)


def test_inputs_load_together_or_not_at_all(spark, tmp_path):
    counts = T.StructType([T.StructField("place", T.StringType(), False), T.StructField("n", T.IntegerType(), False)])
    (tmp_path / "a.csv").write_text("# cited\nplace,n\nX,1\n  # more\nY,2\n")
    (tmp_path / "b.csv").write_text("n,place\n7,X\n")
    inputs = {name: landing.Input(str(tmp_path / f"{name}.csv"), counts, landing.counts_not_negative("n")) for name in "ab"}
    root = scratch_path(spark, "inputs")
    assert landing.load_inputs(spark, inputs, root, AT) == {"a": 2, "b": 1}
    for text, message in (("n,place\n-7,X\n", "in_range"), ("n,place\nseven,X\n", r"b\.csv: malformed row: seven,X"), ("n\n7\n", "missing columns"), ("n,place\n", "has rows")):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(Exception, match=message):
            landing.load_inputs(spark, inputs, root, AT + timedelta(days=1))
        assert [tuple(r) for r in writers.read_table(spark, root, "b").collect()] == [("X", 7)]

"""Both jobs from files to stored results, and the defects that must stop them."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans import jobs
from plumbline.session import scratch_path
from plumbline.sources import readers, writers

AT = datetime(2025, 6, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def world(spark):
    indicators = spark.sql(
        "select * from values (1, true, true, 0.05D), (2, true, false, cast(null as double)) "
        "as t(indicator_id, in_reporting_basket, in_impossibility_test, population_fraction)"
    )
    entities = spark.createDataFrame([(i, f"E{i}") for i in range(4)], "location_id int, location_name string")
    population = entities.where("location_id < 3").select(
        F.concat("location_name", F.lit(" ")).alias("location_name"),
        F.lit(1000.0).alias("population_mean"), F.lit(1200.0).alias("population_q975"), F.lit(AT).alias("fetched_at"),
    )
    rows = []
    for e in range(3):
        for year in (2023, 2024):
            for i in (1, 2):
                if not (e == 2 and year == 2024):  # E2 stops reporting
                    rows.append((len(rows), i, e, f"E{e}", year, 150.0 if (e, i, year) == (1, 1, 2024) else 80.0, AT, AT))
    obs = spark.createDataFrame(
        rows,
        "record_id int, indicator_id int, location_id int, location_name string, year int, value double, "
        "updated_at timestamp, fetched_at timestamp",
    )
    return obs, population, entities, indicators


@pytest.mark.parametrize("steady", [False, True])
def test_audit_job(spark, world, steady):
    root = scratch_path(spark, "audit")
    found = jobs.audit_job(*world, root, AT, steady=steady)
    assert found == [("attrition_findings", 2), ("impossibility_findings", 1)]
    card = writers.read_table(spark, root, "scorecard").orderBy("location_id").collect()
    assert [r.score for r in card] == [0, 1, 3, 3]
    assert [r.attrition_flag for r in card] == [False, False, True, True]
    assert writers.read_table(spark, root, "attrition").count() == 4


def test_audit_job_stores_nothing_from_bad_input(spark, world):
    obs, population, entities, indicators = world
    root = scratch_path(spark, "audit")
    with pytest.raises(checks.CheckFailed, match="observations"):
        jobs.audit_job(obs.where("false"), population, entities, indicators, root, AT)
    with pytest.raises(checks.CheckFailed, match="unique"):
        jobs.audit_job(obs, population, entities.unionAll(entities), indicators, root, AT)
    assert not writers.exists(spark, f"{root}/_manifest")


def _inputs(spark):
    staff = spark.createDataFrame(
        [("A", 30, 12, 4), ("B ", 10, 3, 0), ("C", 8, 1, 1)], "region string, grand_total int, nurse int, officer int"
    )
    counts = spark.createDataFrame([("A", 4), (" B", 4), ("C", 3)], "region string, facility_count int")
    densities = spark.createDataFrame(
        [("A", 2.0), ("B", 1.0), ("C", 1.5)], "region string, density_per_10k_population double"
    )
    return staff, counts, densities


def test_reallocation_job(spark):
    root = scratch_path(spark, "runs")
    run = dict(expected_regions=3, expected_population=80000.0)
    jobs.reallocation_job(*_inputs(spark), ["nurse"], root, AT, **run)
    later = AT + timedelta(days=1)
    summary, moved, rows = jobs.reallocation_job(*_inputs(spark), ["nurse", "officer"], root, later, **run)
    assert summary.count() == 1 and summary.first().run_at.replace(tzinfo=UTC) == later
    assert summary.first().deviation_after < summary.first().deviation_before
    # A may give 14; a head counts double in C, whose denominator is half of B's, so C is filled first.
    assert {r.region: r.grand_total_after for r in rows.collect()} == {"A": 16, "B": 20, "C": 12}
    assert moved.agg(F.sum("headcount")).first()[0] == 14
    stamp = later.strftime("%Y%m%dT%H%M%SZ")
    kinds = moved.drop("problem", "run_at").schema
    snapshot = readers.read_seed(spark, f"{root}/snapshots/transfers_{stamp}", kinds)
    assert snapshot.agg(F.sum("headcount")).first()[0] == 14


def test_reallocation_job_stops_on_lost_regions_and_wrong_totals(spark):
    staff, counts, densities = _inputs(spark)
    root = scratch_path(spark, "runs")
    with pytest.raises(checks.CheckFailed, match="row_count"):
        none = densities.withColumn("density_per_10k_population", F.expr("if(region = 'C', 0.0, 1.0)"))
        jobs.reallocation_job(staff, counts, none, ["nurse"], root, AT, expected_regions=3)
    with pytest.raises(checks.CheckFailed, match="reconcile"):
        jobs.reallocation_job(staff, counts, densities, ["nurse"], root, AT, expected_population=90000.0)
    with pytest.raises(LookupError):
        writers.read_latest_run(spark, root)

"""The audit end to end on a small world that holds the awkward cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, checks
from plumbline.plans import audit, report

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    indicators = spark.createDataFrame(
        [(i, f"ind {i}", True, i <= 2, 0.05 if i <= 2 else None) for i in range(1, 5)],
        "indicator_id int, indicator_name string, in_reporting_basket boolean, "
        "in_impossibility_test boolean, population_fraction double",
    )
    entities = spark.createDataFrame(
        [(1, "O'Place"), (2, "Delta"), (3, "Silent")], "location_id int, location_name string"
    )
    population = spark.createDataFrame(
        [("O'Place", 1000.0, 1200.0, T0), ("O'Place ", 900.0, 1100.0, T0 - timedelta(days=9)),
         ("Deltaa", 500.0, 600.0, T0)],
        "location_name string, population_mean double, population_q975 double, fetched_at timestamp",
    )
    obs = []

    def see(record, entity, name, indicator, year, value, updated=0, fetched=0):
        obs.append((record, indicator, entity, name, year, value, T0 + timedelta(updated), T0 + timedelta(fetched)))

    for record, indicator in enumerate((1, 2, 3, 4)):  # full basket in 2020
        see(record, 1, " O'Place ", indicator, 2020, 100.0)
    see(10, 1, "O'Place", 1, 2022, 175.4, updated=1)
    see(11, 1, "O'Place", 1, 2022, 39754.0, updated=2)  # a rival record, updated later
    see(11, 1, "O'Place", 1, 2022, 1.0, updated=2, fetched=-1)  # an older fetch of it
    see(12, 1, "O'Place", 99, 2022, 500.0)  # an indicator the dimension does not know
    see(20, 2, "Delta", 1, 2020, 300.0)  # impossible, but the name has no denominator
    see(21, 2, "Delta", 2, 2020, 50.0)
    see(22, 2, "Delta", 3, 2022, 50.0)
    see(23, 2, "Delta", 4, 2022, 50.0)
    frame = spark.createDataFrame(
        obs,
        "record_id int, indicator_id int, location_id int, location_name string, year int, value double, "
        "updated_at timestamp, fetched_at timestamp",
    )
    staged = audit.staged(frame)
    den = audit.staged_population(population, "location_name", "fetched_at")
    drops = audit.completeness_drop(audit.completeness(staged, entities.select("location_id"), indicators))
    marks = audit.attrition(drops)
    detail = audit.impossibility_detail(staged, indicators, den)
    summary = audit.impossibility_summary(detail)
    card = audit.trust_scorecard(entities, marks, summary, den).cache()
    return dict(staged=staged, den=den, drops=drops, marks=marks, detail=detail, card=card)


def test_staging(world):
    kept = {(r.location_id, r.indicator_id, r.year): r for r in world["staged"].collect()}
    assert len(kept) == 10
    assert kept[1, 1, 2022].value == 39754.0
    assert kept[1, 1, 2020].location_name == "O'Place"
    pop = {r.location_name: r.population_mean for r in world["den"].collect()}
    assert pop == {"O'Place": 1000.0, "Deltaa": 500.0}


def test_dense_grid_and_previous_row(world):
    got = {(r.location_id, r.year): r for r in world["drops"].collect()}
    assert len(got) == 6  # 3 entities x the 2 years present; 2021 never appears
    assert got[1, 2020].completeness_fraction == 1.0 and got[1, 2022].completeness_fraction == 0.25
    assert got[1, 2022].prior_period == 2020 and got[1, 2022].relative_drop == 0.75
    assert got[3, 2022].completeness_fraction == 0.0 and got[3, 2022].relative_drop is None


def test_flags(world):
    got = {r.location_id: r for r in world["marks"].collect()}
    assert got[1].attrition_flag and got[1].below_floor and got[1].sharp_drop
    assert got[2].attrition_flag is False and got[2].completeness_fraction == 0.5
    assert got[3].attrition_flag and got[3].sharp_drop is None


def test_detail_uses_the_upper_bound(world):
    got = {(r.indicator_id, r.year): r for r in world["detail"].collect()}
    assert set(got) == {(1, 2020), (2, 2020), (1, 2022)}  # Delta's rows have no denominator
    row = got[1, 2022]
    assert (row.eligible_population, row.implied_headcount) == (60.0, 23852.4)
    assert row.is_impossible and row.is_extreme
    assert not got[1, 2020].is_impossible  # exactly 100 is possible


def test_scorecard(world):
    ranked = audit.ranked(world["card"]).collect()
    assert [r.location_name for r in ranked] == ["O'Place", "Silent", "Delta"]
    assert [r.score for r in ranked] == [3 + 1 + 2, 3, 0]
    assert ranked[0].reasons == (
        "reporting-volume attrition: 25.0% of basket reported in 2022 (prior year 100.0%); "
        "biological impossibility: 1 indicator-year(s) across 1 distinct indicator(s), "
        "max 39754% coverage (most recent: 2022)"
    )
    assert ranked[1].reasons == "reporting-volume attrition: 0.0% of basket reported in 2022 (prior year 0.0%)"
    assert ranked[2].reasons == "" and ranked[2].incidents == 0 and ranked[2].impossible_flag is False
    assert aggregates.headline(world["card"]).first()[:] == (6, 2, 3)


def test_table(world):
    rows = report.scorecard_table(world["card"]).collect()
    assert rows[0].name == "O&#x27;Place" and rows[0].bar_pct == 100.0 and rows[0].population == "1,000"
    assert rows[1].bar_pct == 50.0 and rows[1].population == "" and rows[1].impossibility == "no"
    assert [r["rank"] for r in report.scorecard_table(world["card"], top=2).collect()] == [1, 2]
    sliced = report.scorecard_table(world["card"], slices=2).orderBy("rank").collect()
    assert [tuple(r) for r in sliced] == [tuple(r) for r in rows]


def test_flag_is_unknown_without_a_previous_period(spark):
    drops = spark.createDataFrame([(1, 2020, 0.9, None)], "location_id int, year int, completeness_fraction double, relative_drop double")
    assert audit.attrition(drops).first().attrition_flag is None


def test_findings_are_warnings(world):
    found = [
        checks.rule(world["marks"], "attrition_flag", "warn", "attrition"),
        checks.rule(world["detail"], "is_impossible", "warn", "impossible"),
    ]
    assert checks.enforce(found) == [("attrition", 2), ("impossible", 1)]
    checks.enforce([*checks.primary_key(world["card"], ["location_id"]), checks.not_null(world["card"], ["score"])])
    assert world["card"].where(F.col("score").isNull()).count() == 0

"""The two products from landed tables to stored results: build, check, then store."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import checks
from plumbline.plans import audit, reallocation
from plumbline.plans.audit import Names
from plumbline.session import cut, scratch_path
from plumbline.sources import writers


def audit_job(
    obs: DataFrame,
    population: DataFrame,
    entities: DataFrame,
    indicators: DataFrame,
    root: str,
    at: datetime,
    n: Names = Names(),
    steady: bool = False,
) -> list[tuple[str, int]]:
    """Store the attrition, impossibility and scorecard tables below ``root``; return the findings.

    A defect (a key that is not unique, a missing score) stops the job before anything is stored;
    flagged entities are findings and do not.
    """
    checks.enforce([checks.non_empty(obs, "observations"), checks.non_empty(population, "population")])
    # Three steps read the staged rows, so they are stored once, by column: each reads what it needs.
    path = scratch_path(obs.sparkSession, "staged")
    audit.staged(obs, n, steady).write.parquet(path)
    kept = obs.sparkSession.read.parquet(path)
    denominators = audit.staged_population(population, n.entity_name, n.fetched)
    grid = audit.completeness(kept, entities.select(n.entity), indicators, n)
    marks = cut(audit.attrition(audit.completeness_drop(grid, n), n))
    detail = audit.impossibility_detail(kept, indicators, denominators, n)
    summary = cut(audit.impossibility_summary(detail, n))
    card = cut(audit.trust_scorecard(entities, marks, summary, denominators, n))
    keyed = [check for table in (marks, summary, card) for check in checks.primary_key(table, [n.entity])]
    findings = checks.enforce(
        [
            *keyed,
            checks.not_null(card, ["score"]),
            checks.rule(marks, "attrition_flag", "warn", "attrition_findings"),
            checks.rule(summary, "impossible_flag", "warn", "impossibility_findings"),
        ]
    )
    writers.reload_tables({"attrition": marks, "impossibility": summary, "scorecard": card}, root, at)
    return findings


def reallocation_job(
    staff: DataFrame,
    counts: DataFrame,
    densities: DataFrame,
    cadres: Sequence[str],
    root: str,
    at: datetime,
    region: str = "region",
    count: str = "facility_count",
    density: str = "density_per_10k_population",
    expected_regions: int | None = None,
    expected_population: float | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Level one problem, verify it, append the run below ``root`` with a CSV of its transfers, and
    return (summary, transfers, allocations) as stored.

    A region lost between staff and denominators, or denominators whose sum is more than 5 % off
    the expected total, stop the job.
    """
    proxies = reallocation.population_proxies(counts, densities, region, count, density)
    whole = F.lit("all").alias("problem")
    denominators = proxies.select(
        whole, F.col(region).alias("region"), F.col("population_proxy").alias("denominator")
    )
    heads = staff.select(whole, F.trim(region).alias("region"), "grand_total", *cadres)
    rows = reallocation.levelling_input(heads, denominators)
    todo = reallocation.input_checks(rows, expected_rows=expected_regions)
    if expected_population is not None:
        tolerance = reallocation.RECONCILIATION_TOLERANCE
        todo.append(checks.reconcile(denominators, "denominator", expected_population, tolerance))
    checks.enforce(todo)
    done = reallocation.level(rows, cadres)
    after = reallocation.verify(done.regions, done.caps, done.edges)
    writers.write_run(done.edges, after, reallocation.run_summary(after), root, at)
    writers.write_snapshot_csv(done.edges.drop("problem"), f"{root}/snapshots", "transfers", at)
    return writers.read_latest_run(staff.sparkSession, root)

"""The data-trust audit: which entities report data that cannot be trusted, and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import (
    attrition_flags, bound_flags, implied_counts, one_decimal, plain_number, reasons,
    relative_drop, safe_fraction, weighted_score,
)
from plumbline.operators.aggregates import basket_size, bound_summary, periods, reported_counts
from plumbline.operators.grid import bounded_values, filled_grid
from plumbline.operators.joins import join_on_name, tag, with_scalar
from plumbline.operators.latest import latest_per_key, latest_wins
from plumbline.operators.ordered import with_previous

# Fixed values of the audit's rules.
COMPLETENESS_FLOOR = 0.33
DROP_LIMIT = 0.50
WEIGHT_ATTRITION, WEIGHT_INCIDENT, WEIGHT_EXTREME = 3, 1, 2

# The wording of the two reasons.
ATTRITION_REASON = "reporting-volume attrition: %s%% of basket reported in %s (prior year %s%%)"
IMPOSSIBLE_REASON = (
    "biological impossibility: %s indicator-year(s) across %s distinct indicator(s), "
    "max %s%% coverage (most recent: %s)"
)


@dataclass(frozen=True)
class Names:
    """Column names of the observations; nothing else ties the plans to one subject."""

    record: str = "record_id"
    entity: str = "location_id"
    entity_name: str = "location_name"
    indicator: str = "indicator_id"
    period: str = "year"
    value: str = "value"
    updated: str = "updated_at"
    fetched: str = "fetched_at"


def staged(obs: DataFrame, n: Names = Names(), steady: bool = False) -> DataFrame:
    """One observation per (entity, indicator, period): newest snapshot, then newest record.

    ``steady`` as in ``latest.latest_wins``, e.g. for a log whose records are never rewritten.
    """
    key = [n.entity, n.indicator, n.period]
    kept = latest_wins(obs, [n.record], n.fetched, key, n.updated, steady)
    return kept.withColumn(n.entity_name, F.trim(n.entity_name)) if n.entity_name in obs.columns else kept


def staged_population(pop: DataFrame, name: str, fetched: str) -> DataFrame:
    """Newest snapshot per trimmed name, so that blanks cannot leave two rows for one name."""
    return latest_per_key(pop.withColumn(name, F.trim(name)), [name], [fetched])


def completeness(
    obs: DataFrame, entities: DataFrame, basket: DataFrame, n: Names = Names(), flag="in_reporting_basket"
) -> DataFrame:
    """Share of the basket each entity reported in each period seen anywhere; gaps count 0.

    Distinct keys are all that matters, so raw observations do as well as staged ones as long as
    a record never moves to another key.
    """
    members = basket.where(flag)
    counts = reported_counts(obs, members.select(n.indicator), [n.entity, n.period], n.indicator)
    grid = filled_grid(entities, counts, periods(obs, n.period), n.entity, "reported")
    sized = with_scalar(grid, basket_size(basket, flag))
    return sized.withColumn("completeness_fraction", safe_fraction("reported", "basket_size"))


def completeness_drop(grid: DataFrame, n: Names = Names()) -> DataFrame:
    """Adds the previous period present, its fraction and the relative drop since."""
    lagged = with_previous(
        grid, [n.entity], n.period,
        {"completeness_fraction": "prior_fraction", n.period: "prior_period"},
    )
    return lagged.withColumn("relative_drop", relative_drop("prior_fraction", "completeness_fraction"))


def attrition(
    drops: DataFrame, n: Names = Names(), floor=COMPLETENESS_FLOOR, limit=DROP_LIMIT
) -> DataFrame:
    """Flags at each entity's latest period. A flag is NULL when it cannot be told."""
    latest = latest_per_key(drops, [n.entity], [n.period])
    below, sharp, either = attrition_flags("completeness_fraction", "relative_drop", floor, limit)
    return latest.withColumnRenamed(n.period, "latest_period").withColumns(
        {"below_floor": below, "sharp_drop": sharp, "attrition_flag": either}
    )


def impossibility_detail(
    obs: DataFrame,
    indicators: DataFrame,
    denominators: DataFrame,
    n: Names = Names(),
    flag: str = "in_impossibility_test",
    fraction: str = "population_fraction",
    upper: str = "population_q975",
) -> DataFrame:
    """Staged observations of the bounded indicators against an independent denominator.

    Names without a denominator drop out (see ``joins.unmatched_names``). A short list of bounded
    indicators becomes a filter: the indicator is part of the key observations are staged by, so
    Spark applies it before that shuffle instead of after.
    """
    bounded = indicators.where(flag)
    members = bounded_values(bounded.select(n.indicator))
    if members is not None:
        obs = obs.where(F.col(n.indicator).isin(members))
    tagged = tag(obs, bounded, n.indicator)
    added = [c for c in denominators.columns if c == n.entity_name or c not in tagged.columns]
    rows = join_on_name(tagged, denominators.select(*added), n.entity_name)
    eligible, implied = implied_counts(n.value, upper, fraction)
    impossible, extreme = bound_flags(n.value, upper, fraction)
    return rows.withColumns(
        {"eligible_population": eligible, "implied_headcount": implied,
         "is_impossible": impossible, "is_extreme": extreme}
    )


def impossibility_summary(detail: DataFrame, n: Names = Names(), keys: Sequence[str] | None = None):
    return bound_summary(detail, keys or [n.entity, n.entity_name], n.indicator, n.value, n.period)


def trust_scorecard(
    entities: DataFrame,
    attrition_mart: DataFrame,
    impossibility_mart: DataFrame,
    denominators: DataFrame,
    n: Names = Names(),
    estimate: str = "population_mean",
) -> DataFrame:
    """Every entity with its evidence, weighted score and reason string (unordered).

    Order for display by ``score`` descending, then name. All inputs hold one row per entity. The
    denominators' ``source_label`` is carried along if there is one.
    """
    carried = [c for c in (estimate, "source_label") if c in denominators.columns]
    none = F.lit(0).cast("bigint")
    flags = attrition_mart.select(
        n.entity, "latest_period", "reported", "basket_size", "completeness_fraction",
        "prior_period", "prior_fraction", "relative_drop", "attrition_flag",
    )
    joined = (
        entities.join(denominators.select(n.entity_name, *carried), n.entity_name, "left")
        .join(flags, n.entity, "left")
        .join(impossibility_mart.drop(n.entity_name), n.entity, "left")
        .withColumns(
            {c: F.coalesce(c, none) for c in ("incidents", "extreme_incidents", "indicators_affected")}
        )
        .withColumn("impossible_flag", F.coalesce("impossible_flag", F.lit(False)))
    )
    score = weighted_score(
        [
            (F.col("attrition_flag"), WEIGHT_ATTRITION),
            (F.col("incidents"), WEIGHT_INCIDENT),
            (F.col("extreme_incidents"), WEIGHT_EXTREME),
        ]
    )
    text = reasons(
        [
            (
                F.col("attrition_flag"),
                ATTRITION_REASON,
                [
                    one_decimal(F.col("completeness_fraction") * 100),
                    F.col("latest_period").cast("string"),
                    one_decimal(F.coalesce("prior_fraction", F.lit(0.0)) * 100),
                ],
            ),
            (
                F.col("incidents") > 0,
                IMPOSSIBLE_REASON,
                [
                    F.col("incidents").cast("string"),
                    F.col("indicators_affected").cast("string"),
                    plain_number("max_value"),
                    F.col("latest_incident").cast("string"),
                ],
            ),
        ]
    )
    return joined.withColumns({"score": score, "reasons": text})


def ranked(scorecard: DataFrame, n: Names = Names()) -> DataFrame:
    return scorecard.orderBy(F.col("score").desc_nulls_last(), F.col(n.entity_name).asc())

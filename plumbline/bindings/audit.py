"""Trust audit over ``events``: entity = user, indicator = event type, period = day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.bindings.common import Registry, table
from plumbline.operators import aggregates, checks, grid, joins, latest
from plumbline.operators.ordered import slices_for
from plumbline.plans import audit, report
from plumbline.plans.audit import Names
from plumbline.session import cut

R = Registry()

N = Names(
    record="event_id", entity="user_id", entity_name="user_name", indicator="event_type",
    period="day", value="value", updated="ts", fetched="ts",
)

# The indicator dimension of the event types.
INDICATORS = [
    ("view", True, False, None),
    ("click", True, True, 0.3),
    ("purchase", True, True, 0.4),
    ("signup", True, True, 0.5),
    ("error", True, False, None),
]


_ROWS = ", ".join(
    f"('{t}', {str(b).lower()}, {str(i).lower()}, {'null' if f is None else f})" for t, b, i, f in INDICATORS
)


def indicators(spark: SparkSession) -> DataFrame:
    """As VALUES, whose rows Spark knows while planning."""
    return spark.sql(
        "select event_type, in_reporting_basket, in_impossibility_test, "
        "cast(population_fraction as double) as population_fraction "
        f"from values {_ROWS} as t(event_type, in_reporting_basket, in_impossibility_test, population_fraction)"
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    name = F.concat(F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "))
    return events.select(
        "event_id", "user_id", name.alias("user_name"), "event_type",
        F.col("ts").cast("date").alias("day"), "value", "ts",
    )


def entities(obs: DataFrame) -> DataFrame:
    return obs.select("user_id").distinct().withColumn(
        "user_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))
    )


def denominators(spark: SparkSession, sf: str) -> DataFrame:
    """Independent denominators by name; customers without a positive balance have none."""
    return table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("user_name"),
        F.col("c_acctbal").alias("population_mean"),
        (F.col("c_acctbal") * 2).alias("population_q975"),
    )


def _grid(spark, sf):
    obs = observations(spark, sf)
    return audit.completeness(obs, entities(obs).select("user_id"), indicators(spark), N)


def _drops(spark, sf):
    return audit.completeness_drop(_grid(spark, sf), N)


def _attrition(spark, sf):
    return audit.attrition(_drops(spark, sf), N)


def _detail(spark, sf):
    staged = audit.staged(observations(spark, sf), N, steady=True)  # events are never rewritten
    return audit.impossibility_detail(staged, indicators(spark), denominators(spark, sf), N)


def _scorecard(spark, sf):
    return audit.trust_scorecard(
        entities(observations(spark, sf)), _attrition(spark, sf),
        audit.impossibility_summary(_detail(spark, sf), N), denominators(spark, sf), N,
    )


# --- the same steps as SQL -----------------------------------------------------------------

BASE = f"""
with ind(event_type, in_reporting_basket, in_impossibility_test, population_fraction) as (
    select a, b, c, cast(d as double) from (values {_ROWS}) as v(a, b, c, d)
),
obs as (
    select event_id, user_id, 'user ' || user_id as user_name, event_type,
           cast(ts as date) as day, value, ts
    from events
),
staged as (
    select * from obs
    qualify row_number() over (
        partition by user_id, event_type, day order by ts desc, event_id desc) = 1
),
ent as (select distinct user_id, user_name from obs),
den as (
    select 'user ' || c_custkey as user_name, c_acctbal as population_mean,
           c_acctbal * 2 as population_q975
    from customer where c_acctbal > 0
),
size as (select count(*) as basket_size from ind where in_reporting_basket),
days as (select distinct day from obs),
rep as (
    select user_id, day, count(distinct event_type) as reported
    from staged join ind using (event_type)
    where in_reporting_basket group by all
),
grid as (
    select ent.user_id, days.day, coalesce(reported, 0) as reported, basket_size,
           round(coalesce(reported, 0)::double / nullif(basket_size, 0), 4) as completeness_fraction
    from ent cross join days cross join size
    left join rep on rep.user_id = ent.user_id and rep.day = days.day
),
lagged as (
    select *,
           lag(completeness_fraction) over (partition by user_id order by day) as prior_fraction,
           lag(day) over (partition by user_id order by day) as prior_period
    from grid
),
drops as (
    select *, case when prior_fraction > 0
        then round((prior_fraction - completeness_fraction) / prior_fraction, 4) end as relative_drop
    from lagged
),
latest as (
    select * from drops qualify row_number() over (partition by user_id order by day desc) = 1
),
attr as (
    select user_id, day as latest_period, reported, basket_size, completeness_fraction,
           prior_fraction, prior_period, relative_drop,
           completeness_fraction < 0.33 as below_floor, relative_drop >= 0.5 as sharp_drop,
           completeness_fraction < 0.33 or relative_drop >= 0.5 as attrition_flag
    from latest
),
detail as (
    select event_id, user_id, user_name, event_type, day, value, population_fraction,
           population_mean, population_q975,
           cast(round(cast(population_q975 * population_fraction as decimal(28, 8)), 1) as double)
               as eligible_population,
           cast(round(cast(value / 100.0::double * (population_q975 * population_fraction)
               as decimal(28, 8)), 1) as double) as implied_headcount,
           value > 100 as is_impossible,
           value / 100.0::double * (population_q975 * population_fraction) > population_q975 as is_extreme
    from staged join ind using (event_type) join den using (user_name)
    where in_impossibility_test
),
finding as (
    select user_id, 'volume' as kind, 3 as weight, null as event_type, null as value, null as day
    from attr where attrition_flag
    union all by name select user_id, 'share' as kind, 1 as weight, event_type, value, day from detail where is_impossible
    union all by name select user_id, 'heads' as kind, 2 as weight, event_type, value, day from detail where is_extreme
),
tally as (
    select user_id, cast(sum(weight) as bigint) as score,
           sum((kind = 'share')::int)::bigint as incidents, sum((kind = 'heads')::int)::bigint as extreme_incidents,
           count(distinct case kind when 'share' then event_type end) as indicators_affected,
           max(case kind when 'share' then value end) as max_value, max(case kind when 'share' then day end) as latest_incident
    from finding group by user_id
),
summ as (
    select user_id, user_name, coalesce(incidents, 0) as incidents, coalesce(extreme_incidents, 0) as extreme_incidents,
           coalesce(indicators_affected, 0) as indicators_affected, max_value, latest_incident,
           coalesce(incidents, 0) > 0 as impossible_flag
    from (select distinct user_id, user_name from detail) left join tally using (user_id)
),
tenths as (
    select user_id, latest_period, list_transform([completeness_fraction, coalesce(prior_fraction, 0)],
           lambda x: (round((x * 100)::decimal(28, 8), 1)::decimal(22, 1))::varchar) as shares
    from attr
),
sentence as (
    select user_id, 1 as place, printf('""" + audit.ATTRITION_REASON + """', shares[1], latest_period::varchar, shares[2]) as said
    from tenths semi join (from finding where kind = 'volume') using (user_id)
    union all
    select user_id, 2, printf('""" + audit.IMPOSSIBLE_REASON + """', incidents::varchar, indicators_affected::varchar,
           regexp_replace(max_value::decimal(38, 10)::varchar, '\\.?0+$', ''), latest_incident::varchar)
    from tally where incidents > 0
),
card as (
    select user_id, user_name, population_mean, latest_period, reported, basket_size,
           completeness_fraction, prior_period, prior_fraction, relative_drop, attrition_flag,
           coalesce(incidents, 0) as incidents, coalesce(extreme_incidents, 0) as extreme_incidents,
           coalesce(indicators_affected, 0) as indicators_affected, max_value, latest_incident,
           coalesce(incidents > 0, false) as impossible_flag, coalesce(score, 0) as score, coalesce(reasons, '') as reasons
    from ent left join den using (user_name) left join attr using (user_id) left join tally using (user_id)
    left join (select user_id, string_agg(said, '; ' order by place) as reasons from sentence group by user_id) using (user_id)
)
"""
_ESCAPED = (
    "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&quot;'), '''', '&#x27;')"
)
_SHOWN = f"""
select rank, {_ESCAPED.format(c="user_name")} as name, score,
       case when top > 0 then cast(round(cast(score::double / top * 100 as decimal(28, 8)), 1) as double)
            else 0.0 end as bar_pct,
       case when attrition_flag then 'yes' else 'no' end as attrition,
       case when impossible_flag then 'yes' else 'no' end as impossibility, incidents,
       coalesce(cast(cast(round(cast(completeness_fraction * 100 as decimal(28, 8)), 1)
           as decimal(22, 1)) as varchar) || '%', '') as completeness,
       coalesce(format('{{:,}}', cast(round_even(population_mean, 0) as bigint)), '') as population,
       {_ESCAPED.format(c="reasons")} as reasons
from (select *, row_number() over (order by score desc, user_name) as rank,
             max(score) over () as top from card)
"""


# --- bindings ------------------------------------------------------------------------------


@R.bind("latest_observation", BASE + "select event_id, user_id, event_type, day, value, ts from staged")
def latest_observation(spark, sf):
    return audit.staged(observations(spark, sf), N).select(
        "event_id", "user_id", "event_type", "day", "value", "ts"
    )


@R.bind(
    "latest_turn",
    """select conv_id, turn, trim(role) as role, text from conversations
       qualify row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1""",
)
def latest_turn(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.trim("role").alias("role"), "text")
    return latest.latest_per_key(turns, ["conv_id"], ["turn"])


@R.bind(
    "latest_order",
    """select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders
       qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
)
def latest_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@R.bind(
    "staged_population",
    """select name, o_orderkey, o_totalprice, o_orderdate from (
           select 'c ' || o_custkey as name, o_orderkey, o_totalprice, o_orderdate from orders)
       qualify row_number() over (partition by name order by o_orderdate desc, o_orderkey desc) = 1""",
)
def staged_population(spark, sf):
    """Orders as snapshots by name, where urgent ones carry other blanks around the name."""
    name = F.concat(F.lit("c "), F.col("o_custkey").cast("string"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    padded = F.when(urgent, F.concat(F.lit("  "), name)).otherwise(F.concat(name, F.lit(" ")))
    snapshots = table(spark, sf, "orders").select(padded.alias("name"), "o_orderkey", "o_totalprice", "o_orderdate")
    return audit.staged_population(snapshots, "name", "o_orderdate")


@R.bind(
    "key_conflicts_by_day",
    BASE
    + """select day as period, count(*) as keys, count(*) filter (where n > 1) as conflicts
         from (select user_id, event_type, day, count(distinct event_id) as n from obs group by all)
         group by day""",
)
def key_conflicts_by_day(spark, sf):
    return latest.conflict_profile(observations(spark, sf), ["user_id", "event_type"], "event_id", "day")


@R.bind("periods_present", BASE + "select day from days")
def periods_present(spark, sf):
    return aggregates.periods(observations(spark, sf), "day")


@R.bind("reported_counts", BASE + "select * from rep")
def reported_counts(spark, sf):
    basket = indicators(spark).where("in_reporting_basket").select("event_type")
    return aggregates.reported_counts(
        observations(spark, sf), basket, ["user_id", "day"], "event_type"
    )


@R.bind("basket_size", BASE + "select event_type, n, basket_size from (select event_type, count(*) as n from obs group by 1), size")
def basket_size(spark, sf):
    facts = observations(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return joins.with_scalar(facts, aggregates.basket_size(indicators(spark), "in_reporting_basket"))


@R.bind(
    "untagged_facts",
    """select event_type, count(*) as n from events
       where event_type not in ('click', 'purchase', 'signup') group by event_type""",
)
def untagged_facts(spark, sf):
    bounded = indicators(spark).where("in_impossibility_test")
    lost = joins.untagged(observations(spark, sf), bounded, "event_type")
    return lost.groupBy("event_type").agg(F.count("*").alias("n"))


@R.bind(
    "tagged_facts",
    BASE
    + """select event_type, population_fraction, count(*) as n, min(day) as first_day
         from obs join ind using (event_type) where in_impossibility_test group by all""",
)
def tagged_facts(spark, sf):
    bounded = indicators(spark).where("in_impossibility_test")
    return (
        joins.tag(observations(spark, sf), bounded, "event_type")
        .groupBy("event_type", "population_fraction")
        .agg(F.count("*").alias("n"), F.min("day").alias("first_day"))
    )


@R.bind("unmatched_names", BASE + "select user_name from ent anti join den using (user_name)")
def unmatched_names(spark, sf):
    return joins.unmatched_names(entities(observations(spark, sf)), denominators(spark, sf), "user_name")


@R.bind(
    "missing_pairs",
    BASE
    + """select ent.user_id, days.day from ent cross join days
         where not exists (select 1 from obs where obs.user_id = ent.user_id and obs.day = days.day)""",
)
def missing_pairs(spark, sf):
    obs = observations(spark, sf)
    return grid.missing_pairs(entities(obs).select("user_id"), aggregates.periods(obs, "day"), obs, "user_id")


@R.bind("completeness_grid", BASE + "select * from grid")
def completeness_grid(spark, sf):
    return _grid(spark, sf)


@R.bind("completeness_drop", BASE + "select * from drops")
def completeness_drop(spark, sf):
    return _drops(spark, sf)


@R.bind("attrition_flags", BASE + "select * from attr")
def attrition_flags(spark, sf):
    return _attrition(spark, sf)


@R.bind("plausibility_detail", BASE + "select * from detail")
def plausibility_detail(spark, sf):
    return _detail(spark, sf).select(
        "event_id", "user_id", "user_name", "event_type", "day", "value", "population_fraction",
        "population_mean", "population_q975", "eligible_population", "implied_headcount",
        "is_impossible", "is_extreme",
    )


@R.bind("plausibility_summary", BASE + "select * from summ")
def plausibility_summary(spark, sf):
    return audit.impossibility_summary(_detail(spark, sf), N)


@R.bind("trust_scorecard", BASE + "select * from card order by score desc, user_name")
def trust_scorecard(spark, sf):
    return audit.ranked(_scorecard(spark, sf), N)


@R.bind("scorecard_top10", BASE + f"select * from ({_SHOWN}) where rank <= 10")
def scorecard_top10(spark, sf):
    return report.scorecard_table(cut(_scorecard(spark, sf)), "user_name", top=10)


@R.bind("report_tables", BASE + _SHOWN)
def report_tables(spark, sf):
    card = cut(_scorecard(spark, sf))
    return report.scorecard_table(card, "user_name", slices=slices_for(card, []))


@R.bind(
    "scorecard_headline",
    BASE
    + """select coalesce(max(score), 0) as max_score, count(*) filter (where score > 0) as flagged,
                count(*) as total from card""",
)
def scorecard_headline(spark, sf):
    return aggregates.headline(_scorecard(spark, sf))


@R.bind(
    "completeness_profile",
    BASE
    + """select 'completeness' as measure, count(completeness_fraction) as rows,
                min(completeness_fraction) as min_value, max(completeness_fraction) as max_value,
                count(*) filter (where round(abs(completeness_fraction - 0.33), 9) <= 0.1) as near_threshold,
                count(*) filter (where completeness_fraction < 0.33) as crossing,
                round(quantile_cont(completeness_fraction, 0.5), 6) as median_value
         from drops
         union all
         select 'drop', count(relative_drop), min(relative_drop), max(relative_drop),
                count(*) filter (where round(abs(relative_drop - 0.5), 9) <= 0.1),
                count(*) filter (where relative_drop >= 0.5),
                round(quantile_cont(relative_drop, 0.5), 6)
         from drops""",
)
def completeness_profile(spark, sf):
    drops = cut(_drops(spark, sf))
    low = aggregates.profile(drops, "completeness_fraction", audit.COMPLETENESS_FLOOR, 0.1, below=True)
    sharp = aggregates.profile(drops, "relative_drop", audit.DROP_LIMIT, 0.1, below=False)
    both = low.withColumn("measure", F.lit("completeness")).unionByName(
        sharp.withColumn("measure", F.lit("drop"))
    )
    return both.withColumn("median_value", F.round("median_value", 6))


@R.bind(
    "bottom_decile",
    """select round(quantile_cont(value, 0.1), 6) as cutoff from events""",
)
def bottom_decile(spark, sf):
    cutoff = aggregates.quantile_cutoff(table(spark, sf, "events"), "value", 0.1)
    return cutoff.select(F.round("cutoff", 6).alias("cutoff"))


@R.bind("attrition_findings", BASE + "select user_id, latest_period, completeness_fraction from attr where attrition_flag")
def attrition_findings(spark, sf):
    found = checks.rule(_attrition(spark, sf), "attrition_flag", "warn", "reporting_attrition")
    return found.failing.select("user_id", "latest_period", "completeness_fraction")


@R.bind("impossibility_findings", BASE + "select event_id, user_id, value from detail where is_impossible")
def impossibility_findings(spark, sf):
    found = checks.rule(_detail(spark, sf), "is_impossible", "warn", "impossible_values")
    return found.failing.select("event_id", "user_id", "value")

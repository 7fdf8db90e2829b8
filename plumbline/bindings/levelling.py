"""Levelling of nations (heads = customers, cadre = market segment, denominator = orders) and of
suppliers (heads = order lines, cadre = return flag, denominator = quantity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.bindings.common import Registry, table
from plumbline.operators import aggregates, checks
from plumbline.operators.joins import with_scalar
from plumbline.operators.levelling import candidate_arcs, capacity, net_change
from plumbline.plans import reallocation, report
from plumbline.plans.reallocation import Levelled
from plumbline.session import cut

R = Registry()

# The movable cadres; the fifth segment stays put but counts as heads.
SEGMENTS = ["automobile", "building", "household", "machinery"]
FLAGS = ["a", "n", "r"]


def nation_input(spark: SparkSession, sf: str, by_region: bool = False) -> DataFrame:
    """Customers and orders are counted by nation key before the names are joined on."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    region = table(spark, sf, "region")
    problem = F.trim("r_name") if by_region else F.lit("all")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", problem.alias("problem"), F.trim("n_name").alias("region")
    )
    heads = customer.groupBy("c_nationkey").agg(
        F.count("*").alias("grand_total"),
        *[F.count_if(F.col("c_mktsegment") == s.upper()).alias(s) for s in SEGMENTS],
    )
    staff = heads.join(names, heads.c_nationkey == names.n_nationkey).drop("c_nationkey", "n_nationkey")
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    per_nation = (
        per_customer.join(customer, per_customer.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey")
        .agg(F.sum("n").alias("denominator"))
    )
    denominators = per_nation.join(names, per_nation.c_nationkey == names.n_nationkey)
    return reallocation.levelling_input(staff, denominators)


def supplier_input(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.lit("all").alias("problem"), F.col("l_suppkey").alias("region"))
    rows = lines.agg(
        F.count("*").alias("grand_total"),
        *[F.count_if(F.col("l_returnflag") == f.upper()).alias(f) for f in FLAGS],
        F.sum("l_quantity").alias("denominator"),
    )
    return reallocation.levelling_input(rows)


def _nations(spark, sf, by_region=False) -> Levelled:
    return reallocation.level(nation_input(spark, sf, by_region), SEGMENTS)


# --- the same as SQL: unit positions by window sums, met by a range join -------------------


def _nation_sql(problem: str) -> str:
    counts = ", ".join(f"count(*) filter (where c_mktsegment = '{s.upper()}') as {s}" for s in SEGMENTS)
    return f"""
with names as (
    select n_nationkey, {problem} as problem, trim(n_name) as region
    from nation join region on n_regionkey = r_regionkey
),
staff as (
    select problem, region, count(*) as grand_total, {counts}
    from customer join names on c_nationkey = n_nationkey group by all
),
den as (
    select problem, region, count(*) as denominator
    from orders join customer on o_custkey = c_custkey join names on c_nationkey = n_nationkey
    group by all
),
reg as (select * from staff join den using (problem, region)),"""


def _supplier_sql() -> str:
    counts = ", ".join(f"count(*) filter (where l_returnflag = '{f.upper()}') as {f}" for f in FLAGS)
    return f"""
with reg as (
    select 'all' as problem, l_suppkey as region, count(*) as grand_total, {counts},
           sum(l_quantity) as denominator
    from lineitem group by all
),"""


def _level_sql(head: str, cadres: list[str]) -> str:
    return f"""{head}
tot as (
    select problem, sum(grand_total) as g, cast(sum(denominator) as double) as p
    from reg group by problem
),
caps as (
    select problem, region, cadre, n, greatest(n - 1, 0) as cap
    from (unpivot reg on {", ".join(cadres)} into name cadre value n)
),
base as (
    select problem, region, round(grand_total - g / p * denominator, 9) as e, p / denominator as w
    from reg join tot using (problem)
),
side as (
    select 'd' as side, problem, region, e, w, room
    from base join (select problem, region, sum(cap) as room from caps group by all) using (problem, region)
    union all
    select 'r', problem, region, -e, w, room
    from base join (select problem, sum(cap) as room from caps group by all) using (problem)
),
parts as (
    select *, floor(greatest(e, 0)) as whole, greatest(e, 0) - floor(greatest(e, 0)) as f from side
),
marks as (
    select *, least(whole, room) as m1,
           least(whole + (case when f > 0 then 1 else 0 end), room) as m2 from parts
),
seg as (
    select * from (
        select side, problem, region, round(w, 9) as worth, 0 as s_lo, m1 as s_hi from marks
        union all
        select side, problem, region, round((2 * f - 1) * w, 9), m1, m2 from marks
        union all
        select side, problem, region, -round(w, 9), m2, room from marks
    ) where s_hi > s_lo
),
stack as (
    select *, sum(cap) over (partition by problem, region order by cadre) as c_hi from caps
),
don as (
    select problem, region, cadre, worth, greatest(s_lo, c_hi - cap) as pos,
           least(s_hi, c_hi) - greatest(s_lo, c_hi - cap) as qty
    from seg join stack using (problem, region)
    where side = 'd' and least(s_hi, c_hi) > greatest(s_lo, c_hi - cap)
),
rec as (
    select problem, region, worth, s_lo as pos, s_hi - s_lo as qty from seg where side = 'r'
),
dpos as (
    select *, sum(qty) over (partition by problem order by worth desc, region, pos) as hi from don
),
rpos as (
    select *, sum(qty) over (partition by problem order by worth desc, region, pos) as hi from rec
),
edges as (
    select d.problem, d.cadre, d.region as from_region, r.region as to_region,
           cast(sum(least(d.hi, r.hi) - greatest(d.hi - d.qty, r.hi - r.qty)) as bigint) as headcount
    from dpos as d join rpos as r
      on d.problem = r.problem and d.hi - d.qty < r.hi and r.hi - r.qty < d.hi
    where d.worth + r.worth > 1e-9
    group by all
),
net as (
    select problem, region,
           cast(coalesce(outbound, 0) as bigint) as outbound, cast(coalesce(inbound, 0) as bigint) as inbound,
           cast(coalesce(inbound, 0) - coalesce(outbound, 0) as bigint) as net
    from reg
    left join (select problem, from_region as region, sum(headcount) as outbound from edges group by all)
        using (problem, region)
    left join (select problem, to_region as region, sum(headcount) as inbound from edges group by all)
        using (problem, region)
),
alloc as (
    select problem, region, cast(denominator as double) as denominator,
           grand_total as grand_total_before, grand_total + net as grand_total_after,
           grand_total::double / denominator as ratio_before,
           (grand_total + net)::double / denominator as ratio_after
    from reg join net using (problem, region)
),
target as (
    select problem, sum(grand_total_before)::double / sum(denominator) as target_ratio
    from alloc group by problem
)
"""


NATIONS = _level_sql(_nation_sql("'all'"), SEGMENTS)
BY_REGION = _level_sql(_nation_sql("trim(r_name)"), SEGMENTS)
SUPPLIERS = _level_sql(_supplier_sql(), FLAGS)
_ALLOCATIONS = """
select problem, region, denominator, grand_total_before, grand_total_after,
       round(ratio_before, 9) as ratio_before, round(ratio_after, 9) as ratio_after from alloc"""
_SUMMARY = """
select problem, round(var_pop(ratio_before), 12) as variance_before,
       round(var_pop(ratio_after), 12) as variance_after,
       round(sum(abs(ratio_before - target_ratio)), 9) as deviation_before,
       round(sum(abs(ratio_after - target_ratio)), 9) as deviation_after,
       cast(sum(greatest(grand_total_after - grand_total_before, 0)) as bigint) as heads_moved,
       'optimal_within_2pct_gap' as solver_status
from alloc join target using (problem) group by problem"""


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _allocations(done: Levelled) -> DataFrame:
    rows = reallocation.allocations(done.regions, done.edges)
    return rows.withColumn("denominator", F.col("denominator").cast("double"))


# --- bindings ------------------------------------------------------------------------------


@R.bind(
    "levelling_input",
    NATIONS
    + """select problem, region, grand_total, denominator,
                round(grand_total::double / denominator, 9) as ratio,
                round(g / p, 9) as target_ratio,
                round(abs(grand_total::double / denominator - g / p), 9) as abs_deviation
         from reg join tot using (problem) order by region""",
)
def levelling_input(spark, sf):
    rows = nation_input(spark, sf).select(
        "problem", "region", "grand_total", "denominator", "ratio", "target_ratio", "abs_deviation"
    )
    return _rounded(rows, ratio=9, target_ratio=9, abs_deviation=9).orderBy("region")


@R.bind("movable_capacity", NATIONS + "select problem, region, cadre, n, cap from caps")
def movable_capacity(spark, sf):
    return capacity(nation_input(spark, sf), ["problem", "region"], SEGMENTS)


@R.bind(
    "candidate_arcs",
    SUPPLIERS
    + """select problem, region, cadre, cap as upper_bound,
                (select count(*) from reg) - 1 as targets from caps""",
)
def arcs(spark, sf):
    caps = capacity(supplier_input(spark, sf), ["problem", "region"], FLAGS)
    return candidate_arcs(caps, "problem", "region")


@R.bind("net_levelling", NATIONS + "select * from net")
def net_levelling(spark, sf):
    done = _nations(spark, sf)
    return net_change(done.edges, done.regions)


@R.bind("net_levelling_by_region", BY_REGION + "select * from net")
def net_levelling_by_region(spark, sf):
    done = _nations(spark, sf, by_region=True)
    return net_change(done.edges, done.regions)


@R.bind("net_levelling_suppliers", SUPPLIERS + "select * from net")
def net_levelling_suppliers(spark, sf):
    done = reallocation.level(supplier_input(spark, sf), FLAGS)
    return net_change(done.edges, done.regions)


@R.bind("transfer_edges", NATIONS + "select * from edges order by from_region, to_region, cadre")
def transfer_edges(spark, sf):
    return _nations(spark, sf).edges.orderBy("from_region", "to_region", "cadre")


@R.bind("transfer_edges_suppliers", SUPPLIERS + "select * from edges")
def transfer_edges_suppliers(spark, sf):
    return reallocation.level(supplier_input(spark, sf), FLAGS).edges


@R.bind(
    "flow_totals",
    SUPPLIERS
    + """select problem, cadre, from_region, cast(sum(headcount) as bigint) as sent
         from edges group by all""",
)
def flow_totals(spark, sf):
    edges = reallocation.level(supplier_input(spark, sf), FLAGS).edges
    return aggregates.flow_totals(edges, "from_region", ["problem", "cadre"], "headcount", "sent")


@R.bind("allocation_before_after", NATIONS + _ALLOCATIONS)
def allocation_before_after(spark, sf):
    return _rounded(_allocations(_nations(spark, sf)), ratio_before=9, ratio_after=9)


@R.bind("allocation_suppliers", SUPPLIERS + _ALLOCATIONS)
def allocation_suppliers(spark, sf):
    done = reallocation.level(supplier_input(spark, sf), FLAGS)
    return _rounded(_allocations(done), ratio_before=9, ratio_after=9)


@R.bind("run_summary", BY_REGION + _SUMMARY)
def run_summary(spark, sf):
    rows = reallocation.run_summary(_allocations(_nations(spark, sf, by_region=True)))
    return _rounded(rows, variance_before=12, variance_after=12, deviation_before=9, deviation_after=9)


@R.bind(
    "levelling_checks",
    SUPPLIERS
    + """, signed as (
            select cadre, from_region as region, -headcount as d from edges
            union all select cadre, to_region, headcount from edges
         )
         select * from (
            select 'known_ends' as "check", 'error' as severity, count(*) as failing_rows from edges e
                where (select count(*) from caps c where c.cadre = e.cadre and c.region in (e.from_region, e.to_region)) < 2
            union all
            select 'zero_sum', 'error', count(*) from
                (select cadre from signed group by cadre having sum(d) <> 0)
            union all
            select 'floor_kept', 'error', count(*) from caps left join
                (select cadre, region, sum(d) as d from signed where d < 0 group by all) using (cadre, region)
                where coalesce(-d, 0) > greatest(n - 1, 0)
            union all
            select 'positive_edges', 'error', count(*) from edges where headcount <= 0
            union all
            select 'improved', 'error', count(*) from
                (select var_pop(ratio_before) as b, var_pop(ratio_after) as a from alloc) where not a < b
         )""",
)
def levelling_checks(spark, sf):
    done = reallocation.level(supplier_input(spark, sf), FLAGS)
    rows = reallocation.allocations(done.regions, done.edges)
    todo = [*reallocation.verification(done), checks.improved(rows, "ratio_before", "ratio_after")]
    return checks.report(todo).drop("sample")


@R.bind(
    "impossible_edges",
    SUPPLIERS
    + """, ends as (select cadre, region, n from caps),
         planted as (
            select 'r' as cadre, region as from_region, -5 as to_region, 1 as headcount from reg
            union all select 'r', -5, -6, 2 from reg where region = (select min(region) from reg)
            union all select 'x', region, region + 1, 1 from reg where region % 2 = 0
            union all select 'a', region, (select min(region) from reg), n + 1 from ends where cadre = 'a'
         )
         select * from (
            select 'known_ends' as "check", count(*) as failing_rows from
                (select distinct * from planted) p
                where not (p.cadre, p.from_region) in (select (cadre, region) from ends)
                   or not (p.cadre, p.to_region) in (select (cadre, region) from ends)
            union all
            select 'floor_kept', count(*) from ends
                where (cadre = 'a' and n + 1 > greatest(n - 1, 0)) or (cadre = 'r' and 1 > greatest(n - 1, 0))
            union all
            select 'positive_edges', 0
         )""",
)
def impossible_edges(spark, sf):
    """Edges to and between unknown regions, of an unknown cadre, and of more heads than there are."""
    regions = supplier_input(spark, sf)
    caps = capacity(regions, ["problem", "region"], FLAGS)
    first = regions.agg(F.min("region").alias("least"))
    each = with_scalar(regions.select("region"), first)
    edge = "'all' as problem", "{} as cadre", "{} as from_region", "{} as to_region", "cast({} as bigint) as headcount"

    def planted(rows, *values):
        return rows.selectExpr(edge[0], *[e.format(v) for e, v in zip(edge[1:], values, strict=True)])

    edges = (
        planted(each, "'r'", "region", "cast(-5 as bigint)", "1")
        .unionAll(planted(each.where("region = least"), "'r'", "cast(-5 as bigint)", "cast(-6 as bigint)", "2"))
        .unionAll(planted(each.where("region % 2 = 0"), "'x'", "region", "region + 1", "1"))
        .unionAll(planted(with_scalar(caps.where("cadre = 'a'"), first), "'a'", "region", "least", "n + 1"))
    )
    todo = reallocation.verification(Levelled(regions, caps, cut(edges)))
    return checks.report([c for c in todo if c.name != "zero_sum"]).select("check", "failing_rows")


@R.bind(
    "dispersion_improved",
    NATIONS
    + """select round(var_pop(ratio_before), 12) as before, round(var_pop(ratio_after), 12) as after,
                var_pop(ratio_after) < var_pop(ratio_before) as improved from alloc""",
)
def dispersion_improved(spark, sf):
    rows = _allocations(_nations(spark, sf))
    pair = rows.agg(F.var_pop("ratio_before").alias("b"), F.var_pop("ratio_after").alias("a"))
    return pair.select(
        F.round("b", 12).alias("before"), F.round("a", 12).alias("after"), (F.col("a") < F.col("b")).alias("improved")
    )


@R.bind(
    "allocation_table",
    NATIONS
    + """select region, grand_total_before, grand_total_after,
                format('{:,}', cast(denominator as bigint)) as denominator,
                cast(cast(round(cast(ratio_before as decimal(28, 10)), 6) as decimal(24, 6)) as varchar) as ratio_before,
                cast(cast(round(cast(ratio_after as decimal(28, 10)), 6) as decimal(24, 6)) as varchar) as ratio_after
         from alloc order by region""",
)
def allocation_table(spark, sf):
    return report.allocation_table(_allocations(_nations(spark, sf)))


@R.bind(
    "transfer_table",
    NATIONS + "select cadre, from_region, to_region, headcount from edges order by 2, 3, 1",
)
def transfer_table(spark, sf):
    return report.transfer_table(_nations(spark, sf).edges)


@R.bind(
    "run_table",
    NATIONS
    + f"""select round(variance_before, 12) as variance_before, round(variance_after, 12) as variance_after,
                 solver_status,
                 case when variance_after < variance_before then 'improved' else 'NOT improved' end as improved,
                 solver_status = 'optimal_within_2pct_gap' as succeeded
          from ({_SUMMARY})""",
)
def run_table(spark, sf):
    rows = report.run_table(reallocation.run_summary(_allocations(_nations(spark, sf))))
    shown = rows.select("variance_before", "variance_after", "solver_status", "improved", "succeeded")
    return _rounded(shown, variance_before=12, variance_after=12)

"""Hierarchies, catalogues, periods, denominators, ranks and display columns."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from plumbline.bindings.common import Registry, table
from plumbline.functions import scalars
from plumbline.operators import aggregates, intervals, joins, ordered
from plumbline.plans import reallocation

R = Registry()


@R.bind(
    "children_at_level",
    """with h as (
           select r_regionkey as id, r_name as name, null as parent_id, 1 as level from region
           union all
           select 1000 + n_nationkey, n_name, n_regionkey, 3 from nation
           union all
           select 100000 + s_suppkey, s_name, n_regionkey, 5 from supplier join nation on s_nationkey = n_nationkey
       )
       select c.id, c.name, p.name as parent from h as c join h as p on c.parent_id = p.id
       where c.parent_id = 2 and c.level = 5""",
)
def children_at_level(spark, sf):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))

    def level(df, id_, name, parent, depth):
        cols = {"id": id_.cast("bigint"), "name": name, "parent_id": parent, "level": F.lit(depth)}
        return scalars.project(df, cols)

    tree = (
        level(region, F.col("r_regionkey"), "r_name", F.lit(None).cast("int"), 1)
        .unionAll(level(nation, F.col("n_nationkey") + 1000, "n_name", "n_regionkey", 3))
        .unionAll(level(supplier, F.col("s_suppkey") + 100000, "s_name", "n_regionkey", 5))
    )
    below = joins.children_at_level(tree, 2, 5)
    parents = tree.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return below.join(parents, "parent_id").select("id", "name", "parent")


@R.bind(
    "basket_from_catalogue",
    "select p_partkey, trim(p_name) as p_name from part where p_type = 'ECONOMY' and p_size > 25",
)
def basket_from_catalogue(spark, sf):
    part = scalars.trim_keys(table(spark, sf, "part"), ["p_name"])
    kept = joins.basket_from_catalogue(part, "ECONOMY", F.col("p_size") > 25, "p_type")
    return kept.select("p_partkey", "p_name")


@R.bind(
    "period_from_label",
    """with labelled as (
           select o_totalprice,
                  case when o_orderpriority = '1-URGENT' then ' ' || strftime(o_orderdate, '%Y') || ' '
                       when o_orderpriority = '5-LOW' then strftime(o_orderdate, '%Y%m')
                       else strftime(o_orderdate, '%Y') end as period
           from orders
       )
       select cast(trim(period) as int) as year, count(*) as n, max(o_totalprice) as top
       from labelled where regexp_matches(trim(period), '^[0-9]{4}$')
         and cast(trim(period) as int) between 1996 and 2000
       group by all""",
)
def period_from_label(spark, sf):
    year = F.year("o_orderdate").cast("string")
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" "), year, F.lit(" ")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(year, F.lpad(F.month("o_orderdate").cast("string"), 2, "0")))
        .otherwise(year)
    )
    rows = table(spark, sf, "orders").select("o_totalprice", label.alias("period"))
    return (
        rows.withColumn("year", scalars.parse_year("period", 1996, 2000))
        .where("year is not null")
        .groupBy("year")
        .agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    )


@R.bind(
    "coerced_orders",
    """with raw as (
           select cast(o_orderkey as varchar) as key, cast(o_totalprice as varchar) as price,
                  case when o_orderpriority = '5-LOW' then o_orderpriority
                       else strftime(o_orderdate, '%Y%m%d') end as day
           from orders
       )
       select try_cast(key as bigint) as key, try_cast(price as double) as price, try_cast(day as int) as day,
              try_cast(day as int) is null as _bad from raw""",
)
def coerced_orders(spark, sf):
    low = F.col("o_orderpriority") == "5-LOW"
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(low, F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"),
    )
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.IntegerType())]
    )
    return scalars.coerce(raw, schema, "quarantine")


_PROXY = """
with counts as (select trim(n_name) as name, count(*) as n
                from supplier join nation on s_nationkey = n_nationkey group by all),
     dens as (select trim(n_name) as name, count(*) filter (where c_acctbal > 9500) / 10.0::double as density
              from customer join nation on c_nationkey = n_nationkey group by all),
     proxy as (select name, n, density, n::double / density * 10000.0::double as population_proxy
               from counts join dens using (name) where density > 0)
"""


def _proxies(spark, sf):
    """Suppliers per nation over the density of rich customers, which is 0 for some nations."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") > 9500).alias("c")
    )
    padded = F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("name")
    counts = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(padded, "n")
    density = (F.col("c") / F.lit(10.0)).alias("density")
    densities = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("name"), density
    )
    return reallocation.population_proxies(counts, densities, "name", "n", "density")


@R.bind(
    "denominator_proxy",
    _PROXY + "select name, n, density, round(population_proxy, 4) as population_proxy from proxy",
)
def denominator_proxy(spark, sf):
    return _proxies(spark, sf).withColumn("population_proxy", F.round("population_proxy", 4))


@R.bind(
    "subset_share",
    """select cast(count(*) filter (where m) as double) as covered, cast(count(*) as double) as total,
              count(*) filter (where m)::double / count(*) as share
       from (select c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY') as m from customer)""",
)
def subset_share(spark, sf):
    member = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")
    return aggregates.subset_share(table(spark, sf, "customer"), F.lit(1), member)


@R.bind(
    "ratio_of_sums",
    """select o_orderpriority, round(sum(o_totalprice) / count(*), 4) as target_ratio from orders
       group by o_orderpriority""",
)
def ratio_of_sums(spark, sf):
    orders = table(spark, sf, "orders").withColumn("one", F.lit(1))
    rows = aggregates.target_ratio(orders, "o_totalprice", "one", ["o_orderpriority"])
    return rows.withColumn("target_ratio", F.round("target_ratio", 4))


@R.bind(
    "balance_variance",
    "select c_mktsegment, round(var_pop(c_acctbal), 3) as variance from customer group by c_mktsegment",
)
def balance_variance(spark, sf):
    rows = aggregates.pop_variance(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return rows.withColumn("variance", F.round("variance", 3))


@R.bind(
    "ranked_customers",
    """select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) as rank
       from customer""",
)
def ranked_customers(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    order = [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").asc()]
    return ordered.numbered(rows, order, "rank", ordered.slices_for(rows, []))


@R.bind(
    "running_quantity",
    """with daily as (select l_suppkey, l_shipdate, sum(l_quantity) as quantity from lineitem group by all)
       select *, sum(quantity) over (partition by l_suppkey order by l_shipdate) as running from daily""",
)
def running_quantity(spark, sf):
    """A supplier has at most one row per day, so its group fits a task and needs no slices."""
    lines = table(spark, sf, "lineitem")
    daily = lines.groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("quantity"))
    return ordered.running_total(daily, ["l_suppkey"], [F.col("l_shipdate").asc()], "quantity", "running")


@R.bind(
    "interval_pairs",
    """with w as (
           select l_suppkey, l_orderkey, l_linenumber, l_returnflag,
                  datediff('day', timestamp '1970-01-01', l_shipdate) as lo,
                  case l_linenumber when 1 then 45 else 1 + cast(l_quantity as bigint) % 9 end as days
           from lineitem
       )
       select a.l_suppkey, a.l_orderkey as returned_order, a.l_linenumber as returned_line,
              b.l_orderkey as kept_order, b.l_linenumber as kept_line,
              least(a.lo + a.days, b.lo + b.days) - greatest(a.lo, b.lo) as days
       from w as a join w as b on a.l_suppkey = b.l_suppkey and a.lo < b.lo + b.days and b.lo < a.lo + a.days
       where a.l_returnflag = 'R' and b.l_returnflag = 'A'""",
)
def interval_pairs(spark, sf):
    """A supplier's lines that were sent back, against its lines that were kept, where their days on the way meet."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    days = F.when(F.col("l_linenumber") == 1, 45).otherwise(F.col("l_quantity").cast("bigint") % 9 + 1)
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", day.alias("lo"), (day + days).alias("hi")
    )

    def named(flag, name):
        names = {"l_orderkey": f"{name}_order", "l_linenumber": f"{name}_line"}
        return lines.where(F.col("l_returnflag") == flag).drop("l_returnflag").withColumnsRenamed(names)

    return intervals.interval_pairs(named("R", "returned"), named("A", "kept"), ["l_suppkey"], "lo", "hi", "days")


@R.bind(
    "integral_edges",
    """select l_suppkey, cast(sum(cast(l_quantity as bigint)) as bigint) as headcount, count(*) as n
       from lineitem where l_quantity > 0 group by l_suppkey""",
)
def integral_edges(spark, sf):
    whole = table(spark, sf, "lineitem").select("l_suppkey", scalars.to_integral("l_quantity").alias("q"))
    return whole.where("q > 0").groupBy("l_suppkey").agg(
        F.sum("q").alias("headcount"), F.count("*").alias("n")
    )


@R.bind(
    "status_labels",
    """select case code when 0 then 'optimal_within_2pct_gap' when 1 then 'iteration_or_time_limit_reached'
                        when 2 then 'infeasible' when 3 then 'unbounded' when 4 then 'other'
                        else 'unknown_status_' || code end as label, count(*) as n
       from (select cast(left(o_orderpriority, 1) as int) as code from orders) group by label""",
)
def status_labels(spark, sf):
    code = F.left(F.col("o_orderpriority"), F.lit(1)).cast("int")
    label = scalars.map_codes(code, reallocation.STATUS_LABELS)
    return table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@R.bind(
    "display_rows",
    """select o_orderkey, case when o_orderstatus = 'F' then 'yes' else 'no' end as finished,
              format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) as total,
              strftime(o_orderdate, '%Y%m%dT%H%M%SZ') as stamp,
              strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') as shown
       from orders""",
)
def display_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        scalars.fmt_yes_no(F.col("o_orderstatus") == "F").alias("finished"),
        scalars.fmt_thousands("o_totalprice").alias("total"),
        scalars.utc_stamp("o_orderdate").alias("stamp"),
        scalars.utc_display("o_orderdate").alias("shown"),
    )

"""Checks bound to the test tables. Each returns report rows or failing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import Registry, table
from plumbline.operators import aggregates, checks, joins

R = Registry()


@R.bind(
    "check_unique_nulls",
    """select 'unique(quality)' as "check", 'warn' as severity, count(*) as failing_rows,
              min(concat_ws('|', quality::varchar, n::varchar)) as sample
       from (select quality, count(*) as n from documents left join labels using (doc_id)
             where quality is not null group by quality having n > 1)""",
)
def check_unique_nulls(spark, sf):
    """Documents without a label have no quality; their missing keys are no duplicates."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    rated = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return checks.report([checks.unique(rated, ["quality"], "warn")])


@R.bind(
    "check_unique",
    """select 'unique(o_orderkey)' as "check", 'error' as severity, count(*) as failing_rows,
              min(concat_ws('|', o_orderkey::varchar, n::varchar)) as sample
       from (select o_orderkey, count(*) as n from orders group by 1 having n > 1)
       union all
       select 'unique(l_orderkey,l_linenumber)', 'warn', count(*),
              min(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, n::varchar))
       from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having n > 1)
       union all
       select 'unique(conv_id)', 'warn', count(*), min(concat_ws('|', conv_id::varchar, n::varchar))
       from (select conv_id, count(*) as n from conversations group by 1 having n > 1)""",
)
def check_unique(spark, sf):
    return checks.report(
        [
            checks.unique(table(spark, sf, "orders"), ["o_orderkey"]),
            checks.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "warn"),
            checks.unique(table(spark, sf, "conversations"), ["conv_id"], "warn"),
        ]
    )


@R.bind(
    "check_not_null",
    """with joined as (select d.doc_id, l.quality, l.toxic from documents as d left join labels as l using (doc_id))
       select 'quality' as "check", 'warn' as severity, count(*) filter (where quality is null) as failing_rows,
              min(doc_id::varchar) filter (where quality is null) as sample from joined
       union all
       select 'toxic', 'warn', count(*) filter (where toxic is null),
              min(doc_id::varchar) filter (where toxic is null) from joined
       union all
       select 'doc_id', 'error', count(*) filter (where doc_id is null), null from joined""",
)
def check_not_null(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    rules = {
        "quality": (F.col("quality").isNull(), "warn"),
        "toxic": (F.col("toxic").isNull(), "warn"),
        "doc_id": (F.col("doc_id").isNull(), "error"),
    }
    return checks.rule_report(joined, rules, ["doc_id"])


@R.bind(
    "check_range",
    """select 'quantity_positive' as "check", 'error' as severity,
              count(*) filter (where l_quantity <= 0) as failing_rows,
              min(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar)) filter (where l_quantity <= 0) as sample
       from lineitem
       union all
       select 'discount_below_ten_percent', 'warn', count(*) filter (where l_discount >= 0.1),
              min(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar)) filter (where l_discount >= 0.1)
       from lineitem
       union all
       select 'tax_not_negative', 'error', count(*) filter (where l_tax < 0),
              min(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar)) filter (where l_tax < 0)
       from lineitem""",
)
def check_range(spark, sf):
    rules = {
        "quantity_positive": (F.col("l_quantity") <= 0, "error"),
        "discount_below_ten_percent": (F.col("l_discount") >= 0.1, "warn"),
        "tax_not_negative": (F.col("l_tax") < 0, "error"),
    }
    return checks.rule_report(table(spark, sf, "lineitem"), rules, ["l_orderkey", "l_linenumber"])


@R.bind(
    "negative_balances",
    "select c_custkey, c_acctbal from customer where not c_acctbal >= 0",
)
def negative_balances(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return checks.in_range(rows, "c_acctbal", 0, severity="warn").failing


@R.bind(
    "check_domain",
    """select o_orderkey, o_orderstatus from orders where coalesce(o_orderstatus not in ('F', 'O'), true)""",
)
def check_domain(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return checks.in_domain(rows, "o_orderstatus", ["F", "O"], "warn").failing


@R.bind(
    "check_foreign_key",
    """select 'l_orderkey' as "check", 'error' as severity, count(*) as failing_rows, min(k::varchar) as sample
       from (select distinct l_orderkey as k from lineitem anti join orders on l_orderkey = o_orderkey)
       union all
       select 'user_id', 'error', count(*), min(k::varchar)
       from (select distinct user_id as k from events anti join customer on user_id = c_custkey)
       union all
       select 'doc_id', 'warn', count(*), min(k::varchar)
       from (select distinct d.doc_id as k from documents as d anti join labels as l on d.doc_id = l.doc_id)""",
)
def check_foreign_key(spark, sf):
    t = lambda name: table(spark, sf, name)
    return checks.report(
        [
            checks.foreign_key(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", name="l_orderkey"),
            checks.foreign_key(t("events"), t("customer"), "user_id", "c_custkey", name="user_id"),
            checks.foreign_key(t("documents"), t("labels"), "doc_id", severity="warn", name="doc_id"),
        ]
    )


@R.bind(
    "missing_members",
    "select distinct doc_id from documents where doc_id not in (select doc_id from labels)",
)
def missing_members(spark, sf):
    return joins.missing_members(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@R.bind(
    "customers_or_users",
    """select coalesce(c.k, u.k) as k, case when u.k is null then 'left' else 'right' end as side
       from (select distinct o_custkey as k from orders) as c
       full join (select distinct user_id as k from events) as u on c.k = u.k
       where c.k is null or u.k is null""",
)
def customers_or_users(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    users = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    return joins.symmetric_diff(buyers, users, "k")


@R.bind(
    "coverage_of_nations",
    """select distinct n_nationkey as nationkey, 'missing' as problem from nation
       where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 0)
       union all
       select distinct s_nationkey, 'excluded' from supplier where s_acctbal > 0 and s_nationkey in (3, 7)""",
)
def coverage_of_nations(spark, sf):
    held = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nationkey"))
    members = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"))
    return checks.coverage(held, "nationkey", members, [3, 7]).failing


_COPY = """
with copy as (
    select p_partkey, p_brand, nullif(p_size, 11) as p_size from part
    where p_partkey in (select l_partkey from lineitem where l_quantity < 5)
)
"""


@R.bind(
    "reference_agreement",
    _COPY
    + """select p_partkey, 'only in left' as problem from part anti join copy using (p_partkey)
         union all
         select p_partkey, 'differs: p_size' from part as a join copy as b using (p_partkey)
         where a.p_size is distinct from b.p_size""",
)
def reference_agreement(spark, sf):
    part = table(spark, sf, "part")
    used = table(spark, sf, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("p_partkey")).distinct()
    copy = part.join(used, "p_partkey").select(
        "p_partkey", "p_brand", F.expr("nullif(p_size, 11)").alias("p_size")
    )
    return checks.tables_agree(part, copy, ["p_partkey"], ["p_brand", "p_size"]).failing


@R.bind(
    "guard_counts",
    """select 'nation' as source, 'n_nationkey' as guard, sum(n_nationkey)::double as actual,
              300.0::double as expected, sum(n_nationkey) = 300 as ok from nation
       union all select 'nation', 'row_count', count(*)::double, 25.0, count(*) = 25 from nation
       union all select 'region', 'row_count', count(*)::double, 6.0, count(*) = 6 from region
       union all select 'lineitem', 'l_tax', round(sum(l_tax), 2), 1.0, round(sum(l_tax), 2) = 1 from lineitem
       union all select 'orders', 'row_count', count(*)::double, 0.0, count(*) = 0 from orders""",
)
def guard_counts(spark, sf):
    def guarded(name, sums, rows=None, df=None):
        df = df if df is not None else table(spark, sf, name)
        return aggregates.column_sums(df, sums, rows).select(F.lit(name).alias("source"), "*")

    nation = guarded("nation", {"n_nationkey": 300}, 25)
    region = guarded("region", {}, 6)
    lines = guarded("lineitem", {"l_tax": 1}).withColumns(
        {"actual": F.round("actual", 2), "ok": F.round("actual", 2) == F.col("expected")}
    )
    return nation.unionAll(region).unionAll(lines).unionAll(guarded("orders", {}, 0))


@R.bind(
    "row_count_findings",
    """select 'orders' as source, count(*) as actual_rows from orders having count(*) <> 0
       union all select 'nation', count(*) from nation having count(*) <> 25
       union all select 'documents', count(*) from documents having count(*) <> 1""",
)
def row_count_findings(spark, sf):
    found = [
        aggregates.count_not(table(spark, sf, name), n).select(F.lit(name).alias("source"), "actual_rows")
        for name, n in (("orders", 0), ("nation", 25), ("documents", 1))
    ]
    return found[0].unionAll(found[1]).unionAll(found[2])


@R.bind(
    "reconcile_total",
    """with a as (select sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as actual from lineitem),
            e as (select sum(o_totalprice) as expected from orders)
       select round(actual, 2) as actual, round(expected, 2) as expected,
              round(abs(actual - expected) / expected, 6) as pct_diff,
              abs(actual - expected) / expected > 0.05 as outside
       from a, e""",
)
def reconcile_total(spark, sf):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf, "lineitem").select(charge.alias("charge"))
    expected = table(spark, sf, "orders").agg(F.sum("o_totalprice").alias("t")).scalar()
    found = checks.reconciliation(lines, "charge", expected)
    return found.select(
        F.round("actual", 2).alias("actual"), F.round("expected", 2).alias("expected"),
        F.round("pct_diff", 6).alias("pct_diff"), (F.col("pct_diff") > 0.05).alias("outside"),
    )

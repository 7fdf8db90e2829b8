"""Write and read back. Every query writes below a fresh scratch path in the shared folder."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F, types as T

from plumbline.bindings.common import Registry, table
from plumbline.bindings.levelling import FLAGS, SUPPLIERS, supplier_input
from plumbline.functions.scalars import stamp
from plumbline.operators.joins import tag
from plumbline.plans import reallocation
from plumbline.session import scratch_path
from plumbline.sources import readers, writers

R = Registry()

# Two run times.
FIRST = datetime(2025, 1, 1, 12, 0, tzinfo=UTC)
SECOND = datetime(2025, 1, 2, 12, 0, tzinfo=UTC)

_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders"


def _utc(name: str):
    """The instant as a UTC clock reading, whatever the session's time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(name))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )


@R.bind("rt_snapshot_csv", _ORDERS)
def rt_snapshot_csv(spark, sf):
    orders = _orders(spark, sf)
    path = writers.write_snapshot_csv(orders, scratch_path(spark, "snapshot"), "orders", FIRST)
    return readers.read_seed(spark, path, orders.schema)


@R.bind("rt_append_if_absent", _ORDERS)
def rt_append_if_absent(spark, sf):
    """Finished orders land first; the full batch, given twice, then adds only what is new."""
    orders, target = _orders(spark, sf), scratch_path(spark, "append")
    keys, parts = ["o_orderkey", "o_orderstatus"], ["o_orderstatus"]
    writers.append_if_absent(orders.where("o_orderstatus = 'F'"), target, keys, parts)
    writers.append_if_absent(orders.unionAll(orders), target, keys, parts)
    return spark.read.parquet(target).select(*orders.columns)


@R.bind("rt_reload", _ORDERS)
def rt_reload(spark, sf):
    """The second load replaces the first."""
    orders, root = _orders(spark, sf), scratch_path(spark, "reload")
    customer = table(spark, sf, "customer")
    writers.reload_tables({"orders": orders.where("o_orderstatus = 'F'"), "customer": customer}, root, FIRST)
    writers.reload_tables({"orders": orders, "customer": customer}, root, SECOND)
    return writers.read_table(spark, root, "orders")


@R.bind(
    "rt_run_latest",
    SUPPLIERS
    + """select problem, cadre, from_region, to_region, headcount, timestamp '2025-01-02 12:00:00' as run_at
         from edges""",
)
def rt_run_latest(spark, sf):
    """Two runs, the first without transfers; only the second is read back."""
    done = reallocation.level(supplier_input(spark, sf), FLAGS)
    rows = reallocation.allocations(done.regions, done.edges)
    summary, root = reallocation.run_summary(rows), scratch_path(spark, "runs")
    writers.write_run(done.edges.where("headcount < 0"), rows, summary, root, FIRST)
    writers.write_run(done.edges, rows, summary, root, SECOND)
    _, edges, _ = writers.read_latest_run(spark, root)
    return edges.withColumn("run_at", _utc("run_at"))


@R.bind(
    "rt_commented_csv",
    "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
)
def rt_commented_csv(spark, sf):
    """Suppliers as CSV with a comment line per nation in between."""
    supplier = table(spark, sf, "supplier")
    schema = T.StructType([T.StructField(f.name, f.dataType, False) for f in supplier.schema])
    text = supplier.select(*[F.col(c).cast("string").alias(c) for c in supplier.columns])
    note = F.concat(F.lit("  # cited from "), F.col("n_name"))
    notes = table(spark, sf, "nation").select(
        note.alias("s_suppkey"), *[F.lit(None).cast("string").alias(c) for c in supplier.columns[1:]]
    )
    path = scratch_path(spark, "commented")
    text.unionAll(notes).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return readers.read_commented_csv(spark, path, schema)


@R.bind(
    "rt_pages_json",
    """select event_id as record_id, user_id as location_id, event_type as indicator_name,
              cast(year(ts) as int) as year, value, ts as updated_at
       from events where event_type <> 'error'""",
)
def rt_pages_json(spark, sf):
    """Events as landed pages of at most 100 results; error events carry a period no year parses from."""
    events = table(spark, sf, "events")
    kinds = ["view", "click", "purchase", "signup", "error"]
    indicators = spark.createDataFrame(list(enumerate(kinds)), "indicator_id INT, indicator_name STRING")
    entities = events.select(F.col("user_id").cast("int").alias("location_id")).distinct().withColumn(
        "location_name", F.col("location_id").cast("string")
    )
    label = F.when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM")).otherwise(
        F.date_format("ts", " yyyy ")
    )
    result = F.struct(
        F.col("event_id").alias("id"), label.alias("period"), F.col("value").cast("string").alias("value"),
        F.col("ts").cast("string").alias("updated_at"),
    )
    page = F.floor(F.col("event_id") / 100)
    keyed = tag(events.withColumn("indicator_name", F.col("event_type")), indicators, "indicator_name")
    pages = keyed.groupBy(
        "indicator_id", F.col("user_id").cast("int").alias("location_id"), page.alias("_page")
    ).agg(F.collect_list(result).alias("results"))
    landed = pages.drop("_page").withColumns({"datasource_id": F.lit(6), "fetched_at": F.lit(FIRST)})
    path = scratch_path(spark, "pages")
    landed.write.json(path)
    rows = readers.load_observation_pages(readers.read_pages(spark, path), indicators, entities, (2015, 2025))
    return rows.select(
        "record_id", F.col("location_id").cast("bigint").alias("location_id"), "indicator_name", "year",
        "value", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )


@R.bind(
    "rt_mart_and_provenance",
    """select c_custkey, c_name, c_acctbal, 'survey' as source_label,
              timestamp '2025-01-01 12:00:00' as fetched_at
       from customer order by c_custkey""",
)
def rt_mart_and_provenance(spark, sf):
    """Publish a stamped mart, then read it under its declared schema."""
    rows = stamp(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "survey", FIRST)
    path = scratch_path(spark, "mart")
    writers.publish(rows, "customers", "table", path)
    declared = T.StructType(
        [
            T.StructField("c_custkey", T.LongType(), False),
            T.StructField("c_name", T.StringType(), False),
            T.StructField("c_acctbal", T.DoubleType()),
            T.StructField("source_label", T.StringType(), False),
            T.StructField("fetched_at", T.TimestampType(), False),
        ]
    )
    mart = readers.read_mart(spark, path, declared, ["c_custkey"])
    return mart.withColumn("fetched_at", _utc("fetched_at"))

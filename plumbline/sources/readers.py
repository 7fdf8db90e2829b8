"""Reading landed files under declared schemas."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.scalars import BLANKS, parse_year, stamp, strip
from plumbline.operators import checks
from plumbline.operators.joins import tag
from plumbline.sources import writers


def read_commented_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose comment lines start, after any blanks, with ``#``, anywhere in the file.

    Each file has a header of its own, which must name exactly the schema's columns, in any order;
    the distinct header lines are all that the driver reads. Lines of blanks are skipped. A malformed
    row stops the read with its file and text, an empty field of a non-nullable column with its name.
    """
    text = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    lines = text.where(~F.col("value").rlike(f"^{BLANKS}*(#|$)"))
    # The first line of each file that is no comment, taken from the file's first block.
    placed = lines.where("block = 0").select("file", "value", F.monotonically_increasing_id().alias("at"))
    headers = placed.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    kinds = [r[0] for r in headers.select("header").distinct().collect()]
    if not kinds:
        raise checks.CheckFailed(f"{path}: no header line")
    bad, row = "_bad", F.lit(None)
    by_name = T.StructType([T.StructField(c, schema[c].dataType) for c in schema.names])
    for kind in kinds:
        header = next(csv.reader([kind]))
        if sorted(header) != sorted(schema.names):
            missing, extra = set(schema.names) - set(header), set(header) - set(schema.names)
            where = headers.where(F.col("header") == kind).agg(F.min("file")).first()[0]
            raise checks.CheckFailed(f"{where}: missing columns {sorted(missing)}, extra {sorted(extra)}")
        in_file_order = T.StructType([T.StructField(c, schema[c].dataType) for c in header]).add(bad, T.StringType())
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": '"'}
        parsed = F.from_csv("value", in_file_order.toDDL(), options)
        named = F.struct(*[parsed[c].alias(c) for c in schema.names], parsed[bad].alias(bad))
        row = F.when(F.col("header") == kind, named).otherwise(row)
    # One header for all files, as usual, needs no join.
    told = lines.withColumn("header", F.lit(kinds[0])) if len(kinds) == 1 else lines.join(headers, "file")
    rows = told.where(F.col("value") != F.col("header")).select("file", "value", row.alias("r"))
    kind = by_name.simpleString()
    stop = F.raise_error(F.concat("file", F.lit(": malformed row: "), "value")).cast(f"{kind[:-1]},{bad}:string>")
    rows = rows.select("file", F.when(F.col("r")[bad].isNull(), F.col("r")).otherwise(stop).alias("r"))
    return rows.select("file", "r.*").select(*[_required(f, path) for f in schema])


def _required(field: T.StructField, path: str) -> Column:
    c = F.col(field.name)
    return c if field.nullable else _present(c, field.dataType, field.name, path)


def _present(c: Column, kind: T.DataType | str, name: str, where: str = "landed page") -> Column:
    """The value, or an error naming the column where it is missing."""
    stop = F.raise_error(F.lit(f"{where}: no value in column {name}")).cast(kind)
    return F.when(c.isNotNull(), c).otherwise(stop).alias(name)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Seed dimension: CSV with header and declared schema; an empty field is NULL."""
    return spark.read.csv(path, schema=schema, header=True, escape='"', mode="FAILFAST", enforceSchema=False)


def read_zip_member(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """Text columns of one CSV member of each zip file. Files are spread over tasks and read in
    chunks, so no task holds more than one archive and one chunk. An archive must be smaller than
    2 GiB, the most that Spark reads as one binary value; a larger one is an error."""
    wanted = list(columns)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as f:
                    chunks = pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=50_000)
                    for chunk in chunks:
                        yield chunk[wanted]

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unpack, ", ".join(f"`{c}` STRING" for c in wanted))


def load_population_snapshot(
    spark: SparkSession,
    path: str,
    member: str,
    where: tuple[str, str],
    rename: dict[str, str],
    label: str,
    fetched_at: datetime,
) -> DataFrame:
    """One member of a landed zip: rows whose ``where`` column equals the value after stripping,
    renamed; every column but the first two (the names) cast to double; provenance stamped."""
    raw = read_zip_member(spark, path, member, list(rename))
    kept = raw.where(strip(where[0]) == where[1])
    names = list(rename)[:2]
    cols = [
        (strip(src) if src in names else F.col(src).cast("double")).alias(out)
        for src, out in rename.items()
    ]
    return stamp(kept.select(*cols), label, fetched_at)


PAGE_SCHEMA = (
    "indicator_id INT, datasource_id INT, location_id INT, fetched_at TIMESTAMP, "
    "results ARRAY<STRUCT<id: BIGINT, period: STRING, value: STRING, updated_at: STRING>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed response pages, one JSON object per line, stamped with the keys of the request."""
    return spark.read.schema(PAGE_SCHEMA).json(path, mode="FAILFAST")


def load_observation_pages(
    pages: DataFrame,
    indicators: DataFrame,
    entities: DataFrame,
    year_range: tuple[int, int],
) -> DataFrame:
    """Observation rows of the pages: one per result whose period is a year in range.

    A value or time that is missing or does not parse stops the read.
    """
    lo, hi = year_range
    rows = (
        pages.select(
            "indicator_id", "datasource_id", "location_id", "fetched_at", F.inline("results")
        )
        .withColumn("year", parse_year("period", lo, hi))
        .where("year is not null")
    )
    return (
        tag(rows, indicators.select("indicator_id", "indicator_name"), "indicator_id")
        .join(entities.select("location_id", "location_name"), "location_id")
        .select(
            _present(F.col("id"), "bigint", "record_id"), "indicator_id", "indicator_name",
            "datasource_id", "location_id", "location_name", "period", "year",
            _present(strip("value").cast("double"), "double", "value"),
            _present(F.col("updated_at").cast("timestamp"), "timestamp", "updated_at"), "fetched_at",
        )
    )


def full_pages(pages: DataFrame, page_size: int) -> checks.Check:
    """Pages exactly as long as the page size may have been cut: a warning."""
    rows = pages.where(F.size("results") == page_size).select("indicator_id", "location_id")
    return checks.Check("full_pages", "warn", rows)


def read_mart(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    order: Sequence[str | Column],
    rows: int | None = None,
    rules: Sequence[checks.Check] = (),
) -> DataFrame:
    """A stored table, checked again by its reader: exact columns, no NULL where none is allowed,
    the expected row count and any further rules; then ordered. Published tables (see ``publish``) are
    read in their current version, other folders as they are."""
    published = writers.current_version(spark, path, writers.MART)
    df = writers.read_table(spark, path, writers.MART) if published else spark.read.parquet(path)
    checks.exact_schema(df, schema)
    required = [f.name for f in schema if not f.nullable]
    todo = [checks.not_null(df, required)] if required else []
    if rows is not None:
        todo.append(checks.row_count(df, rows))
    if todo or rules:
        checks.enforce([*todo, *rules])
    return df.select(*schema.names).orderBy(*order)

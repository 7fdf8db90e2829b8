"""Result tables ready to show. Data only: names, numbers and formatted text, no markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import (
    fmt_percent, fmt_six_decimals, fmt_thousands, fmt_yes_no, pct_of_max, utc_display,
)
from plumbline.functions.text import html_escape
from plumbline.operators.ordered import numbered
from plumbline.plans.reallocation import SUCCESS_LABELS


def scorecard_table(
    scorecard: DataFrame, name: str = "location_name", estimate: str = "population_mean",
    slices: int | str | None = "auto", top: int | None = None,
) -> DataFrame:
    """Numbered scorecard rows with bar widths relative to the highest score.

    ``top`` keeps the worst rows only, before numbering.
    """
    order = [F.col("score").desc_nulls_last(), F.col(name).asc()]
    highest = scorecard.agg(F.coalesce(F.max("score"), F.lit(0))).scalar()
    rows = scorecard.withColumn("bar_pct", pct_of_max("score", highest))
    if top is not None:
        rows = rows.orderBy(*order).limit(top)
    return numbered(rows, order, "rank", slices).select(
        "rank",
        html_escape(name).alias("name"),
        "score",
        "bar_pct",
        fmt_yes_no("attrition_flag").alias("attrition"),
        fmt_yes_no("impossible_flag").alias("impossibility"),
        "incidents",
        fmt_percent("completeness_fraction").alias("completeness"),
        fmt_thousands(estimate).alias("population"),
        html_escape(F.coalesce("reasons", F.lit(""))).alias("reasons"),
    )


def transfer_table(edges: DataFrame) -> DataFrame:
    return edges.select(
        *[html_escape(c).alias(c) for c in ("cadre", "from_region", "to_region")], "headcount"
    ).orderBy("from_region", "to_region", "cadre")


def allocation_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        html_escape("region").alias("region"), "grand_total_before", "grand_total_after",
        fmt_thousands("denominator").alias("denominator"),
        fmt_six_decimals("ratio_before").alias("ratio_before"),
        fmt_six_decimals("ratio_after").alias("ratio_after"),
    ).orderBy("region")


def run_table(summary: DataFrame) -> DataFrame:
    """Header of a run: variances, whether they improved, and whether the run succeeded.

    ``run_at`` is shown in UTC when present. Variances stay numbers; they are not formatted.
    """
    shown = {"run_at_text": utc_display("run_at")} if "run_at" in summary.columns else {}
    return summary.withColumns(
        {
            **shown,
            "improved": F.when(F.col("variance_after") < F.col("variance_before"), "improved").otherwise(
                "NOT improved"
            ),
            "succeeded": F.col("solver_status").isin(*SUCCESS_LABELS),
        }
    )

"""Two helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """``value`` as a generated column. Spark moves filters on a plain column below the projection that
    makes it and repeats the expression there, inside lambdas even for each element; not so here."""
    return F.explode(F.array(value))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Bounded samples that are the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_share(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """Rows whose hashed ``key`` falls into one of so many equal classes that some more than ``wanted`` are expected.

    All rows if there are few. A limit on the result then reaches the driver or one task with a bounded
    number of rows, however many tasks there are. Rows of one key stay together; null keys leave.
    """
    classes = max(1, rows.count() // max(2 * wanted, 1))
    return rows.where((F.pmod(F.xxhash64(F.lit(23), key), F.lit(classes)) == 0) & F.col(key).isNotNull())

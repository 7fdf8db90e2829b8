"""A numbered log of commits beside a table's files, for writers that do not know of each other.

Every attempt writes to folders of its own name. An entry of the log, a small file named by its
number, makes an attempt part of the table. An entry appears with its whole content and only if its
number is free, so of two writers that want the same number one is told so and can look at what the
other did. What no entry names is never read.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = "number BIGINT, attempt STRING"
ATTEMPT = "_attempt"  # the column and folder that name an attempt
MAX_TRIES = 50


class Conflict(RuntimeError):
    """Other writers were faster ``MAX_TRIES`` times."""


def new_attempt() -> str:
    """A new attempt's name; names sort as attempts begin."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content unless there is one; whether this call did.

    The content is written beside the target and then linked (local disks) or renamed (HDFS and others
    whose rename refuses an existing target) to its name in one step.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(draft, target))
        os.link(draft.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


@dataclass(frozen=True)
class CommitLog:
    """The log of the table below ``root``. Entries are read by Spark, not gathered on the driver."""

    spark: SparkSession
    root: str

    def entries(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """(number, attempt) of the entries with ``after`` < number <= ``upto``."""
        try:
            rows = self.spark.read.schema(ENTRY).json(f"{self.root}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], ENTRY)
        rows = rows.where(F.col("number") > after)
        return rows if upto is None else rows.where(F.col("number") <= upto)

    def last(self) -> int:
        return self.entries().agg(F.max("number")).first()[0] or 0

    def commit(self, number: int, attempt: str) -> bool:
        """Add entry ``number``; False if another writer has added it."""
        return create_file(self.spark, f"{self.root}/log/{number:020d}.json", f'{{"number": {number}, "attempt": "{attempt}"}}\n')

    def folder(self, kind: str, attempt: str) -> str:
        return f"{self.root}/{kind}/{ATTEMPT}={attempt}"

    def parts(self, kind: str, schema: str, after: int = 0, upto: int | None = None) -> DataFrame:
        """The rows that committed attempts wrote to ``kind``, with their entry's ``number``."""
        entries = self.entries(after, upto)
        try:
            rows = self.spark.read.schema(f"{schema}, {ATTEMPT} STRING").parquet(f"{self.root}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{schema}, {ATTEMPT} STRING")
        return rows.join(entries.withColumnRenamed("attempt", ATTEMPT), ATTEMPT)

"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave import session

#: Rows that cross to a Python worker at once. Documents may be megabytes long, so a batch has few of them.
ARROW_ROWS = 256


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of the Arrow batches of the plans made from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def in_small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Bound the rows of the Arrow batches of what runs inside; the session is left as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Spark then removes the shuffle files of a query when it ends, and not when the driver's garbage happens to be collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A table of ``df`` in the shared folder (see :func:`cellweave.session.materialise`).

    Once a round is written, its shuffle files are as large as the round and of no use; they go with the write.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return session.materialise(df, name)
    finally:
        conf.set(CLEAN_UP, before)


def set_apart(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with the columns ``needed`` under these names and all others numbered, so that no name of the caller's meets one
    of an operator's own. ``toDF(*docs.columns)`` gives the names back."""
    low = [c.lower() for c in docs.columns]
    names = [f"_{i}" for i in range(len(low))]
    for n in needed:
        names[docs.columns.index(n) if n in docs.columns else low.index(n.lower())] = n
    return docs.toDF(*names)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id written in decimal, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % folds

"""Reads that arrive as files, counted per cell and gene as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.schema import READS, normalise_columns


def stream_reads(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_columns(spark.readStream.schema(READS).parquet(folder))


def stream_counts(reads: DataFrame, min_quality: float = 20) -> DataFrame:
    """The running count matrix; write it in update or complete mode."""
    good = reads.filter((F.col("qv") > min_quality) & F.col("cell_id").isNotNull())
    return good.groupBy("cell_id", "feature_name").agg(F.count("*").alias("n"))

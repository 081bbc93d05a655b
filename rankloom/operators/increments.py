"""Counts and totals that are kept up to date: each batch of rows adds its partial sums, old rows are not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"


def add_batch(df: DataFrame, by: Sequence[str], path: str, batch: str, measure: str | None = None) -> None:
    """Write the partial sums of a batch of rows below `path`. A batch that is written again replaces itself, so a job
    that failed is simply run again."""
    sums = [F.count("*").alias("n")] if measure is None else [F.count("*").alias("n"), F.sum(measure).alias("total")]
    df.groupBy(*by).agg(*sums).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def merged_counts(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """(by, count): rows of all batches, by some or all of the columns that they were summed by."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("n").alias("count"))


def merged_totals(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """(by, total_popularity): the sums of the measure over all batches."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("total").alias("total_popularity"))

"""Sums for several questions from one reading: grouping sets, written once, of which each question reads its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SET = "_set"


def _name(columns: Sequence[str]) -> str:
    return "-".join(sorted(columns))


def write_question_sums(df: DataFrame, sets: Sequence[Sequence[str]], path: str, measure: str = "pop") -> None:
    """Write rows and sums of `measure` by each of the column sets below `path`, from one reading of `df` and one
    shuffle. A set that is asked for twice, in any order, is summed once."""
    wanted = list({_name(columns): list(columns) for columns in sets}.values())
    every = list(dict.fromkeys(name for columns in wanted for name in columns))
    summed = df.groupingSets(wanted, *every).agg(
        F.count("*").alias("count"), F.sum(measure).alias("total_popularity"), F.grouping_id().alias("_id")
    )
    # the grouping id has a bit for each column that a set leaves out, the first column's the highest
    left_out = lambda columns: sum(1 << k for k, name in enumerate(reversed(every)) if name not in columns)
    of = F.create_map([F.lit(x) for columns in wanted for x in (left_out(columns), _name(columns))])
    named = summed.withColumn(SET, F.element_at(of, F.col("_id").cast("int"))).drop("_id")
    df.sparkSession.createDataFrame([], named.schema).write.parquet(f"{path}/columns")
    named.write.partitionBy(SET).parquet(f"{path}/sums")


def question_sums(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """(columns, count, total_popularity) of one set, read alone."""
    schema = spark.read.parquet(f"{path}/columns").schema
    found = spark.read.schema(schema).parquet(f"{path}/sums").where(F.col(SET) == _name(columns))
    return found.select(*columns, "count", "total_popularity")

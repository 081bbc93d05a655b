"""Distinct counts over any span of groups from a stored table of bitmaps, exact and without reading the rows again.

Entities are numbered without gaps. A group has a bitmap for each run of 32,768 numbers in which it has an entity, and
bitmaps of several groups merge by `or`, which no count of distinct entities does. Rows that come later are added as a
batch: entities that are new get the next numbers, and the batch has bitmaps of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.positions import POSITION, read_positions, write_positions
from rankloom.sources.sinks import drop_folder, there


BATCH = "_batch"


def write_bitmaps(df: DataFrame, groups: Sequence[str], entity: str, path: str, batch: int = 0) -> None:
    """Write the bitmaps of the entities of each group, below `path`; with a larger `batch`, those of rows that are
    added. Rows of earlier batches are not read again. The last batch replaces itself, so a job that failed is simply
    run again; an earlier one cannot be written again, as later ones build on its numbers. Null entities count nowhere.
    """
    spark, numbers = df.sparkSession, f"{path}/numbers"
    pairs = df.select(*groups, entity).where(F.col(entity).isNotNull()).distinct()
    new, known = pairs.select(entity).distinct(), None
    if there(spark, numbers):
        known = spark.read.parquet(numbers)
        if (known.agg(F.max(BATCH)).first()[0] or 0) > batch:
            raise ValueError(f"batches after {batch} are there already")
        known = known.where(F.col(BATCH) < batch)
        new = new.join(known, entity, "left_anti")
    used = known.agg(F.coalesce(F.max("_number"), F.lit(0))).first()[0] if known is not None else 0
    drop_folder(spark, f"{path}/order")
    write_positions(new, [entity], f"{path}/order")
    own = read_positions(spark, f"{path}/order").select(entity, (F.col(POSITION) + used).alias("_number"))
    own.write.mode("overwrite").parquet(f"{numbers}/{BATCH}={batch}")
    # the numbers are a written table and one row an entity: Spark can split an entity that many groups share
    numbered = pairs.join(spark.read.parquet(numbers).drop(BATCH), entity)
    bucket = F.bitmap_bucket_number("_number").alias("_bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("_bits")
    numbered.groupBy(*groups, bucket).agg(bits).write.mode("overwrite").parquet(f"{path}/bitmaps/{BATCH}={batch}")


def distinct_in(spark: SparkSession, path: str, *by: str, where: Column | str | None = None) -> DataFrame:
    """(by, count): distinct entities by some of the groups, or over all of them, among the groups that `where` keeps.
    Groups that it keeps none of have no row; without `by` there is one row in any case."""
    found = spark.read.parquet(f"{path}/bitmaps")
    if where is not None:
        found = found.where(where)
    merged = found.groupBy(*by, "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("n"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))

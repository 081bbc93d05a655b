"""A positional index: the rows of a sorted table, kept with where each stands, so that any page is read alone.

The table is cut into ranges by its order, each range is sorted and written as a partition of its own, and an index
holds one row a partition: its number of rows and the number of rows before it. A page then reads the partitions that
it touches and no others, however far into the table it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rankloom.operators.tables import sort_columns
from rankloom.sources.sinks import drop_folder

#: Names of the columns that the index adds to the rows it keeps.
PART, PLACE, POSITION = "_part", "_place", "position"


def _place() -> Column:
    """A row's number in its partition, from 0: the lower 33 bits of Spark's running id."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def write_positions(
    df: DataFrame, order: Sequence[str], path: str, partitions: int | None = None, nulls_first: bool = False
) -> None:
    """Write `df`, sorted by `order` (see `sort_table`; `nulls_first` where the order columns have them first), with its
    index below `path`.

    Rows that are equal in all columns are told apart by a running number, so that even a row that fills much of the
    table is cut into several ranges. The rows are written once before they are cut: a task that runs again then
    numbers them as it did before.
    """
    spark, row = df.sparkSession, "_row"
    df.write.parquet(f"{path}/unsorted")
    df = spark.read.parquet(f"{path}/unsorted")
    df.limit(0).write.parquet(f"{path}/columns")
    keys = [*sort_columns(df, order, nulls_first), F.col(row)]
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    cut = numbered.repartitionByRange(partitions, *keys) if partitions else numbered.repartitionByRange(*keys)
    placed = cut.sortWithinPartitions(*keys).drop(row).withColumns({PART: F.spark_partition_id(), PLACE: _place()})
    placed.sortWithinPartitions(PART, PLACE).write.partitionBy(PART).parquet(f"{path}/rows")
    drop_folder(spark, f"{path}/unsorted")
    counted = _rows(spark, path).groupBy(PART).agg(F.count("*").alias("n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(f"{path}/columns").schema.fields
    schema = StructType([*fields, StructField(PLACE, LongType()), StructField(PART, IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def placed_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their `position`, and the range (`PART`) and the place in it that they were written to."""
    index = F.broadcast(_index(spark, path).select(PART, "before"))  # one row a partition
    return _rows(spark, path).join(index, PART).withColumn(POSITION, F.col("before") + F.col(PLACE) + 1).drop("before")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the index with their `position` in the order, from 1; in no order."""
    return placed_rows(spark, path).drop(PART, PLACE)


def page_at(spark: SparkSession, path: str, size: int, number: int = 1) -> DataFrame:
    """Page `number` of `size` rows, in order, with each row's `position`. Reads the partitions that hold it alone."""
    if size < 1 or number < 1:
        raise ValueError("pages and their sizes start at 1")
    first, last = (number - 1) * size, number * size  # positions from 0, the last one excluded
    held = _index(spark, path).where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
    before = {r[PART]: r["before"] for r in held}  # at most `size` partitions
    found = _rows(spark, path).where(F.col(PART).isin(list(before)))
    start = F.lit(0).cast("bigint")
    for part, n in before.items():
        start = F.when(F.col(PART) == part, F.lit(n)).otherwise(start)
    at = start + F.col(PLACE)
    near = max(first - n for n in before.values()) if len(before) == 1 else 0  # lets a scan skip row groups before it
    found = found.where((F.col(PLACE) >= near) & (at >= first) & (at < last))
    return found.withColumn(POSITION, at + 1).drop(PART, PLACE).orderBy(POSITION)

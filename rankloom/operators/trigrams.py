"""A search box over a stored table: which blocks of rows hold which runs of three letters.

The rows are written in blocks, each a partition of its own. A posting says that a run of three letters stands
somewhere in a block. A term can only stand in blocks that hold all of its runs, so a search reads the postings of a
few runs and then those blocks, and looks at their rows as the plain search does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.operators.tables import row_text, search

LETTERS = 3
BLOCK = "_block"


def runs(text: Column, letters: int = LETTERS) -> Column:
    """The different runs of `letters` letters of a text, none if it is shorter. The text is cut into letters once,
    which are then joined by place, so a long text costs no more than its length."""

    def joined(each: Column) -> Column:
        run = lambda letter, at: F.concat(letter, *[F.get(each, at + k) for k in range(1, letters)])
        return F.array_distinct(F.filter(F.transform(each, run), lambda found: found.isNotNull()))

    each = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.get(F.transform(F.array(each), joined), 0)  # a variable is evaluated once, a column at each use


def _runs_of(term: str) -> set[str]:
    return {term[at : at + LETTERS] for at in range(len(term) - LETTERS + 1)}


def write_search_index(df: DataFrame, path: str, columns: Sequence[str] | None = None, block_rows: int = 1_000_000) -> None:
    """Write the rows of `df` in blocks of at most `block_rows`, in the order they come, and the postings of `columns`.

    A block never spans two input partitions. Rows that are alike should stand together, so sort the table first.
    Postings are summed in each task, so a run that is in every row is posted once a block. They are sorted by run.
    """
    spark = df.sparkSession
    block = F.floor(F.monotonically_increasing_id() / block_rows)  # unlike in each input partition, as 2^33 rows apart
    df.limit(0).write.parquet(f"{path}/columns")
    df.withColumn(BLOCK, block).write.partitionBy(BLOCK).parquet(f"{path}/rows")
    rows = _rows(spark, path)
    text = row_text(rows, columns or df.columns)
    posted = rows.select(F.explode(runs(text)).alias("run"), BLOCK).distinct()
    posted.repartitionByRange("run", BLOCK).sortWithinPartitions("run", BLOCK).write.parquet(f"{path}/postings")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(f"{path}/columns").schema.fields
    return spark.read.schema(StructType([*fields, StructField(BLOCK, LongType())])).parquet(f"{path}/rows")


def search_index(spark: SparkSession, path: str, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that `search` finds in the whole table, read from the blocks that may hold them. `columns` as the index
    was written with. Terms of one or two letters narrow nothing; they are looked for in what the others leave."""
    rows = _rows(spark, path)
    asked = set().union(*map(_runs_of, text.lower().split()))
    if asked:
        held = spark.read.parquet(f"{path}/postings").where(F.col("run").isin(sorted(asked)))
        held = held.groupBy(BLOCK).agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
        rows = rows.where(F.col(BLOCK).isin([r[BLOCK] for r in held.collect()]))  # one number a block
    return search(rows.drop(BLOCK), text, columns)

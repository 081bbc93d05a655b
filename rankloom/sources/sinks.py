"""Writers for result tables, and the shared folder for intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; it goes when the session ends.

    Where none is named, a local session gets a temporary folder. On a cluster that would be another folder on every
    machine, so it is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{shared or tempfile.mkdtemp(prefix='rankloom-')}/rankloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{own}/table"


def there(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written to a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet. With `partition_by` rows are gathered by those columns first, so each value gets few files;
    Spark splits a value that holds much of the table among several tasks."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file; quotes inside fields are doubled, blanks kept, nulls written as NA."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "NA")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str, column: str = "json", mode: str = "errorifexists") -> None:
    """One JSON document per line."""
    df.select(column).write.mode(mode).text(path)

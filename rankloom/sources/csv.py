"""CSV reader for chart tables: every field is read as text, then typed by declared rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankloom.fixed_values import CHART_COLUMNS


def _snake(header: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", header.lstrip("﻿").lower()).strip("_")


def _typed(field: Column, kind: str) -> Column:
    """Text: NA is null and a blank stays a blank. Numbers: anything that is no number of that kind is null."""
    if kind == "string":
        return F.when(field == "NA", F.lit(None)).otherwise(F.coalesce(field, F.lit("")))
    number = field.try_cast(kind)
    if kind in ("int", "bigint"):
        wide = field.try_cast("double")
        number = F.coalesce(number, F.when(wide == F.floor(wide), wide.try_cast(kind)))
    return number


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files below a path, those with the same first line together. The driver sees a row a file, as it does when
    Spark lists them."""
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("n"))
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    found: dict[str, list[str]] = {}
    for row in heads.collect():
        found.setdefault(row.head.lstrip("\ufeff").rstrip("\r"), []).append(unquote(row.file))
    return [sorted(files) for _, files in sorted(found.items())]


def read_mixed_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str, str]] = CHART_COLUMNS,
    multi_line: bool = False,
    ragged: str | None = None,
) -> DataFrame:
    """`read_chart_csv` over files whose headers differ: each file's fields go by its own header, in any order, and a
    column that a file lacks is null in its rows. A declared column that no file has is an error.

    The first lines are read ahead, which costs a pass over the text; files with equal headers are then read together.
    An empty file has no header and no rows.
    """
    parts = [read_chart_csv(spark, files, columns, multi_line, ragged, partial=True) for files in _by_header(spark, path)]
    if not parts:
        raise ValueError(f"no CSV header in {path}")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    _check_columns(path, columns, {name for part in parts for name in part.columns})
    return found


def _check_columns(path: object, columns: Sequence[tuple[str, str, str]], found: set[str]) -> None:
    missing = [header for header, name, _ in columns if name not in found]
    if missing:
        raise ValueError(f"columns not in {path}: {', '.join(missing)}")


def read_chart_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[tuple[str, str, str]] = CHART_COLUMNS,
    multi_line: bool = False,
    ragged: str | None = None,
    partial: bool = False,
) -> DataFrame:
    """Read CSV with a header into declared columns (header, name, type); types are never guessed.

    Columns of the file that are not declared are kept as text under snake-case names. Files are split
    among tasks unless `multi_line` is set, which quoted line breaks need. Nothing is lost without notice: files
    whose headers differ fail the job (`read_mixed_csv` reads those), declared columns that are missing are an error
    unless `partial` is set, and so are rows with more or fewer fields than the header, as a quoted line
    break makes them without `multi_line`. With `ragged` such rows are kept, their text in a column of that name.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    headers = reader.option("inferSchema", False).csv(path).columns
    broken = "_broken"
    schema = StructType([StructField(name, StringType()) for name in [*headers, broken]])
    raw = reader.option("enforceSchema", False).option("columnNameOfCorruptRecord", broken).schema(schema).csv(path)
    declared = {_snake(header): (name, kind) for header, name, kind in columns}
    if not partial:
        _check_columns(path, columns, {declared.get(_snake(header), ("",))[0] for header in headers})
    fields = []
    for header in headers:
        name, kind = declared.get(_snake(header), (_snake(header), "string"))
        fields.append(_typed(F.col(f"`{header}`"), kind).alias(name))
    # Spark checks rows only where it also reads a column of theirs; an empty piece of one makes it do so.
    cells = F.concat_ws("", *[F.col(f"`{header}`") for header in headers])
    text = F.concat(F.col(broken), F.substring(cells, 1, 0))
    if ragged:
        return raw.select(*fields, F.when(F.col(broken).isNotNull(), text).alias(ragged))
    told = F.concat(F.lit("row with too many or too few fields: "), text)
    return raw.where(F.assert_true(F.col(broken).isNull(), told).isNull()).select(*fields)

"""Cleaning: drop incomplete rows, drop unwanted years, correct release years, remove repeats."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def apply_corrections(
    df: DataFrame,
    corrections: Mapping[object, object] | DataFrame,
    key: str = "title",
    value: str = "year_released",
) -> DataFrame:
    """Replace `value` wherever `key` equals a listed key exactly; a listed null sets null. One row in, one row out.

    Corrections are a dict, or a DataFrame with columns `key` and `value`, of any size; Spark picks the join from
    their size, and splits keys that hold much of the table. A repeated key in a DataFrame fails the job; null keys
    correct nothing.
    """
    if isinstance(corrections, Mapping):
        schema = StructType([StructField(name, df.schema[name].dataType) for name in (key, value)])
        fixes = df.sparkSession.createDataFrame(list(corrections.items()), schema).where(F.col(key).isNotNull())
    else:
        fixes = corrections.select(key, value).where(F.col(key).isNotNull())
        # Apart from the join, so that nothing stands between its sort and its shuffle.
        most = fixes.groupBy(key).count().agg(F.max("count")).scalar()
        fixes = fixes.where(F.assert_true(most == 1, F.lit("corrections repeat a key")).isNull())
    hit, new, name = "_hit", "_new", "_key"
    fixes = fixes.select(F.col(key).alias(name), F.col(value).alias(new), F.lit(True).alias(hit))
    corrected = F.when(F.col(hit), F.col(new)).otherwise(F.col(value)).alias(value)
    kept = [corrected if column == value else F.col(column) for column in df.columns]
    return df.join(fixes, F.col(key) == F.col(name), "left").select(*kept)


def clean(
    df: DataFrame,
    corrections: Mapping[object, object] | DataFrame | None = None,
    dropped_years: Iterable[int] = (),
    year: str = "year_released",
    title: str = "title",
) -> DataFrame:
    """Drop rows with any null, then rows of the dropped years, then correct years by title.

    The order matters: a row without a year, or with a dropped year, is gone before it could be corrected.
    """
    kept = df.dropna("any").where(~F.col(year).isin(list(dropped_years)))
    return kept if corrections is None else apply_corrections(kept, corrections, title, year)


def distinct_rows(df: DataFrame, *dropped: str) -> DataFrame:
    """Distinct rows once the `dropped` columns are left out."""
    return df.drop(*dropped).distinct()

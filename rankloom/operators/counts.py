"""Group counts, sums, distinct counts and column ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Rows per group. A song counts once for every row it has, so once per chart year."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def totals(df: DataFrame, *keys: str, measure: str = "pop", name: str = "total_popularity") -> DataFrame:
    """Sum of `measure` per group."""
    return df.groupBy(*keys).agg(F.sum(measure).alias(name))


def distinct_entities(
    df: DataFrame, *keys: str, entity: str = "artist", name: str = "count", approximate: bool = False
) -> DataFrame:
    """Different entities per group. `approximate` trades exactness for a single small shuffle."""
    count = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return df.groupBy(*keys).agg(count.alias(name))


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value of each column, one row per column."""
    bounds = df.agg(*(F.struct(F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns))
    return bounds.unpivot([], list(columns), "column", "range").select("column", "range.min", "range.max")

"""Numeric features: histograms with empty bins, and feature/score points in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Empty bins are made in two steps of at most this many, so a wide range never becomes one huge array.
BINS_PER_STEP = 10_000


def _bins(df: DataFrame, widths: Mapping[str, int], *others: str) -> DataFrame:
    """(others..., feature, value, width, bin): bins are right-closed and centred on multiples of the width."""
    long = [cell for name, width in widths.items() for cell in (F.lit(name), F.col(name).cast("double"), F.lit(width))]
    values = df.select(*others, F.stack(F.lit(len(widths)), *long).alias("feature", "value", "width"))
    number = F.ceil((F.col("value") - F.col("width") / 2) / F.col("width")).cast("long")
    finite = F.abs("value") < float("inf")  # neither null nor NaN nor infinite: those are in no bin
    return values.where(finite).withColumn("bin", number * F.col("width"))


def histogram(
    df: DataFrame, widths: Mapping[str, int], empty_bins: bool = True, include_lowest: bool = True
) -> DataFrame:
    """Rows per fixed-width bin of each feature; `bin` is the bin's centre.

    `include_lowest`: a least value that lies exactly on a bin edge belongs to the bin above it. All rows of
    the lowest bin then have that one value, so the whole bin moves up. `empty_bins` adds the bins without rows
    between the first and the last. Rows are read once; all else is done on bins.
    """
    found = _bins(df, widths).groupBy("feature", "width", "bin").agg(
        F.count("*").alias("count"), F.min("value").alias("least")
    )
    by_bin = Window.partitionBy("feature").orderBy("bin")
    width = F.col("width")
    # The first bin moves up by one if its least value, so all of its values, lie on its upper edge.
    moves = F.lit(include_lowest) & (F.row_number().over(by_bin) == 1) & (F.col("least") == F.col("bin") + width / 2)
    placed = found.withColumn("next", F.lead("bin").over(by_bin)).withColumn("moves", moves)
    meets = F.lag(F.col("moves") & (F.col("next") == F.col("bin") + width)).over(by_bin)
    moved = F.when(meets, F.lag("count").over(by_bin)).otherwise(0)
    counted = (
        placed.withColumn("moved", moved)
        .where(~(F.col("moves") & F.coalesce(F.col("next") == F.col("bin") + width, F.lit(False))))
        .select(
            "feature",
            F.when(F.col("moves"), F.col("bin") + width).otherwise(F.col("bin")).alias("bin"),
            (F.col("count") + F.col("moved")).alias("count"),
            "width",
            "next",
        )
    )
    if not empty_bins:
        return counted.select("feature", "bin", "count")
    # Each bin brings the empty ones up to the next; a long gap is cut in steps, which are dealt out to tasks.
    last = F.floor((F.coalesce(F.col("next"), F.col("bin") + width) - F.col("bin")) / width) - 1
    step = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BINS_PER_STEP).cast("long")))
    steps = counted.withColumn("last", last).withColumn("step", step).hint("rebalance")
    k = F.explode(F.sequence("step", F.least(F.col("step") + BINS_PER_STEP - 1, F.col("last"))))
    every = steps.withColumn("k", k)
    count = F.when(F.col("k") == 0, F.col("count")).otherwise(0)
    return every.select("feature", (F.col("bin") + F.col("k") * width).alias("bin"), count.alias("count"))


def feature_points(df: DataFrame, ids: Sequence[str], features: Sequence[str], score: str = "pop") -> DataFrame:
    """One row per input row and feature: ids, feature, value, score."""
    kept = list(dict.fromkeys([*ids, score]))
    return df.select(*kept, *(f for f in features if f not in kept)).unpivot(kept, list(features), "feature", "value")


def binned_feature_points(df: DataFrame, widths: Mapping[str, int], score: str = "pop") -> DataFrame:
    """Feature points summed up by bin, for tables too large to show every row: rows and mean score per bin."""
    renamed = df.select(F.col(score).alias("_score"), *widths)
    return _bins(renamed, widths, "_score").groupBy("feature", "bin").agg(
        F.count("*").alias("count"), F.avg("_score").alias("avg_pop")
    )

"""Ranking inside each period, with every entry's share of its period's total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.counts import totals
from rankloom.operators.positions import PART, PLACE, POSITION, placed_rows
from rankloom.operators.top import rank_within


def ranked_share(
    df: DataFrame,
    period: str,
    entity: Sequence[str],
    n: int,
    measure: str = "pop",
    direction: str = "top",
    repeats: bool = True,
    slices: int = 0,
) -> DataFrame:
    """Top or bottom N entities of each period, with their share of the period's whole total.

    The total is taken over all entities of the period, before the cut, so shown shares need not sum to 1.
    It is NULL when the total is 0. `repeats=False` ranks distinct (period, entity, measure) rows instead of
    summing: an entry that came back in another year counts once.

    The ranking and the totals both start from the same grouped rows, so Spark reads the table and shuffles
    the groups once and uses that shuffle twice. Only N rows per period meet the totals, and Spark picks that
    join from the totals' measured size.
    """
    if repeats:
        grouped = totals(df, period, *entity, measure=measure)
    else:
        whole = dict(df.dtypes)[measure] in ("tinyint", "smallint", "int")
        score = F.col(measure).cast("bigint") if whole else F.col(measure)
        grouped = df.select(period, *entity, score.alias("total_popularity")).distinct()
    per_period = grouped.groupBy(F.col(period).alias("_period")).agg(
        F.sum("total_popularity").alias("yearly_total_popularity"), F.count("total_popularity").alias("_n")
    )
    # Holds always. Without it, a caller who drops the shares has the sums pruned here but not in the ranking, and the
    # table is read twice instead of once.
    per_period = per_period.where(F.col("yearly_total_popularity").isNotNull() | (F.col("_n") == 0))
    ranked = rank_within(grouped, period, "total_popularity", entity, n, direction, slices)
    share = F.try_divide("total_popularity", "yearly_total_popularity")
    return ranked.join(per_period, F.col(period).eqNullSafe(F.col("_period"))).select(
        period, *entity, "total_popularity", "yearly_total_popularity", share.alias("prop"), "rn"
    )


def stack_segments(df: DataFrame, period: str, value: str, order: Sequence[str]) -> DataFrame:
    """Where each entry's segment starts, and its middle, when a period's entries are stacked in `order`.

    Meant for rows already cut to N per period: the window holds one period. `stack_positions` has no such limit.
    """
    before = Window.partitionBy(period).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(value).over(before), F.lit(0))
    return df.withColumn("seg_start", start).withColumn("seg_mid", F.col("seg_start") + F.col(value) / 2)


def stack_positions(spark: SparkSession, path: str, period: str, value: str) -> DataFrame:
    """`stack_segments` for periods of any size, over a table that `write_positions` wrote in the order of the period
    and then of the stack.

    Sums run inside each range of that order; what the ranges before it hold of the same period, one number a range and
    period, is added to them. So a period is cut into as many tasks as it has ranges.
    """
    rows = placed_rows(spark, path)
    in_part = Window.partitionBy(PART, period).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(PART, F.col(period).alias("_period")).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy("_period").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(PART).alias("_of"), "_period", F.sum("_sum").over(ahead).alias("_ahead"))
    sums = sums.where("_ahead IS NOT NULL")  # ranges that go on with a period: at most one period a range
    rows = rows.withColumn("_run", F.sum(value).over(in_part))
    same = (F.col(PART) == F.col("_of")) & F.col(period).eqNullSafe(F.col("_period"))
    found = rows.join(sums, same, "left")
    start = F.coalesce("_run", F.lit(0)) + F.coalesce("_ahead", F.lit(0))
    found = found.withColumn("seg_start", start).withColumn("seg_mid", F.col("seg_start") + F.col(value) / 2)
    return found.drop(PART, PLACE, POSITION, "_of", "_period", "_ahead", "_run")

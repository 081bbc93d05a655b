"""Top or bottom N, over the whole table or inside each period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.counts import counts, totals
from rankloom.operators.ordering import check_count, is_top, rank_order


def _first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, numbered. Only those n rows reach the numbering window."""
    return df.orderBy(*order).limit(check_count(n)).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_k(
    df: DataFrame, entity: Sequence[str], n: int, measure: str | None = "pop", direction: str = "top"
) -> DataFrame:
    """Exactly N entities by total of `measure`, or by row count when `measure` is None. Ties go by entity."""
    if measure is None:
        grouped, name = counts(df, *entity), "count"
    else:
        grouped, name = totals(df, *entity, measure=measure), "total_popularity"
    return _first_n(grouped, rank_order(name, entity, direction), n)


def top_k_with_ties(df: DataFrame, entity: Sequence[str], n: int, measure: str = "pop") -> DataFrame:
    """Entities whose total is at least the N-th largest total: more than N rows when the N-th is tied. Null totals
    come last, so they are kept only where fewer than N entities have a total."""
    grouped = totals(df, *entity, measure=measure)
    largest = grouped.select("total_popularity").orderBy(F.desc_nulls_last("total_popularity")).limit(check_count(n))
    nth = largest.agg(F.when(F.count("total_popularity") == n, F.min("total_popularity"))).scalar()
    return grouped.where(F.coalesce(F.col("total_popularity") >= nth, nth.isNull()))


def _reached(rows: DataFrame, parts: int, best: Column, descending: bool, n: int) -> DataFrame:
    """One row (best): a value of `best` that N different rows reach; null where there may not be as many.

    Rows are dealt to parts by a hash of the whole row, so copies share a part and the best rows of two parts differ.
    The N-th best of the parts is therefore a bound, and with several times N parts nearly the tightest one. It takes
    one aggregate with a row a part and task, in which copies are merged where they are read.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    first = rows.groupBy(part.alias("_part")).agg(best.alias("best")).where("best IS NOT NULL")
    first = first.orderBy(F.desc("best") if descending else F.asc("best")).limit(n)
    return first.agg(F.when(F.count("*") == n, (F.min if descending else F.max)("best")).alias("best"))


def top_k_rows(
    df: DataFrame, n: int, measure: str = "pop", ties: Sequence[str] = (), direction: str = "top", parts: int = 8
) -> DataFrame:
    """Exactly N distinct rows by `measure`. Ties go by the `ties` columns, then by all other columns.

    Removing repeats of whole rows would shuffle the whole table. Instead one reading finds a measure that N different
    rows reach, another one, among the rows of just that measure, their N-th by the other columns (see `_reached`; for
    N rows there are `parts` times N parts). What reaches both is few more than N rows and their copies, and each task
    drops the copies before the shuffle: a row that fills half the table is sent once a task.
    """
    others = [name for name in df.columns if name != measure and name not in ties]
    order, top = rank_order(measure, [*ties, *others], direction), is_top(direction)
    value = _reached(df, parts * check_count(n), (F.max if top else F.min)(measure), top, n).scalar()
    found, tied = F.col(measure) > value if top else F.col(measure) < value, F.col(measure) == value
    keys = [key for name in [*ties, *others] for key in (F.col(name).isNull(), F.col(name))]
    if keys:
        key = F.struct(*[column.alias(f"_{k}") for k, column in enumerate(keys)])
        nth = _reached(df.where(tied), parts * n, F.min(key), False, n).scalar()
        tied = tied & F.coalesce(key <= nth, F.lit(True))
    return _first_n(df.where(value.isNull() | found | tied).distinct(), order, n)


def _first_within(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def rank_within(
    df: DataFrame, period: str, measure: str, ties: Sequence[str], n: int, direction: str = "top", slices: int = 0
) -> DataFrame:
    """Keep the first N rows of each period and number them in `rn`.

    Every input partition is cut to N rows per period before the shuffle, so a period that holds most of the table
    still sends only N rows per partition. Spark does that up to its group-limit threshold (1000); ask for `slices`
    where N is larger: periods are then cut in so many slices first, and no task sorts a whole period.
    """
    order = rank_order(measure, ties, direction)
    check_count(n)
    if slices:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*ties), F.lit(slices)))
        df = _first_within(sliced, [period, "_slice"], order, n).drop("_slice", "rn")
    return _first_within(df, [period], order, n)


def top_k_per_period(
    df: DataFrame, period: str, entity: Sequence[str], n: int, measure: str | None = None, direction: str = "top"
) -> DataFrame:
    """N entities per period by row count, or by total of `measure`. Ties go by entity."""
    if measure is None:
        grouped, name = counts(df, period, *entity), "count"
    else:
        grouped, name = totals(df, period, *entity, measure=measure), "total_popularity"
    return rank_within(grouped, period, name, entity, n, direction)

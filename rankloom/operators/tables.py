"""What a result table offers: search, sort and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """All that a search looks at in a row, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.col(name).cast("string") for name in columns)))


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every space-separated term of `text` occurs somewhere, in any case."""
    row = row_text(df, columns or df.columns)
    return reduce(lambda found, term: found.where(row.contains(term)), text.lower().split(), df)


def _keys(order: Sequence[str]) -> list[tuple[str, bool]]:
    """("name", ascending) for each order entry; a leading minus means descending."""
    return [(name[1:], False) if name.startswith("-") else (name, True) for name in order]


def sort_columns(df: DataFrame, order: Sequence[str], nulls_first: bool = False) -> list[Column]:
    named = _keys(order)
    others = [(name, True) for name in df.columns if name not in dict(named)]
    first = [F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_first() for name, up in named if nulls_first]
    last = [*([] if nulls_first else named), *others]
    return [*first, *(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last() for name, up in last)]


def sort_table(df: DataFrame, *order: str) -> DataFrame:
    """Sort by columns; a leading minus means descending. Nulls come last.

    Equal rows go by the other columns, ascending. That makes the order certain, and lets Spark cut a value
    that much of the table shares into several partitions.
    """
    return df.orderBy(*sort_columns(df, order))


def page(
    df: DataFrame, order: Sequence[str], size: int, number: int = 1, after: Mapping[str, object] | None = None
) -> DataFrame:
    """One page of a sorted table, with each row's `position` in the table. `order` must end in columns that make a
    row unique.

    A page far into a large table costs as much as all pages before it. `after`, the order columns of the last
    row already shown, starts there instead; it needs order columns without nulls, and `position` is then that in
    the page.
    """
    skipped = 0 if after is not None else (number - 1) * size
    if after is not None:
        beyond: Column = F.lit(False)
        for name, up in reversed(_keys(order)):
            column, last = F.col(name), F.lit(after[name])
            beyond = (column > last if up else column < last) | ((column == last) & beyond)
        df = df.where(beyond)
    shown = sort_table(df, *order).offset(skipped).limit(size)
    return shown.withColumn("position", F.row_number().over(Window.orderBy(*sort_columns(df, order))) + skipped)

"""Label texts for result rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten(text: Column, width: int) -> Column:
    """Text longer than `width` characters becomes its first `width - 3` and three dots."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def wrap_words(text: Column, width: int = 15) -> Column:
    """Fill lines with whole words; a line is shorter than `width` unless one word alone is longer."""
    words = F.split(F.trim(text), r"\s+")

    def add(lines: Column, word: Column) -> Column:
        last_line = F.substring_index(lines, "\n", -1)
        fits = F.length(last_line) + F.length(word) + 1 < width
        return F.when(lines.isNull(), word).otherwise(
            F.concat(lines, F.when(fits, F.lit(" ")).otherwise(F.lit("\n")), word)
        )

    return F.aggregate(words, F.lit(None).cast("string"), add)


def caption(parts: Iterable[tuple[str, str]]) -> Column:
    """One line of text from (text, column) pairs, all joined by single spaces."""
    pieces = []
    for text, column in parts:
        pieces += [F.lit(text), F.col(column).cast("string")]
    return F.concat_ws(" ", *pieces)

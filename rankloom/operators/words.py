"""Word frequencies of a text column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import cut_at, tokens

LETTER = r"[\p{L}\p{N}_]"


def without_stop_words(word: Column, stop_words: Sequence[str]) -> Column:
    """A word without the stop-words inside it: "it’s", with a curly apostrophe, holds the whole word "it".

    Only words with non-ASCII signs can hold one, since ASCII punctuation is gone by now.
    """
    whole = f"(?<!{LETTER})(?:{'|'.join(map(re.escape, stop_words))})(?!{LETTER})"
    has_signs = (F.octet_length(word) > F.length(word)) & word.rlike(r"[^\p{L}\p{N}_]")
    return F.when(has_signs, F.regexp_replace(word, whole, "")).otherwise(word)


def word_counts(
    df: DataFrame, text: str = "title", stop_words: Sequence[str] = (), cut: str | None = None, min_length: int = 3
) -> DataFrame:
    """How often each word occurs, over every row: a title that appears twice counts twice.

    `cut` drops each text from the first match of that pattern on. Punctuation goes before stop-words do, so
    "don't" is counted as "dont". Words are counted before the shuffle, so a very common word is one row per task.
    """
    source = F.col(text) if cut is None else cut_at(F.col(text), cut)
    word = F.col("word")
    words = df.select(F.explode(tokens(source)).alias("word")).where(F.length(word) >= min_length)
    if stop_words:
        words = words.where(~word.isin(list(stop_words))).select(without_stop_words(word, stop_words).alias("word"))
    return words.where(F.length(word) >= min_length).groupBy("word").agg(F.count("*").alias("freq"))

"""Small fixtures that every operator meets: nulls, empty and long texts, repeated rows, clashing extra columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog and then it rests in warm grass beside the old river bank".split()


def prose(words: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * i + seed * 7 + i // 5) % len(WORDS)] + ("x" * (i * seed % 3)) for i in range(words))


def odd_rows() -> list[tuple]:
    """Rows of documents that are easy to get wrong."""
    same = prose(120, 3)
    return [
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (3, " \t\n ", "en", "s", 4),
        (4, "12345 !!! 678", "en", "s", 13),
        (5, same, "en", "s", len(same)),
        (5, same, "en", "s", len(same)),
        (6, same, "fr", "s", len(same)),
        (7, prose(6000, 1), "en", "s", 0),
        (8, "x" * 70_000, "en", "s", 70_000),
        (None, "naïve café 日本語 😀 text　here", "fr", "s", 1),
        (None, None, None, None, None),
        (9, "  two  blanks \n\n and a tail ", "en", "s", 1),
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), DOCS)


def clashing(docs: DataFrame) -> DataFrame:
    """The same with columns of names that operators use inside."""
    names = ["key", "mark", "Score", "rejected", "lang_pred", "spans", "ids", "n", "found", "fp"]
    for name in names:
        docs = docs.withColumn(name, docs["source"])
    return docs


def empty(df: DataFrame) -> DataFrame:
    return df.filter("1 = 0")


def documents(folder: str = SMALL) -> pd.DataFrame:
    return pd.read_parquet(f"{folder}/documents.parquet")


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)

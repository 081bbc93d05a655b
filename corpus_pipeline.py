"""Corpus pipeline over documents: each stage works on all that the one before it kept.

1. language: documents without a letter, or farther from every language than its own texts are, go.
2. near_duplicates: of each group of documents whose SimHash fingerprints link (three-word shingles, 2 bits at most,
   as op5 has them) one document stays, the one with the least id.
3. decontamination: documents that hold a benchmark item, within its edit budget, go.
4. personal_data: e-mail addresses, IP addresses, card and telephone numbers are replaced by their kind.
5. tokens: texts become byte-level BPE ids, and are decoded again.

Nulls, empty tables and repeated rows: as each operator says; all stages but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, decontaminate, lang_id, pii, simhash
from rankloom.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): packed little-endian ids, and the text that they stand for."""
    done = byte_bpe.round_trip(docs)
    return done.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Languages, fingerprints, edit distances and ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Importance resampling towards a target distribution, by hashed n-gram features, with segments counted once.

Features are runs of one to `longest` words, hashed into buckets. A bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus, in thousandths; a document's weight is the mean gain of its features, and a
Gumbel number from its id turns the highest scores into a draw by weight without replacement.

A newline ends a word, so texts are cut into lines there. A line that stands anywhere again is the same segment: lines
are summed by their text, in each task first, and features are found once for each distinct line. The corpus counts are
these times the line's occurrences; the gains of a document are the sums of its lines' gains, which meet it by a
128-bit hash of the line. Runs of words that cross a newline belong to no line; they are found in the documents and
added separately, which single words do not need.

Defined results: a null text has no words, nor has an empty one, and weight 0; rows that repeat a document are
documents each, ranked side by side; a null id is drawn by the empty string's number and ranks after all ids that tie
with it; an empty target gives each feature the same share; an empty table gives an empty one; a very long line is a
segment like any other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.llm.common import kept, mapped, place, stored
from rankloom.operators import read_positions, write_positions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: no character of ASCII but digits and letters, which are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def runs_of(words: Column, longest: int) -> Column:
    """All runs of one to `longest` words."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        found = F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[of(n) for n in range(2, longest + 1)])


def buckets_of(runs: Column, buckets: int) -> Column:
    return F.transform(runs, lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int"))


def crossing(words: list[list[str]], longest: int) -> list[str]:
    """Runs of two to `longest` words that stand in several of the lines."""
    flat = [w for line in words for w in line]
    line_of = [k for k, line in enumerate(words) for _ in line]
    found = []
    for end in range(1, len(flat)):
        if line_of[end] != line_of[max(0, end - longest + 1)]:
            found += [" ".join(flat[at : end + 1]) for at in range(max(0, end - longest + 1), end) if line_of[at] != line_of[end]]
    return found


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, text): mark tells the texts of a key apart."""
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[key].alias("key"), F.unhex(F.md5(whole)).alias("mark"), whole.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("key", "mark", F.explode(F.split("text", "\n", -1)).alias("line")).filter("line <> ''")


def segments(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(digest, occurrences, n_words, features) of each distinct line that has words; features: a bucket for each."""
    distinct = _lines(rows).groupBy("line").agg(F.count("*").alias("occurrences"))
    found = distinct.select("line", "occurrences", words_of(F.col("line")).alias("words")).filter(F.size("words") > 0)
    features = buckets_of(runs_of(F.col("words"), longest), buckets).alias("features")
    return found.select(F.unhex(F.md5("line")).alias("digest"), "occurrences", F.size("words").alias("n_words"), features)


def crossings(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, mark, features): the runs of each document that no line holds whole."""
    kind = rows.schema["key"].dataType.simpleString()
    if longest < 2:
        return rows.select("key", "mark", F.array().cast("array<int>").alias("features")).filter("false")
    lines = F.transform(F.split("text", "\n", -1), words_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for part in batches:
            found = [[zlib.crc32(r.encode()) % buckets for r in crossing(words, longest)] for words in part.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("mark"), pa.array(found, pa.list_(pa.int32()))], ["key", "mark", "features"])

    return mapped(rows.select("key", "mark", lines.alias("lines")), run, f"key {kind}, mark binary, features array<int>")


def counted(found: DataFrame, crossed: DataFrame) -> DataFrame:
    """(bucket, n): features by bucket, those of a segment times its occurrences."""
    each = found.select("occurrences", F.explode("features").alias("bucket"))
    each = each.union(crossed.select(F.lit(1).cast("long"), F.explode("features")))
    return each.groupBy("bucket").agg(F.sum("occurrences").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths; corpus and target: (bucket, n), a row a bucket at most."""
    spark = corpus.sparkSession
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = each.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = [(r.bucket, r.s or 0, r.t or 0) for r in each.collect()]  # as many as there are buckets
    s_all, t_all = float(sum(s for _, s, _ in rows) + buckets), float(sum(t for *_, t in rows) + buckets)
    out = np.zeros(buckets, np.int64)
    for bucket, s, t in rows:
        out[bucket] = floor(1000 * log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
    return out


def summed(found: DataFrame, by: list[str], gain: Broadcast) -> DataFrame:
    """The columns `by` of rows with features, their number and the sum of their gains."""
    schema = StructType([*(found.schema[name] for name in by), StructField("n_features", LongType()), StructField("gain", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for part in batches:
            lists = part.column("features")
            sums = np.concatenate([[0], np.cumsum(gain.value[lists.flatten().to_numpy()])])
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            total = sums[ends] - sums[ends - size]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in by], pa.array(size, pa.int64()), pa.array(total, pa.int64())], names=schema.names)

    return mapped(found.select(*by, "features"), run, schema)


def weighed(docs: DataFrame, target: DataFrame, key: str, text: str, target_text: str, longest: int, buckets: int) -> DataFrame:
    """(key, n_words, n_features, gain): the sums of each document's features, one row a document."""
    rows, aim = _marked(docs, key, text), _marked(target, target_text, target_text)
    found = stored(segments(rows, longest, buckets), "segments", "zstd")
    crossed = crossings(rows, longest, buckets)
    crossed = stored(crossed, "crossings", "zstd") if longest > 1 else crossed
    goal = counted(segments(aim, longest, buckets), crossings(aim, longest, buckets))
    gain = docs.sparkSession.sparkContext.broadcast(gains(counted(found, crossed), goal, buckets))
    sums = stored(summed(found, ["digest", "n_words"], gain), "sums")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # the sums are a written table, so that Spark can split a line that much of the corpus holds
    links = _lines(rows).select("key", "mark", F.unhex(F.md5("line")).alias("digest"))
    each = links.join(sums, "digest").select("key", "mark", F.col("n_words").cast("long"), "n_features", "gain", zero.alias("copies"))
    if longest > 1:
        over = summed(crossed, ["key", "mark"], gain)
        each = each.union(over.select("key", "mark", zero, "n_features", "gain", zero))
    each = each.union(rows.select("key", "mark", zero, zero, zero, one))
    names = ["n_words", "n_features", "gain", "copies"]
    each = each.groupBy("key", "mark").agg(*[F.sum(name).alias(name) for name in names])
    own = [F.expr(f"{name} div copies").alias(name) for name in names[:3]]  # rows that repeat a document share its sums
    return each.select("key", *own, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")


def draw(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(key, n_features, weight, score, rank), all long, for each document: of the N documents with at least
    `least_words` words, the floor(percent * N / 100) highest scores are drawn and ranked, ties by key; rank is null
    for the others."""
    found = weighed(docs, target, key, text, target_text, longest, buckets)
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    number = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    number = F.conv(F.substring(number, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / F.lit(4294967296.0))))
    found = found.select("key", "n_features", weight.cast("long").alias("weight"), gumbel.alias("gumbel"), (F.col("n_words") >= least_words).alias("able"))
    found = found.select("key", "n_features", "weight", (F.col("weight") + F.col("gumbel")).alias("score"), "able")
    path = place(docs.sparkSession, "ranked")
    write_positions(found, ["-able", "-score", "key"], path)
    ranked = read_positions(docs.sparkSession, path)
    able = ranked.agg(F.count_if("able")).first()[0]
    rank = F.when(F.col("position") <= percent * able // 100, F.col("position"))
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", rank.cast("long").alias("rank"))

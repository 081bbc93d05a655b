"""Approximate nearest neighbours by cosine with a permutation index.

A vector is represented by its nearest pivots in order. Shards of the index hold up to `shard` vectors each, with a
file for each pivot: which vectors rank it where. A query reads the files of its own pivots, sums how far the ranks
are apart (Spearman's footrule; a pivot that a vector does not rank counts as one place below its list), and the
vectors with the least sums are ranked again by the exact cosine in double precision. Every shard answers every block
of queries, and the best of all shards remain.

The pivots are a bounded sample: `pivots` vectors, the first by a hash of their content. All vectors are indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors
of the query's own length are compared; ties go to the smaller id, in the candidate lists too; rows with a null id
take no part; repeated ids are rows of their own; queries with fewer candidates return all; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 512
RANKED = 96
SHARD = 4096
BLOCK = 1024
#: Candidates of a shard that are ranked again for a query: those with the least footrule distance, ties by id.
RERANKED = 512


def valid(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def permutations(vectors: np.ndarray, pivots: np.ndarray, ranked: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to the first pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :ranked]


class Shard:
    """Inverted files of one stretch of vectors (ids ascending)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, ranked: int):
        self.ids, self.vectors, self.unit = ids, vectors, unit(vectors)
        lists = permutations(self.unit, pivots, ranked)
        self.ranked = lists.shape[1]
        order = np.argsort(lists, axis=None, kind="stable")
        self.who, self.rank = order // self.ranked, (order % self.ranked).astype(np.int32)
        self.cut = np.searchsorted(lists.ravel()[order], np.arange(len(pivots) + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of the query's list to each vector's; what neither list holds counts nothing."""
        places = np.arange(self.ranked)
        unseen = int((self.ranked - places).sum())  # each own place of a list, held against one below the other list
        total = np.full(len(self.ids), 2 * unseen, np.int32)
        for place, pivot in enumerate(query):
            own = slice(self.cut[pivot], self.cut[pivot + 1])
            rank = self.rank[own]
            total[self.who[own]] += np.abs(rank - place) - (self.ranked - place) - (self.ranked - rank)
        return total

    def search(self, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, reranked: int, k: int) -> pd.DataFrame:
        lists = permutations(unit(queries), pivots, self.ranked)
        out = []
        for q, own, query in zip(query_ids, lists, queries, strict=True):
            total = self.footrule(own).astype(np.int64) * len(self.ids) + np.arange(len(self.ids))
            near = np.argpartition(total, reranked)[:reranked] if len(total) > reranked else np.arange(len(total))
            near = near[self.ids[near] != q]
            score = cosine(query, self.vectors[near])
            best = np.lexsort((self.ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": q, "vec_id": self.ids[near][best], "score": score[best]}))
        return pd.concat(out)


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Dot product over the product of the lengths, each a plain sum over the components in double precision."""
    dot = (vectors * query).sum(axis=1)
    return dot / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    pivots: int = PIVOTS,
    ranked: int = RANKED,
    shard: int = SHARD,
    block: int = BLOCK,
    reranked: int = RERANKED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors that the index finds for each query but the query's own row."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        v = df[vector].cast("array<double>")
        return df.filter(df[key].isNotNull() & valid(v)).select(df[key].cast("long").alias(name), v.alias("vector"), F.size(v).alias("length"))

    own, asked = rows(vectors, "vec_id"), rows(queries, "query_id")
    # one count a length: how many shards and blocks it takes
    counted = own.groupBy("length").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("vector")).alias("distinct"))
    counted = counted.select("length", F.ceil(F.col("n") / shard).alias("shards"), (4 * pivots / F.col("distinct")).alias("part"))
    blocks = asked.groupBy("length").count().select("length", F.ceil(F.col("count") / block).alias("blocks"))
    both = F.broadcast(counted.join(blocks, "length").drop("part"))
    place = lambda name, parts: F.pmod(F.xxhash64(name), F.col(parts)).cast("int")
    index = own.join(both, "length").withColumn("shard", place("vec_id", "shards"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    ask = asked.join(both, "length").withColumn("block", place("query_id", "blocks"))
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))))
    spread = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / (1 << 30)  # some four times as many as needed, then the first
    chosen = own.join(F.broadcast(counted), "length").filter(spread < F.col("part")).select("vector", "length").distinct()
    by_content = Window.partitionBy("length").orderBy(F.xxhash64("vector"), "vector")
    chosen = chosen.withColumn("n", F.row_number().over(by_content)).filter(F.col("n") <= pivots)
    chosen = {length: unit(np.array(vs)) for length, vs in _by_length(chosen.select("length", "vector").collect())}
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def run(key: tuple, index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if index.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        base = shared.value[key[0]]
        index, ask = index.sort_values("vec_id", kind="stable"), ask.sort_values("query_id", kind="stable")
        own = Shard(index["vec_id"].to_numpy(), np.stack(index["vector"]), base, ranked)
        return own.search(ask["query_id"].to_numpy(), np.stack(ask["vector"]), base, reranked, k)

    groups = ["length", "shard", "block"]
    found = index.select(*groups, "vec_id", "vector").groupBy(groups).cogroup(ask.select(*groups, "query_id", "vector").groupBy(groups))
    found = found.applyInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _by_length(rows: list) -> list[tuple[int, list]]:
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row.length, []).append(row.vector)
    return list(found.items())

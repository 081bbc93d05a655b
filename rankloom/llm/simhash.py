"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits, r even, share a variant that differs from either in at most r/2. So
every distinct fingerprint emits all variants within that half radius; rows meet on the variant. A variant's row set
is bounded by the ball's size (65 for half radius 1), whatever the number of copies, and all in it are linked, so each
is paired with the least one only, which keeps components and never makes all pairs.

Defined results: a null or wordless text has fingerprint zero, which is linked like any other; repeated rows share a
fingerprint; a null key stays in the result and is never a component id, unless a component has no other (then null);
a very long text is hashed whole, as a slice of its own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rankloom.llm.common import fresh, kept, mapped, stored, text_slices
from rankloom.llm.components import components

WORDS = 3
RADIUS = 2


def shingle_hashes(raw: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `words` words, lower-cased in A-Z and joined by blanks; of all of them if fewer."""
    found = raw.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: max(0, len(found) - words)]]
    return [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :] or ends[-1:], strict=True)]


def fingerprint(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One fingerprint for each stretch of hashes: the bits that over half of them have; none: zero."""
    out = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
        most = count * 2 > (ends - starts)[full, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, mark, fp): a 64-bit fingerprint of each whole text; mark: a hash of key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for rows in text_slices(batches):
            hashes = [shingle_hashes(t.encode(), words) for t in rows.column("text").to_pylist()]
            ends = np.cumsum([len(h) for h in hashes])
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(ends[-1]))
            fp = pa.array(fingerprint(flat, ends).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("mark"), fp], ["key", "mark", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(docs[key].alias("key"), F.xxhash64(docs[key], docs[text]).alias("mark"), docs[text].alias("text"))
    return mapped(chosen, run, f"key {kind}, mark bigint, fp bigint").withColumnRenamed("key", key)


def links(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all within `radius` bits, directly or by others."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = [0]
    for n in range(1, radius // 2 + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = marked.select("fp").distinct().select("fp", F.explode(F.lit(masks)).alias("mask"))
    ball = ball.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = ball.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> least")
    pairs = met.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def roots(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): each fingerprint u that is linked to a lesser one, with the least one v of its component."""
    return components(links(marked, radius))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """(key, fingerprint, component_id), one row a document; component_id is the least key of its component."""
    marked = stored(fingerprints(docs, key, text, words).drop("mark"), "fingerprints")
    root = roots(marked, radius)
    least = marked.groupBy("fp").agg(F.min(key).alias("least"))
    least = least.join(root, least.fp == root.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.drop("least").join(named, "root").drop("root")
    found = marked.join(named, "fp")
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """The documents, all columns, but one of each component: the one with the least key (null keys last, then by a
    hash of the text). Rows that are equal in key and text are one document."""
    marked = stored(fingerprints(docs, key, text, words), "fingerprints")
    root = roots(marked, radius)
    group = F.coalesce(root.v, marked.fp)
    return first_of_groups(docs, marked.join(root, marked.fp == root.u, "left").select(marked[key], "mark", group.alias("group")), key, text)


def first_of_groups(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """The documents, all columns, that come first in their group of `kept` (key, mark, group)."""
    first = Window.partitionBy("group").orderBy(F.col(key).asc_nulls_last(), "mark")
    kept = kept.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col(key).alias("key"), "mark")
    mark, n = fresh(docs, "mark"), fresh(docs, "n")
    own = docs.withColumn(mark, F.xxhash64(docs[key], docs[text]))
    once = Window.partitionBy(mark, key).orderBy(key)  # by key too: a hash that two documents share loses neither
    own = own.withColumn(n, F.row_number().over(once)).filter(F.col(n) == 1).drop(n)
    return own.join(kept, (own[mark] == kept.mark) & own[key].eqNullSafe(kept.key), "left_semi").drop(mark)

"""Document fingerprints: threshold-scaled sketches for containment.

A shingle is a run of WIDTH bytes of the UTF-8 text (a shorter text is one shingle). Every shingle has a 64-bit hash,
and the fingerprint keeps every hash below a fixed fraction of all hash values. So a fingerprint grows with its text,
a shingle is kept in all texts or in none, and the share of a document's hashes that another one has too estimates how
much of the document stands in the other, however unequal the two are. Fingerprints merge by union: a set of documents
has the distinct hashes of all of them, kept as rows, as many as there are.

A text all of whose hashes lie above the fraction keeps its least one, so only the empty text has an empty fingerprint.

Defined results: a null text counts as empty; equal texts have equal fingerprints; the empty fingerprint is like itself
(1) and like no other (0); very long texts are hashed in pieces of bounded size; rows that repeat are documents each;
an empty table gives an empty one; other columns are ignored. For `next_edits`: null ids come last, ties go by a hash of
the text; rows that repeat an id and a text stand side by side, in one task; a document alone is its own next one.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rankloom.llm.common import SLICE_BYTES, kept, mapped, text_slices

#: Bytes of a shingle, three words of eight.
WIDTH = 24
#: One hash in so many is kept.
SCALE = 16
#: Bytes that are hashed at once; a longer text is cut into such pieces, which overlap by a shingle.
PIECE = SLICE_BYTES
#: Bytes of text in a range of documents, on average.
RANGE_BYTES = 16 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of each run of WIDTH bytes."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8")[:, 0]
    n = len(data) - WIDTH + 1
    found = _mixed(words[:n] + np.uint64(1))
    for at in range(8, WIDTH, 8):
        found = _mixed(found + words[at : at + n])
    return found


def _most(scale: int) -> np.uint64:
    """The largest hash that is kept."""
    return np.uint64((1 << 64) // scale - 1)


def _pieces(raw: bytes) -> Iterator[bytes]:
    for at in range(0, max(1, len(raw) - WIDTH + 1), PIECE):
        yield raw[at : at + PIECE + WIDTH - 1]


def _kept_of(group: list[tuple[int, bytes]], scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes) of pieces (row, bytes) of WIDTH bytes at least, hashed together: those below the fraction, or the least."""
    size = np.array([len(raw) for _, raw in group])
    ends = np.cumsum(size)
    hashes = shingle_hashes(np.frombuffer(b"".join(raw for _, raw in group), np.uint8))
    at = np.flatnonzero(hashes <= _most(scale))
    own = np.searchsorted(ends, at, "right")
    inside = at + WIDTH <= ends[own]  # no shingle reaches into the next piece
    at, own = at[inside], own[inside]
    cuts = np.searchsorted(own, np.arange(len(group) + 1))
    for k, (row, _) in enumerate(group):
        found = hashes[at[cuts[k] : cuts[k + 1]]]
        yield row, found if len(found) else hashes[ends[k] - size[k] : ends[k] - WIDTH + 1].min(keepdims=True)


def sketches(texts: list[str], scale: int = SCALE) -> list[np.ndarray]:
    """The fingerprint of each text: its kept hashes, ascending."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        for row, hashes in _kept_of(group, scale):
            found[row].append(hashes)
        group.clear()

    for row, text in enumerate(texts):
        raw = text.encode()
        if len(raw) < WIDTH:
            found[row].append(np.array([xxh64_intdigest(raw)] if raw else [], np.uint64))
            continue
        for piece in _pieces(raw):
            if group and held + len(piece) > PIECE:
                flush()
                held = 0
            group.append((row, piece))
            held += len(piece)
    if group:
        flush()
    out = []
    for parts in found:
        every = np.unique(np.concatenate(parts))
        small = every[: np.searchsorted(every, _most(scale), "right")]
        out.append(small if len(small) else every[:1])
    return out


def written(hashes: np.ndarray) -> str:
    """A fingerprint as text: its hashes in base 64, big-endian."""
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """How much of the first fingerprint's text stands in the other's, from 0 to 1."""
    if not len(own):
        return float(not len(other))
    return len(np.intersect1d(own, other, assume_unique=True)) / len(own)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """(key, hashes): the fingerprint of each whole text as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for rows in text_slices(batches):
            found = [h.view(np.int64) for h in sketches(rows.column("text").to_pylist(), scale)]
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "hashes"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return mapped(chosen, run, f"key {kind}, hashes array<bigint>").withColumnRenamed("key", key)


def merged(prints: DataFrame, *by: str) -> DataFrame:
    """(by, hash): the merged fingerprint of each group of documents, or of all, a row for each distinct hash. Merging
    merged ones is a union and `distinct`."""
    return prints.select(*by, F.explode("hashes").alias("hash")).distinct()


def contained(prints: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, containment): how much of each document stands anywhere in what `other` (hash), a merged fingerprint,
    was made of; null for empty fingerprints. Rows that share a key are one document."""
    own = prints.select(prints[key].alias("key"), F.explode_outer("hashes").alias("hash")).distinct()
    met = own.join(other.select("hash", F.lit(1).alias("there")), "hash", "left")
    there = F.when(F.col("hash").isNotNull(), F.coalesce("there", F.lit(0)))
    return met.groupBy("key").agg(F.avg(there).alias("containment")).withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _edges(rows: DataFrame, ranges: int) -> list[tuple]:
    """The first (null, key, tie) of each range that Spark cuts the rows into, a few bytes a range."""
    order = ["nothing", "key", "tie"]
    cut = rows.select(*order).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    first = cut.groupBy("range").agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    return [_order(*r) for r in sorted(first.collect(), key=lambda r: _order(*r))]


def _order(nothing: bool, key: object, tie: int) -> tuple:
    return (nothing, 0 if nothing else key, tie)


def next_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document, its
    edited text and the next document by key, the first after the last.

    Documents are dealt to ranges of the order, as many as their bytes ask for, and the first of each range is dealt to the range before it as well,
    behind the others. So each range is answered by itself, in one reading.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].isNull().alias("nothing"), docs[key].alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // RANGE_BYTES
    edges = rows.sparkSession.sparkContext.broadcast(_edges(rows, parts))

    @F.arrow_udf("array<struct<range:int,behind:boolean>>")
    def ranges(nothing: pa.Array, key: pa.Array, tie: pa.Array) -> pa.Array:
        found, n = [], len(edges.value)
        for row in zip(nothing.to_pylist(), key.to_pylist(), tie.to_pylist(), strict=True):
            at = max(0, bisect_right(edges.value, _order(*row)) - 1)
            own = [{"range": at, "behind": False}]
            found.append([*own, {"range": (at - 1) % n, "behind": True}] if _order(*row) == edges.value[at] else own)
        return pa.array(found, pa.list_(pa.struct([("range", pa.int32()), ("behind", pa.bool_())])))

    dealt = rows.withColumn("ranges", ranges("nothing", "key", "tie")).select("*", F.inline("ranges")).drop("ranges")
    dealt = dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "behind", "nothing", "key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        held: list[list] = [[], [], []]  # the last row waits for the next one
        for part in text_slices(batches):
            keys, behind, texts = (a + part.column(c).to_pylist() for a, c in zip(held, ("key", "behind", "text"), strict=True))
            prints = sketches(texts, scale)
            own = [k for k in range(len(texts) - 1) if not behind[k]]  # what follows such a row is of its range
            changed = [edited(texts[k], texts[k + 1]) for k in own]
            others = sketches(changed, scale)
            columns = [
                pa.array([keys[k] for k in own], part.schema.field("key").type),
                pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([written(prints[k]) for k in own], pa.string()),
                pa.array([written(h) for h in others], pa.string()),
                pa.array([likeness(prints[k], h) for k, h in zip(own, others, strict=True)], pa.float64()),
                pa.array([likeness(prints[k], prints[k + 1]) for k in own], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", *NAMES])
            held = [keys[-1:], behind[-1:], texts[-1:]]

    kinds = ", ".join(f"{name} {kind}" for name, kind in NAMES.items())
    kind = docs.schema[key].dataType.simpleString()
    return mapped(dealt.select("key", "behind", "text"), run, f"key {kind}, {kinds}").withColumnRenamed("key", key)


NAMES = {
    "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double",
}

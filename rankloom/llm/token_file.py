"""Token ids in a compressed binary table, written and read back in parallel.

write: texts are range-partitioned by key and tokenised in that order; ids are counted over all documents into one
frequency table; each partition is cut into blocks of whole documents, and each block is one rANS stream with its own
checkpoints and checksums. A block also names its documents, the number of ids of each, and how many ids stand before
each in the whole file. Blocks are written in that order: partitions by the name of their folder, and the blocks of each
by place. read: every block is decoded by itself, wherever it is.

The folder holds `table` (id, slots: the shared frequencies) and `blocks`/part=… (first, keys, starts, sizes, payload);
first is the number of ids before the block, which also orders the files of a partition so large that it has several.
It is written by Spark's committers, so a lost executor's block is written again or not at all.

Defined results: a null text counts as empty and holds the end id only; null keys come first; repeated keys follow
each other in an order set by a hash of the text; an empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from rankloom.llm import rans, word_bpe
from rankloom.llm.common import binaries, mapped, stored, text_slices

FILE = "word_bpe_49k.json"
END = 2
BLOCK_IDS = 1 << 20
#: Bytes up to which the ids of a part are one row group, so that one task reads them.
ROW_GROUP = 256 << 20


def tokenised(docs: DataFrame, key: str, text: str, path: str, end: int) -> DataFrame:
    """(part, key, before, ids): packed ids by ascending key; before: ids that stand before in the same part."""
    mark = F.xxhash64(F.col("text"))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows = rows.repartitionByRange("key", mark).sortWithinPartitions("key", mark)
    rows = rows.select(F.spark_partition_id().alias("part"), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, before = word_bpe.tokenizer(path), 0
        for part in text_slices(batches, rows=1000):
            ids, ends = bpe.encode(part.column("text"))
            ids = np.insert(ids, ends, end)  # after each document
            ends = ends + np.arange(1, len(ends) + 1)
            starts = before + np.concatenate([[0], ends[:-1]])
            before += len(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column("part"), part.column("key"), pa.array(starts, pa.int64()), binaries(ids.astype(bpe.dtype), ends)],
                ["part", "key", "before", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return mapped(rows, run, f"part int, key {kind}, before bigint, ids binary")


def count_ids(tokens: DataFrame, size: int, dtype: str) -> DataFrame:
    """(id, n): how often each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in batches:
            for row in text_slices(iter([part]), "ids"):
                total += np.bincount(np.frombuffer(b"".join(row.column("ids").to_pylist()), dtype), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return mapped(tokens.select("ids"), run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS
) -> None:
    """Write the file. The driver holds one number for each id of the vocabulary and each partition."""
    path = path or public_tokenizers.path(FILE)
    size, dtype = word_bpe.tokenizer(path).tokenizer.get_vocab_size(), word_bpe.tokenizer(path).dtype.str
    tokens = stored(tokenised(docs, key, text, path, end), "tokens", "zstd", ROW_GROUP)
    counts = np.zeros(size, np.int64)
    for row in count_ids(tokens, size, dtype).collect():
        counts[row.id] = row.n
    slots = rans.Table.of_counts(counts).freq.astype(np.int64)
    width = int(dtype[2:])
    parts = tokens.groupBy("part").agg(F.sum(F.octet_length("ids") / width).cast("bigint").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for row in parts:
        starts[row.part] = at
        at += row.n
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(slots[i])) for i in np.flatnonzero(slots)], "id int, slots int").coalesce(1).write.parquet(f"{folder}/table")
    docs.select(docs[key].alias("key")).limit(0).write.parquet(f"{folder}/keys")  # their type, for an empty file too
    shared = spark.sparkContext.broadcast((slots, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, starts = shared.value
        table = rans.Table.of_counts(slots)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = [np.frombuffer(r[2], dtype) for r in rows]
            payload = rans.encode(np.concatenate(ids), table)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[0][3]], pa.int32()),
                    pa.array([rows[0][1]], pa.int64()),
                    pa.array([[r[0] for r in rows]], pa.list_(kind_of_key)),
                    pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
                    pa.array([payload], pa.binary()),
                ],
                ["part", "first", "keys", "starts", "sizes", "payload"],
            )

        for part in batches:
            kind_of_key = part.schema.field("key").type
            columns = [part.column(c).to_pylist() for c in ("part", "key", "before", "ids")]
            for number, k, before, ids in zip(*columns, strict=True):
                if rows and (held >= block_ids or rows[0][3] != number):
                    yield flush()
                    rows, held = [], 0
                rows.append((k, starts[number] + before, ids, number))
                held += len(ids) // width
        if rows:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"part int, first bigint, keys array<{kind}>, starts array<bigint>, sizes array<int>, payload binary"
    # tasks take the token files as it suits them; each writes to the folders of the parts that it has
    named = mapped(tokens, run, schema).withColumn("part", F.lpad(F.col("part").cast("string"), 8, "0"))
    ordered = named.sortWithinPartitions("part", "first")
    ordered.write.partitionBy("part").option("compression", "none").parquet(f"{folder}/blocks")


@lru_cache(maxsize=2)
def _table(raw: bytes) -> rans.Table:
    return rans.Table.of_counts(np.frombuffer(raw, np.int64))


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): ids packed as little-endian unsigned 32-bit integers, of every document of the file."""
    rows = spark.read.parquet(f"{folder}/table").collect()
    slots = np.zeros(1 + max((r.id for r in rows), default=0), np.int64)
    for row in rows:
        slots[row.id] = row.slots
    shared = spark.sparkContext.broadcast(slots.tobytes())
    kind = spark.read.parquet(f"{folder}/keys").schema["key"].dataType
    fields = [("keys", ArrayType(kind)), ("starts", ArrayType(LongType())), ("sizes", ArrayType(IntegerType())), ("payload", BinaryType())]
    blocks = spark.read.schema(StructType([StructField(*f) for f in fields])).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for part in batches:
            for k in range(part.num_rows):
                keys, starts, sizes = (part.column(c)[k].values for c in ("keys", "starts", "sizes"))
                ids = rans.decode(part.column("payload")[k].as_py(), table).astype("<u4")
                yield pa.RecordBatch.from_arrays([keys, starts, binaries(ids, np.cumsum(sizes.to_numpy()))], ["key", "start", "ids"])

    found = mapped(blocks, run, f"key {kind.simpleString()}, start bigint, ids binary")
    return found.withColumnRenamed("key", key)

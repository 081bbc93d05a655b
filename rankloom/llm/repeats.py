"""Exact removal of repeated byte strings by content anchors, shard sorts and hash counting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in any document.

1. Anchors. Winnowing gives each string of `length` bytes an anchor among its first `window` places, by their content
   alone, so it is the same one wherever the string stands. Strings that stand twice therefore have anchors whose core
   (bytes from the anchor on that all of its strings have) stands twice. Text whose cores are
   unique is done: it has no repeat.
2. Hulls. An anchor's hull holds all strings that the anchor answers for. If the whole hull stands twice, all do.
3. Suffix orders. What remains are the distinct hulls of anchors that share a core but not the hull: the edges of
   repeats. The hulls of a core are dealt to shards of bounded size, and each shard sorts the suffixes that start at
   its strings, with equal neighbours as one interval.
4. Merging. Where a core has several shards, their intervals are counted by hash: they are first put
   together by a hash of the first symbol (three quarters of their bytes), then by the next within those. An interval that is alone
   at some depth is unique, and one whose neighbours all stand twice in their own shards is settled; both
   go out of the next round. What is left at full depth are the repeated intervals. No suffix is sorted again.

Documents are rows: equal rows are documents of their own that repeat each other. Defined results: a null text counts
as empty; texts under `length` bytes have no repeat; null and repeated keys are fine; an empty table gives an empty
one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from rankloom.llm.common import kept, mapped, stored, text_slices

LENGTH = 400
WINDOW = 320
GROUP = 8
#: Hulls of one core that are sorted together.
SHARD_HULLS = 512
SYMBOLS = 2
#: Where the first symbol ends, as a part of a string. Strings of a core share it, so a symbol within it tells nothing.
FIRST = 0.75
#: Shard number of a core that has one shard only.
ALONE = -1


def anchors(raw: bytes, length: int = LENGTH, window: int = WINDOW, group: int = GROUP) -> np.ndarray:
    """Rows (at, first, stop): each start of a string of `length` bytes belongs to the anchor that is the last least
    of the `window` places from that start, by a hash of the `group` bytes from a place. Those of one anchor follow
    each other; first and stop bound the bytes of its strings."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - group + 1
    starts = len(data) - length + 1
    if starts < 1:
        return np.zeros((0, 3), np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(group):
        code = (code << np.uint64(8)) | data[k : k + n]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    key = (code >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    # least of each window from the running leasts of blocks, forwards and backwards
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:starts], ahead[window - 1 : window - 1 + starts])
    edge = np.flatnonzero(np.diff(least, prepend=~least[0], append=~least[-1]))
    at = 0xFFFFFFFF - (least[edge[:-1]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.stack([at, edge[:-1], edge[1:] - 1 + length], axis=1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cores(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(key, mark, first, stop, core, hull) of all anchors of all texts; first and stop: the hull's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for rows in text_slices(batches):
            row, places, core, hull = [], [], [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                raw = text.encode()
                for at, first, stop in anchors(raw, length, window).tolist():
                    row.append(i)
                    places.append((first, stop))
                    core.append(_signed(xxh64_intdigest(raw[at : at + length - window + 1])))
                    hull.append(xxh3_128_digest(raw[first:stop], at - first))
            own = pa.array(row, pa.int32())
            numbers = [pa.array([x[k] for x in places], pa.int32()) for k in range(2)]
            columns = [rows.column("key").take(own), rows.column("mark").take(own), *numbers, pa.array(core, pa.int64()), pa.array(hull, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "first", "stop", "core", "hull"])

    kind = docs.schema["key"].dataType.simpleString()
    return mapped(docs, run, f"key {kind}, mark bigint, first int, stop int, core bigint, hull binary")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, mark, core, shard, first, open, bytes): the wanted hulls, cut from their texts. Equal rows give equal
    hulls once each, which are never open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"core": pa.int64(), "shard": pa.int32(), "first": pa.int32(), "open": pa.bool_(), "bytes": pa.binary()}
        for rows in text_slices(batches):
            row, out = [], []
            for i, (text, found) in enumerate(zip(rows.column("text").to_pylist(), rows.column("wanted").to_pylist(), strict=True)):
                raw = text.encode()
                row += [i] * len(found)
                out += [(x["core"], x["shard"], x["first"], x["open"], raw[x["first"] : x["stop"]]) for x in found]
            own = pa.array(row, pa.int32())
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([rows.column("key").take(own), rows.column("mark").take(own), *columns], ["key", "mark", *kinds])

    kind = docs.schema["key"].dataType.simpleString()
    each = wanted.groupBy("mark").agg(F.collect_list(F.struct("first", "stop", "core", "shard", "open")).alias("wanted"))
    texts = docs.join(each, "mark").select("key", "mark", "text", "wanted")
    return mapped(texts, run, f"key {kind}, mark bigint, core bigint, shard int, first int, open boolean, bytes binary")


def shard_order(hulls: list[tuple[int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a shard's hulls, by their first `length` bytes: the hull, the start in it, and the interval
    (equal neighbours) of each row of the matrix."""
    rows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length) for raw in hulls]
    matrix = np.concatenate(rows)
    whose = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    start = np.concatenate([np.arange(len(r)) for r in rows])
    suffixes = matrix.view(f"S{length}")[:, 0]
    order = np.argsort(suffixes, kind="stable")
    new = np.ones(len(matrix), bool)
    suffixes = suffixes[order]
    new[1:] = suffixes[1:] != suffixes[:-1]
    return whose[order], start[order], np.cumsum(new) - 1


def shard_intervals(cut: DataFrame, length: int) -> DataFrame:
    """(core, n, symbols, starts). With symbols (hashes of its bytes in SYMBOLS parts): an interval to be merged, of n
    strings, with the (key, mark, start) of its string if that is one, and open. Without: open strings of an interval
    of several. A lone shard has only these."""
    cuts = (0, int(length * FIRST), length)

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        hulls = [r[6] for r in rows]
        whose, start, interval = shard_order(hulls, length)
        edge = np.flatnonzero(np.diff(interval, prepend=-1, append=-1))
        if rows[0][1] == ALONE:  # nothing to merge with: what stands once here is unique
            edges = [(edge[k], edge[k + 1]) for k in np.flatnonzero(np.diff(edge) > 1)]
        else:
            edges = list(zip(edge[:-1], edge[1:], strict=True))
        for a, b in edges:
            own = [(rows[w][2], rows[w][3], rows[w][4] + int(s)) for w, s in zip(whose[a:b], start[a:b], strict=True) if rows[w][5]]
            if rows[0][1] != ALONE:
                raw = hulls[whose[a]][start[a] : start[a] + length]
                symbols = [_signed(xxh64_intdigest(raw[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield rows[0][0], int(b - a), symbols, own if b - a == 1 else []
            if own and b - a > 1:  # stands twice in this shard already
                yield rows[0][0], int(b - a), None, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        held: list[tuple] = []
        schema = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*shard(held), strict=True)) or [()] * 4
            own = [[{"key": k, "mark": m, "start": s} for k, m, s in x] for x in columns[3]]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.list_(pa.int64())), pa.array(own, pa.list_(schema))],
                ["core", "n", "symbols", "starts"],
            )

        for batch in batches:
            schema = pa.struct([("key", batch.schema.field("key").type), ("mark", pa.int64()), ("start", pa.int32())])
            names = ("core", "shard", "key", "mark", "first", "open", "bytes")
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if held and held[0][:2] != row[:2]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    kind = cut.schema["key"].dataType.simpleString()
    dealt = cut.repartition("core", "shard").sortWithinPartitions("core", "shard")
    return mapped(dealt, run, f"core bigint, n int, symbols array<bigint>, starts array<struct<key:{kind},mark:bigint,start:int>>")


def merge(intervals: DataFrame) -> DataFrame:
    """(key, mark, start) of the open strings that stand twice: intervals of shards counted by hash, one symbol a round."""
    left = intervals.filter(F.col("symbols").isNotNull()).withColumn("block", F.col("core"))
    for depth in range(SYMBOLS):
        left = left.withColumn("block", F.xxhash64("block", F.col("symbols")[depth]))
        open_ = F.max(F.size("starts") > 0)
        total = left.groupBy("core", "block").agg(F.sum("n").alias("total"), open_.alias("open"))
        total = total.filter("total > 1 and open").select("core", "block")
        if depth == SYMBOLS - 1:  # only open strings are asked for; the others have been counted
            left = left.filter(F.size("starts") > 0)
        left = stored(left.join(total, ["core", "block"], "left_semi"), f"depth-{depth}", "zstd")
    found = left.select("starts").union(intervals.filter(F.col("symbols").isNull()).select("starts"))
    return found.select(F.explode("starts").alias("s")).select("s.*")


def repeated(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, shard_hulls: int = SHARD_HULLS) -> DataFrame:
    """(key, mark, start, stop): stretches of repeated strings, by document; they may overlap. docs: key, mark, text."""
    found = stored(cores(docs, length, window), "cores", "zstd")
    # sums by core are written before they are joined: Spark splits a core that much of the corpus shares only then
    common = stored(found.groupBy("core").count().filter("count > 1").select("core"), "shared-cores")
    found = stored(found.join(common, "core", "left_semi"), "common", "zstd")
    one = F.min(F.struct("mark", "first", "stop")).alias("one")
    hulls = stored(found.groupBy("core", "hull").agg(F.count("*").alias("n"), one), "hulls", "zstd")
    shared = hulls.groupBy("core").agg(F.count("*").alias("hulls"), F.sum((F.col("n") == 1).cast("long")).alias("open"))
    shared = stored(shared.filter("hulls > 1 and open > 0"), "open-cores")
    # whole hulls that stand twice
    twice = hulls.filter("n > 1").select("core", "hull")
    whole = found.join(twice, ["core", "hull"], "left_semi").select("key", "mark", F.col("first").alias("start"), "stop")
    # distinct hulls that share a core, of which one at least stands once
    shards = F.ceil(F.col("hulls") / shard_hulls)
    shard = F.when(shards == 1, ALONE).otherwise(F.pmod(F.xxhash64("hull"), shards)).cast("int")
    wanted = hulls.join(shared, "core").select("one.*", "core", shard.alias("shard"), (F.col("n") == 1).alias("open"))
    intervals = stored(shard_intervals(_cut(docs, wanted), length), "intervals", "zstd")
    edges = merge(intervals).select("key", "mark", "start", (F.col("start") + length).alias("stop"))
    return whole.union(edges)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, shard_hulls: int = SHARD_HULLS) -> DataFrame:
    """(key, n_bytes, spans, kept): the bytes of each text, the maximal removed runs, and the remaining bytes."""
    if window + GROUP > length:
        raise ValueError("the window must be shorter than the strings")
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[key], whole).alias("mark"), whole.alias("text"))
    spans = repeated(rows, length, window, shard_hulls).groupBy("key", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            size, kept, runs = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                raw = text.encode()
                own: list[list[int]] = []
                for x in sorted((s["start"], s["stop"]) for s in found or []):
                    if own and x[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x[1])
                    else:
                        own.append(list(x))
                at, pieces = 0, []
                for a, b in own:
                    pieces.append(raw[at:a])
                    at = b
                size.append(len(raw))
                kept.append(b"".join([*pieces, raw[at:]]))
                runs.append([{"start": a, "stop": b} for a, b in own])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(size, pa.int64()), pa.array(runs, kinds), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    own = (rows["mark"] == spans["mark"]) & rows["key"].eqNullSafe(spans["key"])
    found = rows.join(spans, own, "left").select(rows["key"], "text", "found")
    done = mapped(found, run, f"key {kind}, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary")
    return done.withColumnRenamed("key", key)


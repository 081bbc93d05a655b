"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces. Wherever the item stands in a text with at most
k edits, one piece at least stands there unchanged. An Aho-Corasick automaton finds all pieces in one reading of each
text, and Myers' bit-parallel distance verifies the stretches around them, overlapping ones together.

Both sides are compared with letters lower-cased and each white space character as a blank, so places are code points
of the original text. Items go to the executors in groups of at most `group_characters`; a larger benchmark takes
several readings, each with its own automaton, and the driver holds one group at a time.

An item shorter than `least` characters must stand unchanged, and as whole words: letters or digits at its ends have
none beside them in the text, so that clean documents stay.

Defined results: null or empty texts match nothing, nor do null or empty items; a very long text is read in one go,
as the automaton keeps only its hits; repeated items and rows are answered each; null keys stay; an empty benchmark or table gives
an empty result; extra columns are ignored (and kept by drop_contaminated).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import kept, mapped, stored, text_slices

#: Edits allowed for each character of an item.
RATE = 0.08
LEAST = 20
GROUP_CHARACTERS = 4_000_000

_BLANKS = {ord(c): " " for c in "\t\n\r\v\f\xa0  \x85"}


def folded(text: str) -> str:
    """Lower case, one blank for each white space; the length stays."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_BLANKS)


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers' bit-parallel edit distance of the pattern and the best stretch of text that ends at each character;
    anchored: that also starts at the text's start."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top, score = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), len(pattern)
    up, down = full, 0
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
        yield score


@lru_cache(maxsize=4096)
def verified(item: str, stretch: str, budget: int) -> tuple[int, int, int] | None:
    """(start, stop, edits) of the item's best place in a stretch of text, the first of equal ones; None if over budget."""
    best, stop = min((d, i + 1) for i, d in enumerate(distances(item, stretch)))
    if best > budget:
        return None
    back = list(distances(item[::-1], stretch[:stop][::-1][: len(item) + best], anchored=True))
    length = min((d, abs(i + 1 - len(item)), i + 1) for i, d in enumerate(back))[2]
    return stop - length, stop, best


class Matcher:
    """The automaton of a group of items [(item key, folded text)]."""

    def __init__(self, items: list[tuple[object, str]], rate: float, least: int = LEAST):
        self.least = least
        self.items = [(key, text, int(len(text) * rate) if len(text) >= least else 0) for key, text in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item key, start, stop, edits) of all places of items in a text."""
        if not self.items or not text:
            return []
        text = folded(text)
        near: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                near[n].append(end + 1 - size - offset)
        found = []
        for n, starts in near.items():
            key, item, budget = self.items[n]
            for a, b in stretches(sorted(set(starts)), len(item), budget, len(text)):
                if len(item) < self.least:
                    hit = (0, b - a, 0) if whole_words(text, a, b) else None
                else:
                    hit = verified(item, text[a:b], budget)
                if hit:
                    found.append((key, a + hit[0], a + hit[1], hit[2]))
        return found


def whole_words(text: str, start: int, stop: int) -> bool:
    """No word of the text is cut at the start or the stop of the stretch."""
    ends = (text[max(start - 1, 0) : start + 1], text[stop - 1 : stop + 1])
    return not any(len(pair) == 2 and pair.isalnum() for pair in (ends[0] if start else "", ends[1]))


def stretches(starts: list[int], length: int, budget: int, end: int) -> Iterator[tuple[int, int]]:
    """Where an item that may start around `starts` (ascending) can lie; starts within the budget of each other share one."""
    first = last = None
    for at in [*starts, None]:
        if first is not None and (at is None or at - last > 2 * budget):
            yield max(0, first - budget), min(end, last + length + budget)
            first = None
        first = at if first is None else first
        last = at


def _matcher(name: str, shared: Broadcast, rate: float, least: int) -> Matcher:
    return kept("matcher", name, make=lambda: Matcher(shared.value, rate, least))


def _groups(benchmark: DataFrame, key: str, text: str, group_characters: int) -> tuple[DataFrame, int]:
    """The items with a group number, and the number of groups; a group holds at most group_characters or one item."""
    size = F.length(benchmark[text])
    items = benchmark.filter(size > 0).select(benchmark[key].alias("key"), benchmark[text].alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = 1 + int(2 * total // group_characters)  # dealt by hash: twice as many as would just do
    return items.withColumn("group", F.pmod(F.xxhash64("text", "key"), F.lit(groups))), groups if total else 0


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    least: int = LEAST,
    group_characters: int = GROUP_CHARACTERS,
) -> DataFrame:
    """(key, item_key, start, stop, edits): each place of an item in a document, within the item's budget."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, start int, stop int, edits int"
    chosen = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    items, groups = _groups(benchmark, item_key, item_text, group_characters)
    found = spark.createDataFrame([], schema)
    for group in range(groups):
        rows = items.filter(F.col("group") == group).select("key", "text").collect()
        shared = spark.sparkContext.broadcast([(r.key, folded(r.text)) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared, rate, least)
            for part in text_slices(batches):
                keys, texts = part.column("key"), part.column("text").to_pylist()
                hits = [(i, *hit) for i, t in enumerate(texts) for hit in matcher.find(t)]
                own = keys.take(pa.array([h[0] for h in hits], pa.int32()))
                rest = [pa.array([h[k] for h in hits]) if hits else pa.array([], pa.int32()) for k in range(1, 5)]
                if hits:
                    yield pa.RecordBatch.from_arrays([own, rest[0], *[x.cast(pa.int32()) for x in rest[1:]]], ["key", "item", "start", "stop", "edits"])

        part = mapped(chosen, run, schema)
        found = part if groups == 1 else found.union(stored(part, f"group-{group}"))
    return found.withColumnsRenamed({"key": key, "item": item_key}) if key != item_key else found


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    least: int = LEAST,
    group_characters: int = GROUP_CHARACTERS,
) -> DataFrame:
    """The documents, unchanged, but those that hold an item."""
    spark = docs.sparkSession
    items, groups = _groups(benchmark, item_key, item_text, group_characters)
    for group in range(groups):
        rows = items.filter(F.col("group") == group).select("key", "text").collect()
        shared = spark.sparkContext.broadcast([(r.key, folded(r.text)) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared, rate, least)
            for batch in batches:
                clean = [not (t and matcher.find(t)) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = mapped(docs, run, docs.schema)
        docs = docs if groups == 1 else stored(docs, f"group-{group}")
    return docs

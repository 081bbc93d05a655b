"""Filter interaction audit: what each of several document filters removes, in every order of them, by a Gray-code walk.

A document fails a set of filters, its mask. Documents are counted by part and mask (a cell), so whatever the corpus
holds, a part has 32 cells for five filters. The audit then walks all subsets of filters in Gray-code order: each step
switches one filter on or off, raises or lowers the number of active failures of the cells that fail it, and moves the
running survivors by those cells whose number leaves or reaches zero. The states of all 32 subsets are stored; a step of
an order is the difference of two of them.

A text that another document of a smaller id has too is found by its SHA-256: copies are summed by hash and cell in
each task first, so a group of copies is a few rows, whatever its size.

Defined results: a null text counts as empty, a null part as the empty string; a document without id has no smaller or
larger ones, so it never fails as a copy nor makes one fail; documents that share an id and a text are both first;
a document with several labels has a label if any of them says so, and none without labels or with null ones; repeated
rows count each; very long texts are cut into words one at a time, within a task; an empty table has no parts and gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters' names in the order of their mask bits; the last is the one for copies.
FILTERS = "ABCDE"
WORDS = 200
COUNTED = ["kept", "good", "toxic"]
STEP_COLUMNS = {"filter_order": "string", "step": "int"} | dict.fromkeys(
    ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "long"
) | {"filter": "string"}


def failures(text: Column, words: Column) -> list[Column]:
    """The conditions under which a text fails the filters but the last."""
    n = F.size(words)
    return [
        n < WORDS,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 3,
        text.rlike("[#$%&*|]"),
    ]


def words_of(text: Column) -> Column:
    """The runs between white space of ASCII."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")


def masks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, digest, mask): the filters but the last that each document fails."""
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"))
    bits = [F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(failures(F.col("text"), F.col("words")))]
    return rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, key: str, good: str, toxic: str) -> DataFrame:
    """rows with flags good and toxic. Rows without a key meet no label and are spread by their text."""
    says = lambda name: F.max(F.coalesce(labels[name] == 1, F.lit(False))).cast("long")
    known = labels.filter(labels[key].isNotNull())
    known = known.groupBy(known[key].alias("key")).agg(says(good).alias("good"), says(toxic).alias("toxic"))
    known = known.withColumn("by", F.lit(0).cast("long"))
    spread = F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    found = rows.withColumn("by", spread).join(known, ["key", "by"], "left")
    flag = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return found.select("key", "part", "digest", "mask", flag("good"), flag("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, kept, good, toxic): documents by what they fail, copies included in the mask. Nothing here is keyed
    by a text alone before its copies are summed."""
    cell = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy(*cell, "key").agg(F.count("*").alias("n"))
    free = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("free")
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("least")
    each = each.groupBy(*cell).agg(F.sum("n").alias("n"), free, least)
    first = each.groupBy("digest").agg(F.min("least.key").alias("first"))  # a row a cell and text, not a document
    each = each.join(first, "digest")
    own = F.col("free") + F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct((F.col("mask") + (1 << len(FILTERS) - 1)).alias("mask"), (F.col("n") - own).alias("n")),
    )
    each = each.select("part", "good", "toxic", F.inline(split))
    measures = [F.sum("n"), F.sum(F.col("n") * F.col("good")), F.sum(F.col("n") * F.col("toxic"))]
    return each.groupBy("part", "mask").agg(*[m.alias(name) for m, name in zip(measures, COUNTED, strict=True)])


def walk(counts: np.ndarray) -> np.ndarray:
    """counts[mask]: what the cells hold. The answer's row for a subset of filters: what survives those."""
    size = len(counts)
    failed = [np.flatnonzero(np.arange(size) >> bit & 1) for bit in range(size.bit_length() - 1)]
    active = np.zeros(size, np.int64)  # filters switched on that a cell fails
    survivors = counts.sum(axis=0)
    states = np.zeros_like(counts)
    states[0] = survivors
    subset = 0
    for step in range(1, size):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        own = failed[bit]
        if subset >> bit & 1:
            survivors = survivors - counts[own[active[own] == 0]].sum(axis=0)
            active[own] += 1
        else:
            active[own] -= 1
            survivors = survivors + counts[own[active[own] == 0]].sum(axis=0)
        states[subset] = survivors
    return states


def shapley(kept: np.ndarray) -> list[int]:
    """What each filter removes, summed over all orders: a subset before it stands for all orders of both sides."""
    n = len(kept).bit_length() - 1
    out = []
    for bit in range(n):
        before = [s for s in range(len(kept)) if not s >> bit & 1]
        out.append(sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(kept[s] - kept[s | 1 << bit]) for s in before))
    return out


def steps(counts: np.ndarray) -> dict[str, list]:
    """All orders of the filters, step by step, each measure as a difference of stored states."""
    n = counts.shape[0].bit_length() - 1
    done, value = walk(counts), shapley(walk(counts)[:, 0])
    all_, alone = (1 << n) - 1, done[0] - done[[1 << bit for bit in range(n)]]
    out: dict[str, list] = {name: [] for name in STEP_COLUMNS}
    for order in permutations(range(n)):
        before, name = 0, "".join(FILTERS[bit] for bit in order)
        for step, bit in enumerate(order, 1):
            after = before | 1 << bit
            kept, (removed, good, toxic) = done[after, 0], done[before] - done[after]
            unique = done[all_ ^ 1 << bit, 0] - done[all_, 0]
            row = (name, step, kept, removed, alone[bit, 0] - removed, unique, good, toxic, value[bit], FILTERS[bit])
            for column, found in zip(out.values(), row, strict=True):
                column.append(found)
            before = after
    return out


def audit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """One row for each part, order of the filters and step of it. Long counts of documents: `kept` after the step,
    `removed` by it, `redundant` ones that fail its filter but went earlier, `unique_fails` that fail no other filter,
    `good_lost` and `toxic_lost` among the removed, `shapley` what its filter removes in all orders together."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(FILTERS), len(COUNTED)), np.int64)
        counts[rows["mask"].to_numpy()] = rows[COUNTED].to_numpy(np.int64)
        return pd.DataFrame({"part": rows["part"].iloc[0], **steps(counts)})

    found = cells(labelled(masks(docs, key, text, part), labels, key, good, toxic))
    kinds = ", ".join(f"{name} {kind}" for name, kind in STEP_COLUMNS.items())
    return found.groupBy("part").applyInPandas(run, f"part string, {kinds}")

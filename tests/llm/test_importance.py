from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import importance, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, prose, rows

LOWER = str.maketrans(importance.UPPER, importance.LOWER)


def words_of(text):
    return re.findall(importance.WORD, (text or "").translate(LOWER))


def runs(text, longest):
    words = words_of(text)
    return [" ".join(words[a : a + n]) for n in range(1, longest + 1) for a in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=importance.BUCKETS, percent=importance.PERCENT):
    """Every document by itself, its runs over the whole text."""
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    own = [[bucket(r) for r in runs(t, longest)] for _, t in docs]
    s = Counter(b for found in own for b in found)
    t = Counter(bucket(r) for x in target for r in runs(x, longest))
    up, down = float(s.total() + buckets), float(t.total() + buckets)
    gain = {b: floor(1000 * log((t[b] + 1.0) * up / ((s[b] + 1.0) * down))) for b in s}
    out = []
    for (key, text), found in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))
        out.append((key, len(found), weight, score, len(words_of(text)) >= importance.LEAST_WORDS))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks[r, drawn[r]] = place
        drawn[r] += 1
    seen = Counter()
    done = []
    for r in out:
        done.append((*r[:4], ranks.get((r, seen[r]))))
        seen[r] += 1
    return sorted(done, key=repr)


def texts(table):
    return [r.text for r in table.collect()]


def test_query_against_brute_force(spark):
    docs = list(documents()[["doc_id", "text"]].itertuples(index=False, name=None))
    got = rows(queries.op13_importance(spark, SMALL))
    assert got == brute(docs, texts(spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    assert len([r for r in got if r[4]]) > 10


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_runs_cross_lines(spark, longest):
    docs = [tuple(r) for r in documents().head(50)[["doc_id", "text"]].itertuples(index=False)]
    docs += [(1000 + k, "one\ntwo three\n\n! \nfour\nFive  six seven\n" * (k + 1)) for k in range(6)]
    target = [(1, "two three\nfour five six"), (2, None)]
    got = importance.draw(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(target, "item_id long, text string"), longest=longest, buckets=97, percent=40,
    )
    assert rows(got) == brute(docs, [t for _, t in target], longest, 97, 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=4), max_size=5), st.integers(1, 4))
def test_runs_in_lines_and_across_them_are_all_runs(lines, longest):
    within = [" ".join(w[a : a + n]) for w in lines for n in range(1, longest + 1) for a in range(len(w) - n + 1)]
    flat = [w for line in lines for w in line]
    want = [" ".join(flat[a : a + n]) for n in range(1, longest + 1) for a in range(len(flat) - n + 1)]
    assert Counter(within + importance.crossing(lines, longest)) == Counter(want)


def test_odd_rows(spark):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = importance.draw(clashing(odd_docs(spark)), target, percent=50)
    assert rows(got) == brute([r[:2] for r in odd_rows()], texts(target), percent=50)
    none = empty(spark.createDataFrame([], DOCS))
    assert rows(importance.draw(none, target)) == []
    assert rows(importance.draw(odd_docs(spark), empty(target))) == brute([r[:2] for r in odd_rows()], [])


def test_a_line_that_much_of_the_corpus_holds(spark):
    docs = [(k, f"the very same line of all\n{prose(25, k % 7)}\nTHE VERY same line of all") for k in range(300)]
    got = importance.draw(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same line",)], "text string"))
    assert rows(got) == brute(docs, ["same line"])

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import decontaminate, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, prose, rows

ITEMS = "item_id long, text string"


def least_edits(pattern, text):
    """Least edit distance of the pattern and any stretch of the text, by the plain table."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return last


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=20))
def test_distance(pattern, text):
    assert list(decontaminate.distances(pattern, text)) == least_edits(pattern, text)[1:]


def brute(docs, items, rate=decontaminate.RATE):
    fold = decontaminate.folded

    def stands(item, t):
        if len(item) >= decontaminate.LEAST:
            return min(least_edits(item, t)) <= int(len(item) * rate)
        at = [i for i in range(len(t)) if t.startswith(item, i)]
        cut = lambda k: 0 < k < len(t) and t[k - 1].isalnum() and t[k].isalnum()
        return any(not cut(i) and not cut(i + len(item)) for i in at)

    return sorted((k, n) for k, t in docs for n, item in items if t and item and stands(fold(item), fold(t)))


def pairs(found):
    return sorted({(r[0], r[1]) for r in found.collect()})


def edited(text, edits, rng):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "z", "yq", text[at].upper()]) + text[at + rng.randrange(2) :]
    return text


def test_edited_items_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(9, i)) for i in range(12)]
    docs = []
    for i in range(80):
        item = items[i % 12][1]
        docs.append((i, prose(8, 50 + i) + " " + edited(item, rng.randrange(0, 8), rng) + " " + prose(5, 90 + i)))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    want = brute(docs, items)
    assert pairs(got) == want and 20 < len({k for k, _ in want})
    texts, tests = dict(docs), dict(items)
    for r in got.collect():
        place = texts[r.doc_id][r.start : r.stop]
        assert least_edits(decontaminate.folded(tests[r.item_id]), decontaminate.folded(place))[-1] == r.edits


def test_groups_of_items_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, many = decontaminate.matches(docs, items), decontaminate.matches(docs, items, group_characters=3000)
    assert rows(one) == rows(many)
    left = decontaminate.drop_contaminated(docs, items, group_characters=3000)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(documents().doc_id) - {r.doc_id for r in one.collect()}


def test_query_finds_all_whole_items(spark):
    docs = documents()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    exact = {(d, i.item_id) for d, t in zip(docs.doc_id, docs.text, strict=True) for i in items if i.text in t}
    found = pairs(queries.op6_decontamination(spark, SMALL))
    assert exact <= set(found) and exact


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    long = prose(60, 1)
    items = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (4, "short"), (None, prose(40, 3)), (5, "x" * 40)], ITEMS)
    found = [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()]
    assert found.count((7, 1)) >= 2 and (8, 5) in found and found.count((5, None)) == 2
    left = decontaminate.drop_contaminated(docs, items)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 9, None, None], key=repr)
    assert rows(decontaminate.matches(docs, empty(items))) == [] and decontaminate.drop_contaminated(docs, empty(items)).count() == 12
    none = empty(spark.createDataFrame([], DOCS))
    assert rows(decontaminate.matches(none, items)) == rows(decontaminate.drop_contaminated(none, items)) == []


def test_a_part_of_an_item_is_no_leak(spark):
    item = prose(40, 5)
    docs = spark.createDataFrame([(1, prose(30, 9) + " " + item[60:120] + " " + prose(30, 11))], "doc_id long, text string")
    assert rows(decontaminate.matches(docs, spark.createDataFrame([(1, item)], ITEMS))) == []


def test_short_items_stand_as_whole_words(spark):
    items = [(1, "abc"), (2, "two words"), (3, "(x)"), (4, "7"), (5, ""), (6, None)]
    docs = [(1, "xx abc yy"), (2, "xxabc yy abcd"), (3, "ABC"), (4, "in two\nwords, or"), (5, "two  words"), (6, "f(x)=7a"), (7, "17 7.7"), (8, None), (9, "abc abc")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    got = decontaminate.matches(docs, items)
    assert pairs(got) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert pairs(got) == [(1, 1), (3, 1), (4, 2), (6, 3), (7, 4), (9, 1)]
    assert sorted((r.start, r.stop) for r in got.collect() if r.doc_id == 9) == [(0, 3), (4, 7)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [2, 5, 8]

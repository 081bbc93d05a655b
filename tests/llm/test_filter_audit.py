from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import filter_audit, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, rows

LABELS = "doc_id long, quality int, toxic int"


def failing(data):
    """The filters that each row (doc_id, text, …) fails."""
    out = []
    for key, text, *_ in data:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any(key is not None and k is not None and k < key and (t or "") == text for k, t, *_ in data),
        }
        out.append({f for f, v in fails.items() if v})
    return out


def brute(data, labels):
    """The audit by running each order over the rows, one filter after the other."""
    fails = failing(data)
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    out = []
    for part in {r[2] or "" for r in data}:
        own = [k for k, r in enumerate(data) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                shapley[f] += len(gone)
                early = sum(f in fails[k] for k in own) - len(gone)
                lost = [sum(data[k][0] in s for k in gone) for s in (good, toxic)]
                mine.append((part, "".join(order), step, len(left), len(gone), early, sum(fails[k] == {f} for k in own), *lost, f))
        out += [(*r[:-1], shapley[r[-1]], r[-1]) for r in mine]
    return sorted(out, key=repr)


def test_query_against_brute_force(spark):
    data = [tuple(r) for r in documents()[["doc_id", "text", "lang"]].itertuples(index=False)]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = rows(queries.op12_filter_audit(spark, SMALL))
    assert got == brute(data, labels) and {r[0] for r in got} == {"en", "de", "fr", "es"}


def test_odd_rows(spark):
    labels = [(5, 1, 0), (5, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (7, None, None)]
    more = [(6, "a # b", "en", "s", 1), (4, "a # b", "en", "s", 1), (4, "a # b", "fr", "s", 1), (None, "a # b", "en", "s", 1), (12, None, "en", "s", 1), (13, "WORD " * 300, "", "s", 1)]
    docs = odd_docs(spark).union(spark.createDataFrame(more, DOCS))
    taught = spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS mask", "2 AS key", "3 AS by", "'x' AS text")
    got = rows(filter_audit.audit(clashing(docs), taught))
    assert got == brute([*odd_rows(), *more], labels)
    assert rows(filter_audit.audit(empty(docs), spark.createDataFrame(labels, LABELS))) == []
    unlabelled = rows(filter_audit.audit(docs, spark.createDataFrame([], LABELS)))
    assert len(unlabelled) == len(got) and not any(r[7] or r[8] for r in unlabelled)


def test_copies_spread_over_parts(spark):
    data = [(k, "same text" if k % 3 else f"other {k}", "abc"[k % 2], None, None) for k in range(200, 100, -1)]
    got = rows(filter_audit.audit(spark.createDataFrame(data, DOCS).repartition(7), spark.createDataFrame([(k, 1, 0) for k in range(100, 150)], LABELS)))
    assert got == brute(data, [(k, 1, 0) for k in range(100, 150)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.data())
def test_walk_gives_the_survivors_of_every_subset(filters, data):
    size = 1 << filters
    counts = np.array(data.draw(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=size, max_size=size)), np.int64)
    states = filter_audit.walk(counts)
    for subset in range(size):
        want = sum((counts[m] for m in range(size) if not m & subset), np.zeros(2, np.int64))
        assert (states[subset] == want).all()
    total = filter_audit.shapley(states[:, 0])
    orders = 1
    for k in range(1, filters + 1):
        orders *= k
    assert sum(total) == orders * (states[0, 0] - states[-1, 0])

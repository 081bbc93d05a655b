from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rankloom.llm import fingerprints, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, rows

ALL = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def brute(text, scale=fingerprints.SCALE):
    """Each shingle by itself, in plain integers."""
    raw = (text or "").encode()
    found = {xxh64_intdigest(raw)} if 0 < len(raw) < fingerprints.WIDTH else set()
    for at in range(len(raw) - fingerprints.WIDTH + 1):
        h = 0
        for k in range(0, fingerprints.WIDTH, 8):
            h = mixed(h + int.from_bytes(raw[at + k : at + k + 8], "little") + (k == 0) & ALL)
        found.add(h)
    return sorted(h for h in found if h < (1 << 64) // scale) or sorted(found)[:1]


def answers(data):
    """What next_edits gives for rows (key, text), by plain lists and sets."""
    ordered = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    prints = {t: set(brute(t)) for _, t in ordered}
    out = []
    for (key, text), (_, after) in zip(ordered, [*ordered[1:], *ordered[:1]], strict=True):
        own, n = text or "", len(text or "") // 4
        changed = own[: len(own) - n] + (after or "")[:n]
        like = lambda a, b: len(a & b) / len(a) if a else float(not b)
        write = lambda h: fingerprints.written(np.array(sorted(h), np.uint64))
        a, b = prints[text], set(brute(changed))
        out.append((key, len(own), sha256(changed.encode()).hexdigest(), write(a), write(b), like(a, b), like(a, prints[after])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [fingerprints.RANGE_BYTES, 9000])
def test_query_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    docs = documents().head(60)
    got = fingerprints.next_edits(spark.createDataFrame(docs[["doc_id", "text"]]).repartition(5))
    assert rows(got) == answers(list(docs[["doc_id", "text"]].itertuples(index=False, name=None)))


def test_query_tells_edited_from_other_texts(spark):
    got = queries.op11_fingerprints(spark, SMALL).toPandas().sort_values("doc_id")
    docs = documents().sort_values("doc_id")
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_chars.tolist() == docs.text.str.len().tolist()
    n = docs.text.str.len() // 4
    after = [*docs.text[1:], docs.text.iloc[0]]
    want = [sha256((t[: len(t) - k] + a[:k]).encode()).hexdigest() for t, k, a in zip(docs.text, n, after, strict=True)]
    assert got.edited_sha256.tolist() == want
    long = (docs.text.str.len() > 500).to_numpy()
    assert long.sum() > 100 and got.near_edited[long].between(0.5, 0.95).mean() > 0.95
    assert (got.near_edited - got.near_next)[long].gt(0.4).mean() > 0.95
    prints = dict(zip(docs.text, got.fingerprint, strict=True))
    assert all(prints[t] == f for t, f in zip(docs.text, got.fingerprint, strict=True)) and len(set(prints.values())) == len(prints)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é😀\n", max_size=90), max_size=6), st.integers(1, 40), st.sampled_from([1, 3, 16]))
def test_sketches_against_brute_force(texts, piece, scale):
    plain = fingerprints.PIECE
    fingerprints.PIECE = piece  # long texts are cut; that changes nothing
    try:
        got = fingerprints.sketches(texts, scale)
    finally:
        fingerprints.PIECE = plain
    assert [h.tolist() for h in got] == [brute(t, scale) for t in texts]
    assert [fingerprints.read_back(fingerprints.written(h)).tolist() for h in got] == [h.tolist() for h in got]


def test_containment_of_very_unequal_texts(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n))
    small, large = words(250), words(4000)
    docs = [(1, small), (2, large), (3, large + " " + small), (4, words(900))]
    prints = fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    by = {r.doc_id: np.array(r.hashes, np.int64).view(np.uint64) for r in prints.collect()}
    assert fingerprints.likeness(by[1], by[3]) > 0.9 and fingerprints.likeness(by[3], by[1]) < 0.2
    # merged fingerprints are those of the joined set, however it is put together
    parts = [fingerprints.merged(prints.filter(F.col("doc_id").isin(k))) for k in ([2, 4], [1, 2], [3])]
    whole = fingerprints.merged(prints)
    assert rows(parts[0].union(parts[1]).union(parts[2]).distinct()) == rows(whole)
    assert {r.hash for r in whole.collect()} == {h for v in by.values() for h in v.view(np.int64).tolist()}
    found = {r.doc_id: r.containment for r in fingerprints.contained(prints, parts[2]).collect()}
    assert found[3] == found[2] == 1 and found[1] > 0.9 and found[4] == fingerprints.likeness(by[4], by[3])


@pytest.mark.parametrize("size", [fingerprints.RANGE_BYTES, 3000])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    docs = clashing(odd_docs(spark)).repartition(3)
    got = rows(fingerprints.next_edits(docs.filter("doc_id is not null")))
    assert got == answers([r[:2] for r in odd_rows() if r[0] is not None])
    both = fingerprints.next_edits(docs).collect()
    assert len(both) == 12 and [r.n_chars for r in both if r.doc_id == 8] == [70_000]
    assert {r.fingerprint for r in both if r.n_chars == 0} == {""}
    none = empty(spark.createDataFrame([], DOCS))
    assert rows(fingerprints.next_edits(none)) == rows(fingerprints.fingerprints(none)) == []
    alone = spark.createDataFrame([(1, "one text that stands alone here")], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fingerprints.next_edits(alone).collect()] == [(1.0, 31)]
    assert rows(fingerprints.contained(fingerprints.fingerprints(docs).filter("doc_id = 2"), fingerprints.merged(fingerprints.fingerprints(none)))) == [(2, None)]

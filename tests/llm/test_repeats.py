from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from rankloom.llm import queries, repeats
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, rows


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[j : j + length] for r in raws for j in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out.append((key, len(r), runs, bytes(x for x, g in zip(r, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r[0], r.n_bytes, len(r.spans), bytes(r.kept)) for r in repeats.drop_repeats(df, **options).collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = list(zip(*documents()[["doc_id", "text"]].T.values, strict=True))
    want = [(k, n, runs, hashlib.sha256(kept).hexdigest()) for k, n, runs, kept in brute(docs, 400)]
    found = queries.op4_repeats(spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_spans, r.kept_sha256) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.n_bytes - r.n_removed >= 0 for r in found) and any(r.n_removed for r in found)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(60)) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if rng.random() < 0.2 and text:
            cut = rng.randrange(len(text))
            text = text[:cut] + "#" + text[cut:]
        docs.append((i, text))
    docs += [(900, "x" * 300), (901, "ab" * 200), (902, "abc" * 37 + "d" + "abc" * 37), (903, docs[5][1]), (903, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # shards of two hulls, so that orders of several shards are merged
    assert got(df, length=50, window=24, shard_hulls=2) == brute(docs, 50)


def test_odd_rows(spark):
    data = [r for r in odd_rows() if r[0] != 8]
    data.append((8, "x" * 3000, None, None, None))
    df = clashing(spark.createDataFrame(data, DOCS))
    assert got(df) == brute([r[:2] for r in data], 400)
    assert got(empty(odd_docs(spark))) == []
    with pytest.raises(ValueError):
        repeats.drop_repeats(df, length=100, window=100)


def test_one_passage_in_many_texts(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    passage = words(70)
    docs = [(i, f"{words(30)} {passage} {words(30)}") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in repeats.drop_repeats(df, shard_hulls=64).collect():
        assert len(passage) <= r.n_bytes - len(r.kept) <= len(passage) + 14


def test_planted_passages_show_in_the_outcome_columns(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(size)) for _ in range(n))
    planted, short = words(70, 6), words(55, 5)  # both over 50 words; 489 and 329 bytes
    middle = [planted] * 12 + [short] * 12 + [""] * 12
    docs = [(i, f"{words(30 + i, 6)} {m} {words(30, 6)}") for i, m in enumerate(middle)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op4_repeats(spark, str(tmp_path)).collect()}
    for key, n, runs, kept in brute(docs, 400):
        r = found[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.has_repeat) == (n, n - len(kept), runs, key < 12)
        assert r.n_bytes == len(docs[key][1]) and (r.n_removed >= len(planted)) == (key < 12)


def test_anchors_depend_on_content_alone():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 105) for _ in range(3000))
    inside = {tuple(x) for x in repeats.anchors(text).tolist()}
    moved = repeats.anchors(b"0123456" + text + b"xyz").tolist()
    own = {(a - 7, f - 7, s - 7) for a, f, s in moved}
    assert len(inside & own) >= len(inside) - 3
    covered = [j for _, first, stop in repeats.anchors(text).tolist() for j in range(first, stop - 400 + 1)]
    assert covered == list(range(len(text) - 400 + 1))

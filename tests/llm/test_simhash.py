from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import queries, simhash
from rankloom.llm.components import components
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, prose, rows


def brute_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(docs, radius=2):
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (key, _), r in zip(docs, root, strict=True):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return sorted(((k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(docs, fps, root, strict=True)), key=repr)


def test_query_against_brute_force(spark):
    docs = list(zip(*documents()[["doc_id", "text"]].T.values, strict=True))
    assert rows(queries.op5_simhash(spark, SMALL)) == brute(docs)


def test_odd_rows(spark):
    got = rows(simhash.near_duplicates(clashing(odd_docs(spark))))
    assert got == brute([r[:2] for r in odd_rows()])
    assert rows(simhash.near_duplicates(empty(spark.createDataFrame([], DOCS)))) == []


def test_chains_of_near_copies(spark):
    base = prose(400, 2).split()
    data = []
    for i in range(60):  # each differs from the one before it
        base[(i * 37) % len(base)] = f"word{i}"
        data.append((100 - i, " ".join(base)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(simhash.near_duplicates(docs)) == brute(data)
    for radius in (0, 4):
        assert rows(simhash.near_duplicates(docs, radius=radius)) == brute(data, radius)
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=3)


def test_one_document_of_each_group_stays(spark):
    docs = clashing(odd_docs(spark))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    # wordless texts are one group (ids 1, 2, 3), 5 and 6 are copies
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 5, 7, 8, 9, None], key=repr)
    assert rows(simhash.drop_near_duplicates(empty(docs))) == []


def test_a_large_group_of_copies(spark):
    data = [(i, prose(80, 1)) for i in range(3000)] + [(9000 + i, prose(80, i)) for i in range(2, 30)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = simhash.near_duplicates(docs)
    assert got.filter(F.col("doc_id") < 3000).select("component_id").distinct().collect() == [(0,)]
    assert simhash.drop_near_duplicates(docs).count() == got.select("component_id").distinct().count()


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(a, b) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(150)) if a != b]
    links += [(500 + i, 501 + i) for i in range(40)] + [(999, 700 + i) for i in range(50)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = rows(components(spark.createDataFrame(links, "u long, v long")))
    assert got == sorted(((a, r) for a, r in root.items() if a != r), key=repr)
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from rankloom.llm import permutation_index, queries
from tests.llm.helpers import SMALL, empty, rows

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def exact(ids, vectors, asked, k=5):
    out = {}
    for q in asked:
        at = ids.tolist().index(q)
        score = permutation_index.cosine(vectors[at], vectors)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_query_recall(spark, folder):
    table = pd.read_parquet(f"{folder}/embeddings.parquet")
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    want = exact(ids, vectors, [i for i in ids if i % 50 == 0])
    got = queries.op8_permutation_index(spark, folder).toPandas()
    assert set(got.query_id) == set(want) and len(got) == 5 * len(want)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.score.is_monotonic_decreasing and q not in set(own.vec_id)
        at = [ids.tolist().index(v) for v in own.vec_id]
        assert np.allclose(permutation_index.cosine(vectors[ids.tolist().index(q)], vectors[at]), own.score, rtol=1e-13)
        hits += len(set(own.vec_id) & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1, "x"), (1, [2.0, 0.0], 1, "x"), (2, [1.0, 1.0], None, None), (3, [0.0, 0.0], 1, "x"),
        (4, None, 1, "x"), (5, [], 1, "x"), (6, [nan, 1.0], 1, "x"), (7, [inf, 1.0], 1, "x"), (8, [None, 1.0], 1, "x"),
        (None, [1.0, 0.0], 1, "x"), (9, [1.0, 0.0, 0.0], 1, "x"), (10, [-1.0, 0.0], 1, "x"), (50, [3.0, 0.0], 1, "x"), (100, None, 1, "x"),
    ]
    df = spark.createDataFrame(data, VECTORS)
    got = rows(permutation_index.search(df, df.filter("vec_id % 50 = 0")))
    half = 1 / np.sqrt(2)
    want = {(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, half), (0, 4, 10, -1.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, half), (50, 4, 10, -1.0)}
    assert {(q, r, v, round(s, 9)) for q, r, v, s in got} == {(q, r, v, round(s, 9)) for q, r, v, s in want}
    assert rows(permutation_index.search(empty(df), empty(df))) == []
    assert rows(permutation_index.search(df, empty(df))) == []


def test_ties_among_many_equal_vectors(spark):
    rng = np.random.default_rng(0)
    data = [(i, [1.0, 2.0, 3.0], 0, "") for i in range(1500)] + [(5000 + i, rng.normal(size=3).tolist(), 0, "") for i in range(500)]
    df = spark.createDataFrame(data, VECTORS)
    got = permutation_index.search(df, df.filter("vec_id = 700"), shard=400, reranked=50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_footrule_is_that_of_the_lists():
    rng = np.random.default_rng(1)
    vectors, pivots = rng.normal(size=(60, 8)), permutation_index.unit(rng.normal(size=(20, 8)))
    shard = permutation_index.Shard(np.arange(60), vectors, pivots, 6)
    lists = permutation_index.permutations(shard.unit, pivots, 6)
    place = lambda own, p: own.tolist().index(p) if p in own else 6
    for query in lists[:5]:
        want = [sum(abs(place(query, p) - place(own, p)) for p in set(query) | set(own)) for own in lists]
        assert shard.footrule(query).tolist() == want

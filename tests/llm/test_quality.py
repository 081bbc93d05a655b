from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import quality, queries
from tests.llm.helpers import DOCS, clashing, empty, odd_docs, odd_rows, rows

FOLDER = "/root/testdata/sf0.01"


def test_query_on_held_out_labels(spark):
    got = queries.op10_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    table = got.join(labels, "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert table.score.between(0, 1).all() and (table.predicted == (table.score >= 0.3)).all()
    assert table.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in table.doc_id]
    held = table[table.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    x, row, label = rng.normal(size=(14, quality.FEATURES)), np.repeat([0, 1, 2, 3], [5, 1, 3, 5]), np.array([1.0, 0.0, 1.0, 0.5])
    net = quality.Network({k: v.astype(float) if np.ndim(v) else v for k, v in quality.Network.new().p.items()})

    def loss():
        y = net.forward(x, row)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    slope = net.gradient(x, row, label)
    for name in net.SHAPES:
        at = tuple(0 for _ in net.SHAPES[name])
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - slope[name][at]) < 1e-6


def test_attention_sums_to_one_and_passages_are_apart():
    texts = ["", "one two", " \n ", "word " * 200, "x" * 5000]
    x, row = quality.passages(texts)
    assert np.unique(row).tolist() == [0, 1, 2, 3, 4] and np.bincount(row).tolist() == [1, 1, 1, 4, 1]
    f = quality.Network.new().forward(x, row)
    assert np.allclose(np.bincount(row, weights=f["a"]), 1)
    for k, text in enumerate(texts):
        assert np.allclose(quality.passages([text])[0], x[row == k])


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 0), (7, 0, 0), (3, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    got = quality.score(docs, net).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r in odd_rows()), key=repr)
    assert all(0 <= r.score <= 1 and abs(sum(r.weights) - 1) < 1e-3 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert quality.fit(docs, empty(labels)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert rows(quality.score(empty(spark.createDataFrame([], DOCS)), net)) == []


def test_only_learnable_labels_teach(spark):
    data = [(i, "good words " * 30, "en", "s", 1) for i in range(100)]
    docs = spark.createDataFrame(data, DOCS)
    labels = docs.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 0).otherwise(1).alias("quality"))
    assert quality.score(docs, quality.fit(docs, labels)).agg(F.min("score")).first()[0] > 0.5

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import lang_id, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, rows


def test_query_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SMALL).toPandas().set_index("doc_id")
    docs = documents().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    want = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]
    assert got.held_out.tolist() == want and 10 < sum(want) < len(docs)
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.95


def test_grams_do_not_cross_texts():
    together, apart = lang_id.counts(["ab cd", "", "éÉ"]), [lang_id.counts([t])[0] for t in ("ab cd", "", "éÉ")]
    assert (together == np.stack(apart)).all()
    assert (lang_id.counts(["AB,  9cd"]) == lang_id.counts(["ab cd"])).all()


def test_odd_rows(spark):
    docs = clashing(spark.read.parquet(f"{SMALL}/documents.parquet").union(odd_docs(spark)))
    model = lang_id.fit(docs)
    found = lang_id.predict(odd_docs(spark), model).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.rejected or letters
    twice = [(r.lang_pred, r.score) for r in found if r.doc_id in (5, 6)]
    assert len(twice) == 3 and len(set(twice)) == 1
    kept = lang_id.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.filter(F.col("doc_id").isin(1, 2, 3, 4)).filter("source = 's' or text is null").count() < 4
    names = lang_id.added(docs)
    assert names[0] not in docs.columns and set(names) <= set(lang_id.predict(docs, model).columns)


def test_nothing_to_learn(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert lang_id.fit(docs) is None
    assert {r.lang_pred for r in lang_id.predict(docs, None).collect()} == {"und"}
    none = empty(spark.createDataFrame([], DOCS))
    assert rows(lang_id.keep_known(none)) == []


def test_only_learnable_rows_teach(spark):
    data = [(i, "wort haus baum " * 20, "de" if zlib.crc32(str(i).encode()) % 5 else "wrong", "s", 1) for i in range(60)]
    model = lang_id.fit(spark.createDataFrame(data, DOCS))
    assert set(model.langs) == {"de"}


def test_far_text_is_rejected(spark):
    data = [(i, "wort haus baum " * 20, "de", "s", 1) for i in range(60)] + [(1000, "qzj xkq zzv " * 20, None, "s", 1)]
    docs = spark.createDataFrame(data, DOCS)
    kept = {r.doc_id for r in lang_id.keep_known(docs).collect()}
    assert kept == set(range(60))


def test_foreign_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    script = lambda a, z, n: "".join(chr(rng.randint(a, z)) if rng.random() > 0.16 else " " for _ in range(n))
    foreign = []
    for n in (150, 400, 1000, 3000):
        foreign += [script(a, z, n) for a, z in ((0x4E00, 0x9FFF), (0x430, 0x44F), (0x627, 0x64A), (0x3B1, 0x3C9))]
        foreign += [script(97, 122, n), base64.b64encode(rng.randbytes(n)).decode()]
    data = [(10**9 + i, t, None, "s", 1) for i, t in enumerate(foreign)]
    data += [(2 * 10**9, "The river was calm and the boats were home.", None, "s", 1)]
    got = lang_id.predict(docs.union(spark.createDataFrame(data, DOCS)), lang_id.fit(docs)).collect()
    assert {r.doc_id for r in got if r.rejected and lang_id.has_letter(r.text)} == {d[0] for d in data[:-1]}


def test_a_short_length_with_few_rows_asks_less():
    n = np.zeros((lang_id.LENGTHS, lang_id.STEPS + 1), np.int64)
    n[8, 600], n[8, 50], n[6, 900], n[9, 500] = 5000, 10, 3, 40
    floor = lang_id._floors_of(n)
    assert floor[8] == floor[9] == floor[-1] == 0.5 and floor[7] == 0.25 and floor[6] == 0.125

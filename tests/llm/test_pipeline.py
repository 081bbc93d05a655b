from __future__ import annotations

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from rankloom.llm import byte_bpe, decontaminate, lang_id, queries
from rankloom.llm.common import stored
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, rows
from tests.llm.test_pii import base
from tests.llm.test_simhash import brute


def test_entry_lists_all():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.queries()} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd_docs(spark).filter("doc_id is null or doc_id not in (7, 8)"))
    columns, items = docs.columns, spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SMALL), name)
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
        if name == "language":
            assert {lang_id.has_letter(r.text or "") for r in after} == {True}
            own = [r for r in before if r.doc_id is not None and lang_id.has_letter(r.text or "")]
            assert own and all(r in after for r in own)
        elif name == "near_duplicates":
            group = brute([(i, r.text) for i, r in enumerate(before)])
            groups = {g for *_, g in group}
            kept = [i for i, r in enumerate(before) if r in after]
            assert len(after) == len(groups) and {g for i, _, g in group if i in kept} == groups
        elif name == "decontamination":
            exact = [r for r in before if any(i.text in (r.text or "") for i in items)]
            assert exact and not [r for r in exact if r in after]
            matcher = decontaminate.Matcher([(i.item_id, decontaminate.folded(i.text)) for i in items], decontaminate.RATE)
            assert after and len(after) == sum(1 for r in before if not matcher.find(r.text or ""))
        elif name == "personal_data":
            assert sorted((r.doc_id or -1 for r in after)) == sorted((r.doc_id or -1 for r in before))
            assert not [r for r in after if base(r.text)]
            clean = {(r.doc_id, r.text) for r in before if not any(c in (r.text or "") for c in "0123456789@")}
            assert clean <= {(r.doc_id, r.text) for r in after}
        else:
            ranks = {t: k for k, t in enumerate(byte_bpe.token_bytes(public_tokenizers.path(byte_bpe.RANKS))) if t}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert sorted(r.text for r in after) == sorted(r.text or "" for r in before)
            for r in after[:50]:
                ids = np.frombuffer(r.ids, "<u4")
                assert r.n_tokens == len(ids) and ids.tolist() == library.encode_ordinary(r.text)


def test_run_applies_all_stages(spark):
    done = corpus_pipeline.run(spark, SMALL)
    assert done.columns == ["doc_id", "n_tokens", "ids", "text"]
    assert 0 < done.count() < len(documents())
    assert done.select("doc_id").distinct().count() == done.count()


def test_empty_table(spark):
    docs = empty(spark.createDataFrame([], DOCS))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
    assert rows(docs) == []


def test_odd_rows_and_clashing_columns_go_through_all_stages(spark):
    docs = clashing(spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id > 20").limit(80).unionByName(odd_docs(spark)))
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stored(stage(spark, docs, SMALL), name)
        assert name == "tokens" or docs.columns == columns
    left = [r for r in docs.collect() if r.doc_id == 7 or r.doc_id == 5]
    assert sorted(r.doc_id for r in left) == [5, 7]  # a text of 6000 words, and one of its copies
    assert all(len(r.ids) == 4 * r.n_tokens and r.text for r in left)


def test_learning_leaves_nothing_out(spark):
    """The language stage keeps every clean document of the test tables."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = lang_id.keep_known(docs)
    assert docs.join(kept, "doc_id", "left_anti").filter(F.col("text").rlike(r"\p{L}")).count() == 0

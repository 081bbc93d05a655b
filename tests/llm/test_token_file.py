from __future__ import annotations

import pathlib
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import queries, rans, token_file, word_bpe
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, odd_rows, rows

PATH = public_tokenizers.path(token_file.FILE)


def ids_of(texts):
    library = Tokenizer.from_file(PATH)
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_query_against_the_library(spark):
    docs = documents().sort_values("doc_id")
    want, at = [], 0
    for i, ids in zip(docs.doc_id, ids_of(docs.text), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(queries.op3_token_file(spark, SMALL)) == sorted(want, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words_as_the_library_does(text):
    ids, _ = word_bpe.tokenizer(PATH).encode(pa.array([text]))
    assert ids.tolist() == ids_of([text])[0][:-1]


def test_odd_rows_round_trip(spark, tmp_path):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    token_file.write(clashing(odd_docs(spark)), folder, block_ids=500)
    got = token_file.read(spark, folder).collect()
    texts = [r[1] for r in odd_rows()]
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(ids_of(texts))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([len(r.ids) // 4 for r in ordered])[:-1]]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered[:2]] == [None, None]


def test_blocks_stand_in_order(spark, tmp_path):
    """The files by name, and the blocks in each by place, hold ascending keys and starts without gaps."""
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(9, "source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_file.write(docs, folder, block_ids=3000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(pathlib.Path(folder, "blocks").glob("part=*/part-*.parquet"))
    blocks = [b for f in files for b in pq.ParquetFile(f).read().to_pylist()]
    assert len(files) > 2 and len(blocks) > len(files)
    starts, keys = ([x for b in blocks for x in b[c]] for c in ("starts", "keys"))
    sizes = [x for b in blocks for x in b["sizes"]]
    assert starts == [0, *np.cumsum(sizes)[:-1]] and [b["first"] for b in blocks] == [b["starts"][0] for b in blocks]
    assert keys == sorted(documents().doc_id)


def test_empty_table(spark, tmp_path):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    token_file.write(empty(spark.createDataFrame([], DOCS)), folder)
    assert rows(token_file.read(spark, folder)) == []


@pytest.mark.parametrize("size", [0, 1, 127, 128, 5000, 300_000])
def test_rans_round_trip(size):
    ids = np.random.default_rng(size).zipf(1.3, size).clip(max=60_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=60_001))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    marks = rans.checkpoints(block)
    parts = [rans.decode(block, table, k, k + 1) for k in range(marks)]
    assert (np.concatenate(parts) == ids).all() if parts else size == 0


def test_rans_many_rare_ids():
    counts = np.ones(400_000, np.int64)
    counts[7] = 1 << 40
    table = rans.Table.of_counts(counts)
    assert table.freq.sum() == 1 << rans.BITS and (table.freq > 0).all()


def test_damage_is_found():
    ids = np.arange(2000, dtype=np.uint32) % 50
    table = rans.Table.of_counts(np.bincount(ids))
    block = bytearray(rans.encode(ids, table))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)

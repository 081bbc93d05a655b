from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from rankloom.llm import pii, queries
from tests.llm.helpers import DOCS, SMALL, clashing, documents, empty, odd_docs, rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

ODD = [
    "a@b.c-d%x@y.z", "foo@bar", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (234) 567-8901x", "4111 1111 1111 1111 and 4111111111111112",
    "bob (at) site (dot) com", "1" * 2000, "a" * 3000 + "@x.y", "😀 a@b.co 😀 1.2.3.4", "+12 (((( 34567890",
    "call +1 (269) 555-3296 4524132264652876 now", "0001.002.03.4 1.2.3.0000255", "@@a@b.c@d.e", "+1-- +1 2", "é@b.c a.b@c-.d..e",
]


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return sorted(found)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op9_pii(spark, SMALL).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        spans = base(t)
        counts = tuple(sum(1 for s in spans if s[1] == k) for k in range(4))
        assert tuple(got[i])[1:5] == counts
        assert got[i].base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert {x for x in written(spans).split(",") if x} <= set(got[i].spans.split(","))


def test_odd_texts(spark):
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (50, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit("x"))
    found, column = pii.find(df, weights={})
    assert column != "spans" and found.columns[:3] == df.columns
    own = found.select("text", pii.written(F.filter(column, lambda s: s["base"])).alias("base"), F.col(column)).collect()
    for r in own:
        assert r.base == written(base(r.text)), r.text
    assert rows(pii.redact(empty(clashing(odd_docs(spark))))) == []


def test_model_adds_what_the_labelers_agree_on(spark):
    plain = [(i, f"mail to p{i}@host{i}.com or call +1 (555) 010-{2000 + i} from 10.0.{i}.7, version {i}.0 of 4 parts") for i in range(60)]
    data = plain + [(1000, "call +1 (269) 555-3296 4524132264652876 now"), (1001, "mail bob (at) site (dot) com"), (1002, "released 999.1.1.1 and 4111111111111112")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found, column = pii.find(df)
    got = {r[0]: r[1] for r in found.select("doc_id", pii.written(F.col(column))).collect()}
    assert got[1000] == "phone:8:22,card:23:39" and got[1001] == "email:5:28" and got[1002] == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1000] == "call +1 <PHONE> <CARD> now" and clean[1001] == "mail <EMAIL>" and clean[1002] == data[-1][1]


def test_estimate_separates_reliable_votes():
    patterns = {(0, 1, 1, 1, 0): 500.0, (0, -1, -1, -1, 0): 300.0, (0, 1, 1, 0, 0): 50.0, (0, -1, 1, 0, 0): 20.0, (1, 0, 1, 1, 1): 5.0}
    belief = pii.estimate(patterns)
    assert belief[0, 1, 1, 1, 0] > 0.99 and belief[0, -1, -1, -1, 0] < 0.01 and belief[1, 0, 1, 1, 1] > 0.9
    weights = pii.train(patterns, belief)
    assert weights["rule=1"] > weights["rule=-1"]


def test_redact_keeps_other_columns(spark):
    docs = clashing(odd_docs(spark))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    assert rows(clean) == rows(docs)  # nothing personal in them
    own = spark.createDataFrame([(1, "x a@b.com y", "en", "s", 11)], DOCS)
    assert rows(pii.redact(own)) == [(1, "x <EMAIL> y", "en", "s", 11)]


def test_native_plan(spark):
    plan = queries.op9_pii(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))

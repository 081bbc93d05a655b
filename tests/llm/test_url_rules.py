from __future__ import annotations

import random

from pyspark.sql import functions as F

from rankloom.llm import queries, url_rules
from tests.compare import connect, differences
from tests.llm.helpers import SMALL, clashing, empty, rows

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in rules if None not in r and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_query_matches_sql(spark):
    name = "op1_url_rules"
    assert differences(queries.queries()[name](spark, SMALL), connect(SMALL), queries.SQL[name]) is None


def test_random_urls_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "aa.com", "net", "a.net", "com.", ".com", "", "é.com", "A.Com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", "/é", "/\U0010ffff"]
    rules = [(rng.choice(hosts[:8]), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    rules += [("a.com", "/a", "block"), ("a.com", "/a", "allow"), (None, "/", "block"), ("com", None, "block")]
    urls = [None, "", "a.com/a", "://", "http://", "http://a.com?x=/a", "http://a.com#/a", "x://y://a.com/a", "HTTP://A.COM/A", "http://a\n.com/a\nb"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', '/z'])}" for _ in range(300)]
    urls += ["http://a.com/a/b"] * 50 + ["http://" + "s." * 300 + "a.com/" + "a" * 5000]
    data = [(i if i % 40 else None, u, "clash") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(data, "page_id long, url string, host string")
    got = rows(url_rules.judge(pages, spark.createDataFrame(rules, RULES)))
    assert got == sorted(((i, *brute(u, rules)) for i, u, _ in data), key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = empty(spark.createDataFrame([], RULES))
    assert rows(url_rules.judge(pages, none)) == [(1, "a.com", "/", None, "allow")]
    assert rows(url_rules.judge(empty(clashing(pages.withColumn("source", F.lit("s")))), spark.createDataFrame(queries.URL_RULES, RULES))) == []


def test_native_plan(spark):
    plan = queries.op1_url_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_a_key_that_many_hosts_share_is_swept_once(spark, monkeypatch):
    pages = spark.range(5000).selectExpr("id AS page_id", "concat('http://h', id, '.com/index.html') AS url").repartition(4)
    swept = []
    plain = url_rules.stored
    monkeypatch.setattr(url_rules, "stored", lambda df, label, *a: swept.append((label, plain(df, label, *a))) or swept[-1][1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_rules.judge(pages, spark.createDataFrame(queries.URL_RULES, RULES))
        assert got.filter("rule = 'com/'").count() == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = dict(swept)["sweep"]
    assert table.filter("kind = 1").count() == 5001  # one for com, one for each host
    sizes = sorted(r["count"] for r in table.groupBy("part").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]

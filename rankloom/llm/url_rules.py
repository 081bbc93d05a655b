"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; the longest wins.
Every host suffix of a url, its labels reversed, and its path make one canonical key; a rule's key is a prefix of
exactly the keys that it fits, so it is the interval from that key to the key followed by byte FF, which no text
holds. Intervals of rules nest. Distinct keys and interval bounds are sorted together in range partitions and swept once: each
bound carries the rule that is on top of the stack after it, and a url's key takes the last bound before it. What a
partition starts with comes from the last bound of those before it, one row a partition.

Defined results: a null url or one without `://` has empty host and path and fits no rule; rules that are repeated
count once, `block` before `allow`; null rule fields drop the rule; without rules every url gets the default verdict;
repeated rows and null page keys are answered row by row; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path).cast("binary")


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, kind 0, top): both ends of each rule's interval, with the rule on top of the stack after it."""
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    start = _key(_labels(F.col("host")), F.col("path"))
    opened = rules.select("host", start.alias("key"), F.lit(1).alias("step"), rule.alias("rule"))
    closed = rules.select("host", F.concat(start, F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"))
    ends = opened.unionByName(closed, allowMissingColumns=True)
    in_order = Window.partitionBy("host").orderBy("key")
    ends = ends.withColumn("level", F.sum("step").over(in_order))
    on_level = Window.partitionBy("host", "level").orderBy("key")
    top = F.when(F.col("level") > 0, F.last("rule", ignorenulls=True).over(on_level))
    return ends.select("key", F.lit(0).alias("kind"), F.struct(top.alias("rule")).alias("top"))


def sweep(urls: DataFrame, bounds: DataFrame) -> DataFrame:
    """urls (key, kind 1, …) with `top`: the rule in force at each key."""
    both = urls.unionByName(bounds, allowMissingColumns=True)
    dealt = both.repartitionByRange("key", "kind").sortWithinPartitions("key", "kind")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "sweep")
    last = dealt.filter("kind = 0").groupBy("part").agg(F.max_by("top", "key").alias("last"))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.last("last", ignorenulls=True).over(before).alias("before"))
    upto = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("top", F.last("top", ignorenulls=True).over(upto)).filter("kind = 1")
    swept = swept.join(F.broadcast(parts), "part")  # one row a partition of the sweep
    return swept.withColumn("top", F.coalesce("top", "before")).drop("before", "part", "kind")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of each page; rules: (host, path, verdict)."""
    parsed = pages.select(pages[key].alias("page"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    places = parsed.select("host", "path").distinct()
    depth = F.explode(F.sequence(F.lit(1), F.least(F.size(_labels(F.col("host"))), F.lit(deepest))))
    keys = places.select("host", "path", depth.alias("depth"))
    keys = keys.select("host", "path", _key(F.slice(_labels(F.col("host")), F.lit(1), F.col("depth")), F.col("path")).alias("key"))
    # a key that many hosts share, as com//index.html, is swept once; what it finds meets them in a join Spark can split
    swept = sweep(keys.select("key", F.lit(1).alias("kind")).distinct(), _bounds(rules))
    swept = swept.select("key", "top.rule").filter("rule IS NOT NULL")
    best = stored(keys.join(swept, "key").groupBy("host", "path").agg(F.max("rule").alias("best")), "best")
    found = parsed.join(best, ["host", "path"], "left")
    return found.select(
        F.col("page").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

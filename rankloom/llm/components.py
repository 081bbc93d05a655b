"""Connected components of a table of links, by alternating large and small stars. No links give no components; links
that repeat, in either direction, count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all of its v. The least ones are written first: Spark splits a node with
    many links only where both sides of the join come straight from a shuffle, and not from a sum over the same key."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    far = _least(both).filter("v > u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    own = near.select("u", F.col("m").alias("v"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node u but the least of its component, with that least node v.

    links: (u, v) with u <> v, in any order and number. Every round is written to the shared folder; the driver sees
    one row a round, the number and a sum of the links, and stops when they no longer change.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    links = stored(links.select("u", "v").distinct(), "links")
    before, now = None, mark(links)
    while now != before and now[0]:
        links = stored(_small_star(_large_star(links)), "links")
        before, now = now, mark(links)
    return links

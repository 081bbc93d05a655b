"""The order tables seen as a songs table: every line item is one song in one chart year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.tables import read_table

# Songs column -> (tables it needs besides lineitem, expression). The SQL twin is in plans/oracle.py.
SONG_COLUMNS = {
    "title": (["part"], "p_name"),
    "artist": (["supplier"], "s_name"),
    "genre": (["part"], "p_name"),
    "year_released": (["orders"], "year(o_orderdate)"),
    "chart_year": ([], "year(l_shipdate)"),
    "artist_type": (["supplier", "nation", "region"], "r_name"),
    "pop": ([], "cast(l_quantity as int)"),
    "bpm": (["part"], "p_size"),
    "nrgy": ([], "cast(round(l_discount * 100) as int)"),
    "dnce": ([], "cast(round(l_tax * 100) as int)"),
    "db": ([], "-l_linenumber"),
    "spch": ([], "cast(round(l_tax * 100) as int)"),
    "acous": ([], "cast(l_quantity as int)"),
    "val": (["part"], "cast(round(p_retailprice) as int)"),
    "dur": ([], "cast(floor(l_extendedprice / 100) as int)"),
}
JOINS = {
    "orders": ("l_orderkey", "o_orderkey"),
    "part": ("l_partkey", "p_partkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
    "nation": ("s_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
}


def songs_from_orders(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The asked songs columns. Only the tables they need are joined.

    Spark broadcasts a table only when its files are below its broadcast threshold, and joins larger ones by
    shuffle, splitting hot keys.
    """
    needed = {table for name in columns for table in SONG_COLUMNS[name][0]}
    songs = read_table(spark, folder, "lineitem")
    for table, (left, right) in JOINS.items():
        if table in needed:
            songs = songs.join(read_table(spark, folder, table), F.col(left) == F.col(right))
    return songs.select(*(F.expr(SONG_COLUMNS[name][1]).alias(name) for name in columns))

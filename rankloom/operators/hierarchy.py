"""Group -> sub-group -> genre, as a table, as nodes with sizes, and as one nested JSON document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.classify import first_match, sub_group
from rankloom.operators.positions import PART, PLACE, POSITION, placed_rows, write_positions


def hierarchy(
    df: DataFrame,
    rules: list[tuple[str, str]],
    lists: Mapping[str, list[tuple[str, list[str]]]],
    defaults: Mapping[str, str | None],
    default_group: str = "Other",
    genre: str = "genre",
) -> DataFrame:
    """(genre_group, sub_group, genre, count), one row per genre. Genres are counted first, then classified."""
    name = F.col(genre)
    return (
        df.groupBy(name.alias("genre"))
        .agg(F.count("*").alias("count"))
        .withColumn("genre_group", first_match(F.col("genre"), rules, default_group))
        .withColumn("sub_group", sub_group(F.col("genre_group"), F.col("genre"), lists, defaults))
        .select("genre_group", "sub_group", "genre", "count")
    )


def hierarchy_nodes(table: DataFrame) -> DataFrame:
    """Every node of the tree with its size: level 0 is the root, 3 a genre; lower names are NULL."""
    return (
        table.rollup("genre_group", "sub_group", "genre")
        .agg(F.sum("count").alias("size"), F.grouping_id().alias("_id"))
        .withColumn("level", F.lit(3) - F.bit_count("_id"))
        .drop("_id")
    )


def _opened(name: Column) -> Column:
    """{"name": …, "children": [ as text; a null name is left out."""
    own = F.to_json(F.struct(name.alias("name")))
    own = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.substring(own, F.lit(2), F.length(own) - 2), F.lit(",")))
    return F.concat(F.lit("{"), own, F.lit('"children":['))


def _branch(name: str, children: Column) -> Column:
    return F.concat(_opened(F.col(name)), children, F.lit("]}"))


def _leaf() -> Column:
    return F.to_json(F.struct(F.col("genre").alias("name"), F.col("count").alias("size")))


def _joined(name: str, text: Column) -> Column:
    """The texts of a group, comma-joined in the order of their names."""
    by_name = F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), text.alias("text"))))
    return F.array_join(F.transform(by_name, lambda node: node["text"]), ",")


def hierarchy_json(table: DataFrame, root: str = "Genres") -> DataFrame:
    """The tree as one JSON string: {name, children: [...]}; a genre has name and size. Children go by name.

    Each sub-group becomes text where its genres are, then only those texts are gathered. The document is one value,
    which one task must hold; `write_tree` and `hierarchy_lines` have no such limit.
    """
    sub_groups = table.groupBy("genre_group", "sub_group").agg(_joined("genre", _leaf()).alias("children"))
    groups = sub_groups.groupBy("genre_group").agg(_joined("sub_group", _branch("sub_group", F.col("children"))).alias("children"))
    tree = groups.agg(_joined("genre_group", _branch("genre_group", F.col("children"))).alias("children"))
    return tree.withColumn("root", F.lit(root)).select(_branch("root", F.col("children")).alias("json"))


def hierarchy_lines(table: DataFrame, root: str = "Genres") -> DataFrame:
    """The tree as JSON lines, one a genre, with the names above it: of any size, since no row meets another."""
    path = F.array(F.lit(root), "genre_group", "sub_group")
    return table.select(F.to_json(F.struct(path.alias("path"), F.col("genre").alias("name"), F.col("count").alias("size"))).alias("json"))


def tree_lines(spark: SparkSession, path: str, root: str = "Genres") -> DataFrame:
    """(position, line): the same document in lines, one a genre, which follow each other by position. From a table
    (genre_group, sub_group, genre, count) that `write_positions` wrote in the order of those names, nulls first.

    A genre's line opens the branches that begin with it and closes those that end with it. It sees that from the names
    of the genres before and after it, in its own range of the order or at the edge of the next, so no task gathers a
    group.
    """
    rows = placed_rows(spark, path)
    names = F.struct("genre_group", "sub_group")
    in_part = Window.partitionBy(PART).orderBy(PLACE)  # a range of bounded size
    rows = rows.withColumn("before", F.lag(names).over(in_part)).withColumn("after", F.lead(names).over(in_part))
    edges = rows.groupBy(PART).agg(F.min_by(names, PLACE).alias("first"), F.max_by(names, PLACE).alias("last"))
    by_part = Window.orderBy(PART)  # one row a range
    edges = edges.select(PART, F.lag("last").over(by_part).alias("last"), F.lead("first").over(by_part).alias("first"))
    rows = rows.join(F.broadcast(edges), PART)  # one row a range
    before, after = F.coalesce("before", "last"), F.coalesce("after", "first")

    def same(other: Column, *columns: str) -> Column:
        each = [other.getField(name).eqNullSafe(F.col(name)) for name in columns]
        return other.isNotNull() & (each[0] & each[1] if len(each) > 1 else each[0])

    text = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    new_group, new_sub = ~same(before, "genre_group"), ~same(before, "genre_group", "sub_group")
    end_group, end_sub = ~same(after, "genre_group"), ~same(after, "genre_group", "sub_group")
    line = F.concat(
        text(before.isNotNull(), F.lit(",")),  # stands before whatever this line opens first
        text(new_group, _opened(F.col("genre_group"))),
        text(new_sub, _opened(F.col("sub_group"))),
        _leaf(),
        text(end_sub, F.lit("]}")),
        text(end_group, F.lit("]}")),
    )
    ends = spark.createDataFrame([(0, 1), ((1 << 63) - 1, 0)], f"{POSITION} bigint, opens int")
    edge = F.when(F.col("opens") == 1, _opened(F.lit(root))).otherwise(F.lit("]}"))
    return rows.select(POSITION, line.alias("line")).union(ends.select(POSITION, edge))


def write_tree(table: DataFrame, path: str, root: str = "Genres", partitions: int | None = None) -> None:
    """The document of `hierarchy_json`, of any size, as text files below `path`/json: joined in the order of their
    names they are the document. (genre_group, sub_group, genre) must be unique."""
    order = ["genre_group", "sub_group", "genre"]
    write_positions(table.select(*order, "count"), order, f"{path}/rows", partitions, nulls_first=True)
    tree_lines(table.sparkSession, f"{path}/rows", root).orderBy(POSITION).select("line").write.text(f"{path}/json")

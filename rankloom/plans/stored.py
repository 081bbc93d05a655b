"""Questions answered from tables that are written once: indexes, bitmaps, partial sums, trees and stacks in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import fixed_values as fixed
from rankloom.operators import (
    add_batch,
    classify_by_rules,
    distinct_in,
    hierarchy,
    merged_counts,
    merged_totals,
    page_at,
    question_sums,
    ranked_share,
    read_positions,
    search_index,
    stack_positions,
    tree_lines,
    write_bitmaps,
    write_positions,
    write_question_sums,
    write_search_index,
    write_tree,
)
from rankloom.plans import part_rules, views
from rankloom.sources import read_mixed_csv, read_table, scratch_folder, songs_from_orders, write_csv

Query = Callable[[SparkSession, str], DataFrame]

#: Questions that are answered from one reading: a name, the period and what is ranked in it.
QUESTIONS = {
    "genres_by_release_year": ("year_released", ["genre"]),
    "genres_by_chart_year": ("chart_year", ["genre"]),
    "artists_by_release_year": ("year_released", ["artist"]),
    "artists_by_chart_year": ("chart_year", ["artist"]),
    "types_by_release_year": ("year_released", ["artist_type"]),
    "types_by_chart_year": ("chart_year", ["artist_type"]),
}


def table_page_far(spark: SparkSession, folder: str) -> DataFrame:
    """Page 500 of the order lines, dearest first."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    path = scratch_folder(spark)
    write_positions(lines, ["-l_extendedprice", "l_orderkey", "l_linenumber"], path)
    return page_at(spark, path, 10, 500)


def table_positions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    write_positions(customers, ["c_mktsegment", "-c_custkey"], path)
    return read_positions(spark, path)


def table_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of `table_search`, from the blocks that may hold them."""
    path = scratch_folder(spark)
    parts = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    write_search_index(parts.sort("p_brand", "p_name"), path, block_rows=100)
    return search_index(spark, path, "RING brand#1 eco")


def document_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    texts = read_table(spark, folder, "documents").select("doc_id", "lang", "text").sort("lang", "doc_id")
    write_search_index(texts, path, ["text"], block_rows=100)
    return search_index(spark, path, "Caci tion", ["text"]).drop("text")


def parts_by_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of `classified_parts` from a table of rules, one a text."""
    rules = [(k, text, label) for k, (pattern, label) in enumerate(part_rules.PART_RULES) for text in pattern.split("|")]
    rules = spark.createDataFrame(rules, "priority int, text string, label string")
    parts = read_table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("genre"))
    return classify_by_rules(parts, "genre", rules, "Other", "genre_group")


def documents_by_item_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts by rules made of the benchmark: the first item whose last word stands in the text."""
    rules = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("priority"),
        F.element_at(F.split("text", " "), -1).alias("text"),
        F.concat(F.lit("item "), F.col("item_id")).alias("label"),
    )
    texts = read_table(spark, folder, "documents").select("doc_id", "text")
    return classify_by_rules(texts, "text", rules, "none", "item").drop("text")


def _artist_bitmaps(spark: SparkSession, folder: str) -> str:
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, "year_released", "artist_type", "artist")
    write_bitmaps(songs, ["year_released", "artist_type"], "artist", path)
    return path


def artists_in_span(spark: SparkSession, folder: str) -> DataFrame:
    """Unique artists of each type over three years, from the stored bitmaps of single years."""
    return distinct_in(spark, _artist_bitmaps(spark, folder), "artist_type", where="year_released BETWEEN 1996 AND 1998")


def artists_in_any_year(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_in(spark, _artist_bitmaps(spark, folder))


def artists_kept_up(spark: SparkSession, folder: str) -> DataFrame:
    """Unique artists of each type over all years, the later years as a batch that was added."""
    songs = songs_from_orders(spark, folder, "year_released", "artist_type", "artist")
    path, by = scratch_folder(spark), ["year_released", "artist_type"]
    few = songs.where("year_released < 1998 AND artist < 'Supplier#000000060'")
    write_bitmaps(few, by, "artist", path)
    write_bitmaps(songs.exceptAll(few), by, "artist", path, batch=1)
    return distinct_in(spark, path, "artist_type")


def title_words_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the titles with their place in the order of the word table."""
    path = scratch_folder(spark)
    write_positions(views.title_words(songs_from_orders(spark, folder, "title")), ["-freq", "word"], path)
    return read_positions(spark, path)


def genre_table_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The whole genre table with each row's place."""
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, "genre")
    table = hierarchy(songs, part_rules.PART_RULES, part_rules.PART_LISTS, part_rules.PART_DEFAULTS)
    write_positions(table, ["genre_group", "sub_group", "genre"], path)
    return read_positions(spark, path)


def songs_kept_up(spark: SparkSession, folder: str) -> DataFrame:
    """Songs and popularity per release year and type, the later years as a batch that was added."""
    songs = songs_from_orders(spark, folder, "year_released", "artist_type", "pop")
    path, by = scratch_folder(spark), ["year_released", "artist_type"]
    add_batch(songs.where("year_released < 1998"), by, path, "early", "pop")
    add_batch(songs.where("year_released >= 1998"), by, path, "late", "pop")
    return merged_counts(spark, path, *by).join(merged_totals(spark, path, *by), by)


def genre_tree_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The document of `genre_tree` in lines; they are written as text files too."""
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, "genre")
    write_tree(hierarchy(songs, part_rules.PART_RULES, part_rules.PART_LISTS, part_rules.PART_DEFAULTS), path)
    return tree_lines(spark, f"{path}/rows")


def stacked_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All order lines of each line number, stacked uncut in the order of their orders."""
    quantity = F.col("l_quantity").cast("bigint").alias("quantity")
    lines = read_table(spark, folder, "lineitem").select("l_linenumber", "l_orderkey", quantity)
    path = scratch_folder(spark)
    write_positions(lines, ["l_linenumber", "l_orderkey", "quantity"], path)
    return stack_positions(spark, path, "l_linenumber", "quantity")


def six_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Six share questions from one reading of the songs."""
    columns = {name for period, entity in QUESTIONS.values() for name in [period, *entity]}
    path = scratch_folder(spark)
    sets = [[period, *entity] for period, entity in QUESTIONS.values()]
    write_question_sums(songs_from_orders(spark, folder, *sorted(columns), "pop"), sets, path)
    found = None
    for question, (period, entity) in QUESTIONS.items():
        sums = question_sums(spark, path, period, *entity)
        shares = ranked_share(sums, period, entity, 3, measure="total_popularity")
        own = shares.select(
            F.lit(question).alias("question"), F.col(period).alias("period"), F.col(entity[0]).alias("entity"),
            "total_popularity", "prop", "rn",
        )
        found = own if found is None else found.union(own)
    return found


def csv_mixed_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Songs from files of two layouts: other columns order, and no loudness before 1998."""
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, *(name for _, name, _ in fixed.CHART_COLUMNS))
    layouts = [fixed.CHART_COLUMNS, [c for c in reversed(fixed.CHART_COLUMNS) if c[1] != "db"]]
    for name, columns, rows in zip("ab", layouts, ("year_released >= 1998", "year_released < 1998"), strict=True):
        write_csv(songs.where(rows).select(*[F.col(column).alias(header) for header, column, _ in columns]), f"{path}/{name}")
    return read_mixed_csv(spark, [f"{path}/a", f"{path}/b"])


def queries() -> dict[str, Query]:
    names = [
        table_page_far, table_positions, table_search_indexed, document_search_indexed, parts_by_rule_table,
        documents_by_item_rules, artists_in_span, artists_in_any_year, artists_kept_up, title_words_in_order,
        genre_table_in_order, songs_kept_up, genre_tree_lines, stacked_lines, six_shares, csv_mixed_scan,
    ]
    return {query.__name__: query for query in names}

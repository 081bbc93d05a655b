"""Every operator and question, bound to the test tables by name. The SQL twins are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import fixed_values as fixed
from rankloom.functions import first_match, shorten, sub_group, wrap_words
from rankloom.operators import (
    apply_corrections,
    binned_feature_points,
    clean,
    column_ranges,
    counts,
    distinct_entities,
    distinct_rows,
    feature_points,
    hierarchy,
    hierarchy_lines,
    hierarchy_nodes,
    histogram,
    page,
    search,
    sort_table,
    stack_segments,
    top_k_per_period,
    top_k_with_ties,
    totals,
    word_counts,
)
from rankloom.plans import part_rules, stored, views
from rankloom.sources import (
    read_chart_csv,
    read_table,
    scratch_folder,
    songs_from_orders,
    write_csv,
    write_json,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]


def _on_songs(view: Callable[..., DataFrame], columns: str, *args, **options) -> Query:
    """A question over the songs columns it needs; other columns are never read."""
    return lambda spark, folder: view(songs_from_orders(spark, folder, *columns.split()), *args, **options)


def _on_table(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: build(read_table(spark, folder, table))


def _word_table(table: str, column: str, cut: str | None) -> Query:
    stop_words = [*fixed.ENGLISH_STOP_WORDS, *fixed.TITLE_STOP_WORDS]
    return _on_table(table, lambda df: word_counts(df, column, stop_words, cut=cut))


# ---- cleaning and files ----


def _incomplete_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Songs with some values missing: artists of one type and genres of one name."""
    songs = songs_from_orders(
        spark, folder, "title", "artist", "genre", "year_released", "chart_year", "artist_type", "pop"
    )
    return songs.withColumn("artist_type", F.nullif("artist_type", F.lit("AFRICA"))).withColumn(
        "genre", F.nullif("genre", F.lit("hot gear"))
    )


def clean_songs(spark: SparkSession, folder: str) -> DataFrame:
    return clean(_incomplete_songs(spark, folder), part_rules.TITLE_FIXES, dropped_years=[1998])


def corrected_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections that are themselves a table: one year per title that has a part of the largest size.

    Titles without a year in that table keep their own.
    """
    fixes = (
        read_table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("title"))
        .agg((F.min("p_size") + 2000).cast("int").alias("year_released"), F.max("p_size").alias("largest"))
        .where("largest = 50")
        .drop("largest")
    )
    songs = songs_from_orders(spark, folder, "title", "year_released", "pop")
    return totals(apply_corrections(songs, fixes), "title", "year_released")


def csv_of_songs(spark: SparkSession, folder: str) -> str:
    """The songs as a CSV file with the headers of a chart file; missing text as NA, missing numbers blank."""
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, *(name for _, name, _ in fixed.CHART_COLUMNS))
    headed = [
        F.coalesce(F.nullif(F.col(name), F.lit("EUROPE")), F.lit("NA")).alias(header)
        if name == "artist_type"
        else (F.nullif(F.col(name), F.lit(1997)) if name == "year_released" else F.col(name)).alias(header)
        for header, name, _ in fixed.CHART_COLUMNS
    ]
    write_csv(songs.select(*headed), path)
    return path


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    return clean(read_chart_csv(spark, csv_of_songs(spark, folder)))


def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """The genre table as exported, read back with declared types."""
    path = scratch_folder(spark)
    write_csv(_genre_table(spark, folder), path)
    columns = [(name, name, "string") for name in ("genre_group", "sub_group", "genre")]
    return read_chart_csv(spark, path, [*columns, ("count", "count", "bigint")])


def table_export(spark: SparkSession, folder: str) -> DataFrame:
    """A result table kept as Parquet by year, read back whole."""
    path = scratch_folder(spark)
    songs = songs_from_orders(spark, folder, "chart_year", "artist", "artist_type", "pop")
    write_table(totals(songs, "chart_year", "artist_type", "artist"), path, partition_by=["chart_year"])
    return spark.read.parquet(path)


def json_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    write_json(genre_tree(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "json")


# ---- classification and hierarchy ----


def _classified(df: DataFrame) -> DataFrame:
    genre = F.col("genre")
    labelled = df.withColumn("genre_group", first_match(genre, part_rules.PART_RULES, "Other")).withColumn(
        "short_group", first_match(genre, part_rules.PART_RULES_SHORT, "Other")
    )
    return labelled.withColumn(
        "sub_group",
        sub_group(F.col("genre_group"), genre, part_rules.PART_LISTS, part_rules.PART_DEFAULTS),
    )


def _genre_table(spark: SparkSession, folder: str) -> DataFrame:
    songs = songs_from_orders(spark, folder, "genre")
    return hierarchy(songs, part_rules.PART_RULES, part_rules.PART_LISTS, part_rules.PART_DEFAULTS)


def genre_tree(spark: SparkSession, folder: str) -> DataFrame:
    return views.genre_tree(
        songs_from_orders(spark, folder, "genre"),
        part_rules.PART_RULES,
        part_rules.PART_LISTS,
        part_rules.PART_DEFAULTS,
    )


def documents_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The ten-label rules over whole texts."""
    text = read_table(spark, folder, "documents").select(
        "lang", first_match(F.col("text"), fixed.GROUP_RULES_10, fixed.DEFAULT_GROUP).alias("genre_group")
    )
    return counts(text, "lang", "genre_group")


def chart_genres(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that carry the genre names of the fixed lists, and those of the groups, in turn."""
    names = F.array(*[F.lit(name) for name in part_rules.fixed_genres()])
    place = (F.col("p_partkey") % F.size(names) + 1).cast("int")
    return read_table(spark, folder, "part").select(F.element_at(names, place).alias("genre"))


def largest_parts(parts: DataFrame) -> DataFrame:
    """More parts than asked for: the largest size is shared. Parts of one size have none."""
    sized = parts.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("pop"))
    return top_k_with_ties(sized, ["p_partkey"], 5)


# ---- features ----


def _feature_widths() -> dict[str, int]:
    return {name: width for name, width, _, _ in fixed.FEATURES}


FEATURE_COLUMNS = "bpm nrgy dnce db spch acous val dur"


def stacked_shares(spark: SparkSession, folder: str) -> DataFrame:
    songs = songs_from_orders(spark, folder, "year_released", "genre", "pop")
    ranked = top_k_per_period(songs, "year_released", ["genre"], 5, measure="pop")
    return stack_segments(ranked, "year_released", "total_popularity", ["genre"]).select(
        "year_released", "genre", "total_popularity", "seg_start", "seg_mid"
    )


def _labels(df: DataFrame) -> DataFrame:
    words = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    return df.select(
        "p_partkey",
        shorten(words, 15).alias("label_15"),
        shorten(words, 13).alias("label_13"),
        wrap_words(words, 15).alias("wrapped"),
    )


SHARES = {
    # name: (view, columns, options)
    "songs_by_release_year": (
        views.popular_songs, "year_released title artist pop", {"n": 3, "frame": "Release Years"}
    ),
    "songs_by_chart_year": (views.popular_songs, "chart_year title artist pop", {"n": 3, "frame": "Each year"}),
    "genres_by_release_year": (
        views.popular_genres, "year_released genre pop", {"n": 3, "frame": "Release Years"}
    ),
    "genres_by_release_and_chart_year": (
        views.popular_genres, "year_released chart_year genre pop", {"n": 3, "frame": "Release Years + Top Years"}
    ),
    "genres_by_chart_year": (views.popular_genres, "chart_year genre pop", {"n": 3, "frame": "Each year"}),
    "genres_by_chart_and_release_year": (
        views.popular_genres, "year_released chart_year genre pop", {"n": 3, "frame": "Each year + Release year"}
    ),
    "genre_groups_by_release_year": (
        views.popular_genre_groups,
        "year_released genre pop",
        {"n": 4, "frame": "Release Years", "rules": part_rules.PART_RULES},
    ),
    "genre_groups_by_chart_year": (
        views.popular_genre_groups,
        "chart_year genre pop",
        {"n": 4, "frame": "Each Year", "rules": part_rules.PART_RULES},
    ),
    "artists_by_release_year": (
        views.popular_artists, "year_released artist pop", {"n": 5, "frame": "Release Years"}
    ),
    "artists_by_chart_year": (views.popular_artists, "chart_year artist pop", {"n": 5, "frame": "Each year"}),
    "artists_of_type_by_release_year": (
        views.popular_artists_of_type,
        "year_released artist artist_type pop",
        {"artist_type": "ASIA", "n": 3, "frame": "Release Years"},
    ),
    "artists_of_type_by_chart_year": (
        views.popular_artists_of_type,
        "chart_year artist artist_type pop",
        {"artist_type": "ASIA", "n": 3, "frame": "Each Year"},
    ),
}

GROUP_SHARES = {
    "genres_in_group_by_release_year": ("year_released genre pop", "Release Years"),
    "genres_in_group_by_chart_year": ("chart_year genre pop", "Each Year"),
}

TOPS = {
    "songs": (views.popular_songs, "title artist artist_type year_released pop", {"n": 10}),
    "genres": (views.popular_genres, "genre pop", {"n": 5}),
    "genre_groups": (views.popular_genre_groups, "genre pop", {"n": 3, "rules": part_rules.PART_RULES}),
    "artists": (views.popular_artists, "artist pop", {"n": 5}),
    "artists_of_type": (
        views.popular_artists_of_type, "artist artist_type pop", {"artist_type": "EUROPE", "n": 3}
    ),
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        # cleaning
        "clean_songs": clean_songs,
        "corrected_by_table": corrected_by_table,
        "distinct_songs": _on_songs(
            lambda s: distinct_rows(s, "chart_year"), "title artist artist_type year_released chart_year pop"
        ),
        "distinct_song_scores": _on_songs(distinct_rows, "year_released title artist pop"),
        "distinct_type_artists": _on_songs(distinct_rows, "artist_type artist"),
        "distinct_year_type_artists": _on_songs(distinct_rows, "year_released artist_type artist"),
        # files and result tables
        "csv_scan": csv_scan,
        "csv_export": csv_export,
        "table_export": table_export,
        "json_export": json_export,
        "table_search": _on_table(
            "part", lambda df: search(df.select("p_partkey", "p_name", "p_brand", "p_type"), "RING brand#1 eco")
        ),
        "table_sort": _on_table(
            "customer", lambda df: sort_table(df.select("c_custkey", "c_mktsegment"), "c_mktsegment", "-c_custkey")
        ),
        "table_page": _on_table(
            "customer",
            lambda df: page(df.select("c_custkey", "c_name", "c_mktsegment"), ["c_mktsegment", "-c_custkey"], 10, 3),
        ),
        "table_page_after": _on_table(
            "customer",
            lambda df: page(
                df.select("c_custkey", "c_name", "c_mktsegment"),
                ["c_mktsegment", "-c_custkey"],
                10,
                after={"c_mktsegment": "BUILDING", "c_custkey": 100},
            ),
        ),
        "year_table": _on_songs(views.year_table, "year_released", ["-count", "year_released"]),
        "title_word_table": _on_songs(views.word_table, "title", "R"),
        "genre_groupings": _on_songs(
            views.genre_groupings,
            "genre",
            "o",
            ["-count", "genre"],
            2,
            part_rules.PART_RULES,
            part_rules.PART_LISTS,
            part_rules.PART_DEFAULTS,
        ),
        # classification and hierarchy
        "classified_parts": _on_table(
            "part", lambda df: _classified(df.select("p_partkey", F.col("p_name").alias("genre")))
        ),
        "documents_by_group": documents_by_group,
        "genre_table": _genre_table,
        "distinct_genre_rows": lambda spark, folder: distinct_rows(_genre_table(spark, folder), "count"),
        "genre_table_page": _on_songs(
            views.genre_groupings,
            "genre",
            number=2,
            rules=part_rules.PART_RULES,
            lists=part_rules.PART_LISTS,
            defaults=part_rules.PART_DEFAULTS,
        ),
        "genre_lines": lambda spark, folder: hierarchy_lines(_genre_table(spark, folder)),
        "chart_genre_table": lambda spark, folder: views.genre_table(chart_genres(spark, folder)),
        "chart_genre_groups": lambda spark, folder: views.songs_per_genre_in_group(
            chart_genres(spark, folder), fixed.GROUP_RULES_9
        ),
        "largest_parts_with_ties": _on_table("part", largest_parts),
        "genre_nodes": lambda spark, folder: hierarchy_nodes(_genre_table(spark, folder)),
        "genre_tree": genre_tree,
        # counts and totals
        "songs_per_release_year": _on_songs(views.songs_per_release_year, "year_released"),
        "songs_per_genre_in_group": _on_songs(
            views.songs_per_genre_in_group, "genre", part_rules.PART_RULES
        ),
        "songs_per_year_and_group": _on_songs(
            views.songs_per_year_and_group, "year_released genre", part_rules.PART_RULES
        ),
        "unique_artists_by_type": _on_songs(views.unique_artists_by_type, "artist_type artist"),
        "unique_artists_by_type_and_year": _on_songs(
            views.unique_artists_by_type_and_year, "year_released artist_type artist"
        ),
        "songs_by_type": _on_songs(views.songs_by_type, "artist_type"),
        "songs_by_type_and_year": _on_songs(views.songs_by_type_and_year, "year_released artist_type"),
        "popularity_by_type": _on_songs(views.artist_type_popularity, "artist_type pop"),
        "popularity_by_type_and_release_year": _on_songs(
            views.artist_type_popularity, "year_released artist_type pop", "Release Years"
        ),
        "popularity_by_type_and_chart_year": _on_songs(
            views.artist_type_popularity, "chart_year artist_type pop", "Each Year"
        ),
        "popularity_per_release_year": _on_songs(
            lambda s: totals(s, "year_released", name="yearly_total_popularity"), "year_released pop"
        ),
        "column_ranges": _on_songs(
            lambda s: column_ranges(s, ["year_released", "chart_year", "pop"]), "year_released chart_year pop"
        ),
        "events_by_type_and_day": _on_table(
            "events", lambda df: counts(df.withColumn("day", F.to_date("ts")), "day", "event_type")
        ),
        "event_users_by_type_and_day": _on_table(
            "events",
            lambda df: distinct_entities(
                df.withColumn("day", F.to_date("ts")), "day", "event_type", entity="user_id"
            ),
        ),
        # top lists without a direction
        "top_genres_in_group_with_ties": _on_songs(
            views.popular_genres_in_group, "genre pop", "Colour", 3, rules=part_rules.PART_RULES
        ),
        "top_artists_by_song_count": _on_songs(views.artists_by_song_count, "artist", 3),
        "top_artists_by_songs_released": _on_songs(
            views.artists_by_song_count, "year_released artist", 3, "Release Years"
        ),
        "top_artists_by_songs_charted": _on_songs(views.artists_by_song_count, "chart_year artist", 3, "Each year"),
        "stacked_shares": stacked_shares,
        "part_labels": _on_table("part", _labels),
        # words
        "title_words": _on_songs(views.title_words, "title"),
        "document_words": _word_table("documents", "text", None),
        "document_words_cut": _word_table("documents", "text", fixed.TITLE_CUT),
        "conversation_words": _word_table("conversations", "text", None),
        "word_search_page": lambda spark, folder: page(
            search(_word_table("documents", "text", None)(spark, folder), "th", ["word"]), ["-freq", "word"], 10, 2
        ),
        # features
        "feature_histograms": _on_songs(views.feature_histograms, FEATURE_COLUMNS),
        "feature_histograms_plain": _on_songs(
            lambda s: histogram(s, _feature_widths(), empty_bins=False, include_lowest=False), FEATURE_COLUMNS
        ),
        "price_histogram": lambda spark, folder: histogram(
            read_table(spark, folder, "orders").select("o_totalprice"), {"o_totalprice": 500}
        ),
        "feature_points": _on_songs(
            lambda s: feature_points(s, [], FEATURE_COLUMNS.split()), f"{FEATURE_COLUMNS} pop"
        ),
        "feature_points_shown": _on_songs(
            views.features_versus_popularity, "bpm db pop", ["bpm", "db"]
        ),
        "feature_points_binned": _on_songs(
            lambda s: binned_feature_points(s, _feature_widths()), f"{FEATURE_COLUMNS} pop"
        ),
    }
    for direction in ("top", "bottom"):
        for name, (view, columns, options) in TOPS.items():
            found[f"{direction}_{name}"] = _on_songs(view, columns, direction=direction, **options)
        for name, (view, columns, options) in SHARES.items():
            found[f"share_{direction}_{name}"] = _on_songs(view, columns, direction=direction, **options)
    for name, (columns, frame) in GROUP_SHARES.items():
        found[f"share_top_{name}"] = _on_songs(
            views.popular_genres_in_group, columns, "Colour", 3, frame, rules=part_rules.PART_RULES
        )
    return found | stored.queries()

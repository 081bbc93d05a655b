"""The parameterised questions. Each takes a clean songs table and returns its answer as a DataFrame.

A songs table has one row per song and chart year: title, artist, genre, year_released, chart_year,
artist_type, pop and the features. A song that charted in two years counts twice everywhere, except in
`popular_songs` over all time and by release year, which count it once.

`frame` and `direction` take the names shown to users, in any case: "All Time", "Release Years",
"Each year", "Release Years + Top Years", "Each year + Release year"; "Top", "Bottom".
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import fixed_values as fixed
from rankloom.functions import caption, first_match, shorten, wrap_words
from rankloom.operators import (
    counts,
    distinct_entities,
    feature_points,
    hierarchy,
    hierarchy_json,
    histogram,
    page,
    ranked_share,
    search,
    top_k,
    top_k_per_period,
    top_k_rows,
    top_k_with_ties,
    totals,
    word_counts,
)

Rules = list[tuple[str, str]]


def _frame(frame: str, *allowed: str) -> str:
    name = fixed.FRAMES.get(frame.lower())
    if name not in allowed:
        raise ValueError(f"time frame {frame!r} is not one of: {', '.join(allowed)}")
    return name


def _told(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("text", caption(fixed.CAPTIONS[key]))


def _labelled(df: DataFrame, name: str, width: int, key: str | None = None) -> DataFrame:
    df = df.withColumn("label", shorten(F.col(name), width))
    return df if key is None else _told(df, key)


# ---- songs ----


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """A list of the few artist types in the order shown, with each one's `position`."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy("position")


def songs_per_release_year(songs: DataFrame) -> DataFrame:
    return _told(counts(songs, "year_released"), "year_count")


def popular_songs(songs: DataFrame, n: int = 3, frame: str = "All Time", direction: str = "Top") -> DataFrame:
    """All time: distinct songs by score, ties by title, artist and year. By period: shares of the period."""
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    if frame == "all_time":
        chosen = top_k_rows(
            songs.drop("chart_year"), n, ties=["title", "artist", "year_released"], direction=direction
        )
        return _told(chosen.withColumn("unique_title", F.concat_ws(" ", "title", F.lit("by"), "artist")), "song")
    if frame == "release_years":
        ranked = ranked_share(
            songs, "year_released", ["title", "artist"], n, direction=direction, repeats=False
        )
        return _labelled(ranked, "title", 15, "song_release_year")
    ranked = ranked_share(songs, "chart_year", ["title", "artist"], n, direction=direction)
    return _labelled(ranked, "title", 15, "song_chart_year")


def year_table(songs: DataFrame, order: Sequence[str] = ("year_released",), number: int = 1) -> DataFrame:
    """One page of the songs-per-year table."""
    return page(counts(songs, "year_released"), order, fixed.PAGE_LENGTHS["years"], number)


def word_table(
    songs: DataFrame, text: str = "", order: Sequence[str] = ("-freq", "word"), number: int = 1
) -> DataFrame:
    """One page of the title words, most frequent first, that match the search text."""
    return page(search(_title_words(songs), text), order, fixed.PAGE_LENGTHS["words"], number)


def _chosen(features: Iterable[str] | None) -> list[tuple[str, int, str, str]]:
    by_name = {feature[0]: feature for feature in fixed.FEATURES}
    return [by_name[name] for name in (by_name if features is None else features)]


def feature_histograms(songs: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Song counts per bin of the chosen features, with their fixed bin widths."""
    return histogram(songs, {name: width for name, width, _, _ in _chosen(features)})


def features_versus_popularity(songs: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    chosen = _chosen(features)
    points = feature_points(songs, [], [name for name, _, _, _ in chosen])
    text = F
    for name, _, of_value, of_pop in chosen:
        text = text.when(
            F.col("feature") == name, F.concat_ws(" ", F.lit(of_value), "value", F.lit(of_pop), "pop")
        )
    return points.withColumn("text", text.otherwise(F.lit("")))


def _title_words(songs: DataFrame) -> DataFrame:
    return word_counts(
        songs, "title", [*fixed.ENGLISH_STOP_WORDS, *fixed.TITLE_STOP_WORDS], cut=fixed.TITLE_CUT
    )


def title_words(songs: DataFrame) -> DataFrame:
    """Words of all titles, up to the first "feat" or "with", most frequent first."""
    return _title_words(songs).orderBy(F.desc("freq"), "word")


def songs_per_genre_in_group(songs: DataFrame, rules: Rules = fixed.GROUP_RULES_10) -> DataFrame:
    """Songs per genre, with the genre's group."""
    return _with_group(counts(songs, "genre"), rules)


# ---- genres ----


def genre_table(
    songs: DataFrame,
    rules: Rules = fixed.GROUP_RULES_10,
    lists: dict = fixed.SUB_GROUPS,
    defaults: dict = fixed.SUB_GROUP_DEFAULTS,
) -> DataFrame:
    table = hierarchy(songs, rules, lists, defaults, fixed.DEFAULT_GROUP)
    return table.orderBy("genre_group", "sub_group", "genre")


def genre_tree(
    songs: DataFrame,
    rules: Rules = fixed.GROUP_RULES_10,
    lists: dict = fixed.SUB_GROUPS,
    defaults: dict = fixed.SUB_GROUP_DEFAULTS,
) -> DataFrame:
    return hierarchy_json(hierarchy(songs, rules, lists, defaults, fixed.DEFAULT_GROUP))


def genre_groupings(
    songs: DataFrame,
    text: str = "",
    order: Sequence[str] = ("genre_group", "sub_group", "genre"),
    number: int = 1,
    rules: Rules = fixed.GROUP_RULES_10,
    lists: dict = fixed.SUB_GROUPS,
    defaults: dict = fixed.SUB_GROUP_DEFAULTS,
) -> DataFrame:
    """One page of the genre table, searched and sorted."""
    table = hierarchy(songs, rules, lists, defaults, fixed.DEFAULT_GROUP)
    return page(search(table, text), order, fixed.PAGE_LENGTHS["genres"], number)


def _with_group(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("genre_group", first_match(F.col("genre"), rules, fixed.DEFAULT_GROUP))


def _genre_totals(songs: DataFrame, rules: Rules, *periods: str) -> DataFrame:
    """Score per period and genre with the genre's group: rules then run once per genre, not once per song."""
    return _with_group(totals(songs, *periods, "genre", name="pop"), rules)


def songs_per_year_and_group(songs: DataFrame, rules: Rules = fixed.GROUP_RULES_10) -> DataFrame:
    per_genre = _with_group(counts(songs, "year_released", "genre"), rules)
    per_group = totals(per_genre, "year_released", "genre_group", measure="count", name="count")
    return _told(per_group, "genre_group_count").orderBy("year_released", "genre_group")


def popular_genres(songs: DataFrame, n: int = 5, frame: str = "All Time", direction: str = "Top") -> DataFrame:
    frame = _frame(frame, *fixed.FRAMES.values())
    if frame == "all_time":
        return _told(top_k(songs, ["genre"], n, direction=direction), "genre")
    period, entity, key = {
        "release_years": ("year_released", ["genre"], "genre_release_year"),
        "release_years_by_chart_year": (
            "year_released", ["genre", "chart_year"], "genre_release_year_by_chart_year"
        ),
        "chart_years": ("chart_year", ["genre"], "genre_chart_year"),
        "chart_years_by_release_year": (
            "chart_year", ["genre", "year_released"], "genre_chart_year_by_release_year"
        ),
    }[frame]
    return _labelled(ranked_share(songs, period, entity, n, direction=direction), "genre", 15, key)


def popular_genre_groups(
    songs: DataFrame, n: int = 3, frame: str = "All Time", direction: str = "Top", rules: Rules = fixed.GROUP_RULES_9
) -> DataFrame:
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    if frame == "all_time":
        return _told(top_k(_genre_totals(songs, rules), ["genre_group"], n, direction=direction), "genre_group")
    period = "year_released" if frame == "release_years" else "chart_year"
    ranked = ranked_share(_genre_totals(songs, rules, period), period, ["genre_group"], n, direction=direction)
    return _labelled(
        ranked, "genre_group", 13,
        "genre_group_release_year" if frame == "release_years" else "genre_group_chart_year",
    )


def popular_genres_in_group(
    songs: DataFrame, group: str, n: int = 3, frame: str = "All Time", rules: Rules = fixed.GROUP_RULES_9
) -> DataFrame:
    """Top genres of one group. All time keeps every genre tied with the N-th; a period cuts to exactly N."""
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    inside = F.col("genre_group") == group
    if frame == "all_time":
        top = top_k_with_ties(_genre_totals(songs, rules).where(inside), ["genre"], n)
        top = top.withColumn("label", wrap_words(F.col("genre"), 15)).orderBy(F.desc("total_popularity"), "genre")
        return _told(top, "genre_in_group")
    period = "year_released" if frame == "release_years" else "chart_year"
    ranked = ranked_share(_genre_totals(songs, rules, period).where(inside), period, ["genre"], n)
    return _labelled(
        ranked, "genre", 13,
        "genre_in_group_release_year" if frame == "release_years" else "genre_in_group_chart_year",
    )


# ---- artists ----


def unique_artists_by_type(songs: DataFrame) -> DataFrame:
    return _placed(distinct_entities(songs, "artist_type"), F.desc("count"), F.col("artist_type"))


def unique_artists_by_type_and_year(songs: DataFrame) -> DataFrame:
    """Different artists per release year and type. For songs see `songs_by_type_and_year`."""
    return _told(distinct_entities(songs, "year_released", "artist_type"), "type_artists_year")


def songs_by_type(songs: DataFrame) -> DataFrame:
    return _placed(_told(counts(songs, "artist_type"), "type_songs"), F.desc("count"), F.col("artist_type"))


def songs_by_type_and_year(songs: DataFrame) -> DataFrame:
    return _told(counts(songs, "year_released", "artist_type"), "type_songs_year")


def artists_by_song_count(songs: DataFrame, n: int = 3, frame: str = "All Time") -> DataFrame:
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    if frame == "all_time":
        return _told(top_k(songs, ["artist"], n, measure=None), "artist_count")
    period = "year_released" if frame == "release_years" else "chart_year"
    return _labelled(top_k_per_period(songs, period, ["artist"], n), "artist", 15)


def popular_artists(songs: DataFrame, n: int = 5, frame: str = "All Time", direction: str = "Top") -> DataFrame:
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    if frame == "all_time":
        return _told(top_k(songs, ["artist"], n, direction=direction), "artist")
    period = "year_released" if frame == "release_years" else "chart_year"
    ranked = ranked_share(songs, period, ["artist"], n, direction=direction)
    return _labelled(
        ranked, "artist", 15, "artist_release_year" if frame == "release_years" else "artist_chart_year"
    )


def artist_type_popularity(songs: DataFrame, frame: str = "All Time") -> DataFrame:
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    if frame == "all_time":
        return _placed(_told(totals(songs, "artist_type"), "type"), F.desc("total_popularity"), F.col("artist_type"))
    period = "year_released" if frame == "release_years" else "chart_year"
    key = "type_release_year" if frame == "release_years" else "type_chart_year"
    return _told(totals(songs, period, "artist_type"), key).orderBy(period, "artist_type")


def popular_artists_of_type(
    songs: DataFrame, artist_type: str, n: int = 3, frame: str = "All Time", direction: str = "Top"
) -> DataFrame:
    """Shares are of the type's total in the period, not of the whole table's."""
    frame = _frame(frame, "all_time", "release_years", "chart_years")
    inside = songs.where(F.col("artist_type") == artist_type)
    if frame == "all_time":
        return _told(top_k(inside, ["artist"], n, direction=direction), "artist")
    period = "year_released" if frame == "release_years" else "chart_year"
    return _labelled(ranked_share(inside, period, ["artist"], n, direction=direction), "artist", 15)


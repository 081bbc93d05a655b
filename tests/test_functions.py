from __future__ import annotations

import textwrap

import pytest
from pyspark.sql import functions as F

from rankloom import fixed_values as fixed
from rankloom.functions import caption, cut_at, first_match, shorten, sub_group, tokens, wrap_words
from rankloom.operators import word_counts


def values(spark, column, texts):
    df = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, x string")
    return [row.y for row in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("width", [13, 15])
def test_shorten_only_beyond_the_width(spark, width):
    exact, longer = "x" * width, "é" * (width + 1)
    assert values(spark, lambda c: shorten(c, width), [exact, longer, "", None]) == [
        exact, "é" * (width - 3) + "...", "", None,
    ]


def test_wrap_words(spark):
    texts = ["dance pop", "asian american hip hop", "irish singer-songwriter", "a" * 30, "exact fourteen", "", "x  y z"]
    expected = [
        "\n".join(textwrap.wrap(" ".join(t.split()), 14, break_long_words=False, break_on_hyphens=False))
        for t in texts
    ]
    assert values(spark, wrap_words, texts) == expected


def test_caption_joins_by_spaces(spark):
    df = spark.createDataFrame([("Ann", 3)], "artist string, count bigint")
    assert df.select(caption(fixed.CAPTIONS["artist_count"])).first()[0] == "Artist: Ann <br>Number of Songs: 3"


def test_title_cut_has_no_word_boundary(spark):
    texts = ["Defeat the Night", "Without You", "Hey (feat. Bea)", "Gold", "One WITH\nTwo", None]
    assert values(spark, lambda c: cut_at(c, fixed.TITLE_CUT), texts) == ["De", "", "Hey (", "Gold", "One ", None]


def test_tokens(spark):
    assert values(spark, tokens, ["Don't  Stop 99 Hip-Hop", "it’s\ttime"]) == [
        ["dont", "", "stop", "", "hiphop"], ["it’s", "time"],
    ]


def test_words_count_repeats_and_stop_words(spark):
    df = spark.createDataFrame([("The night and the Night radio edit",), ("Night",), (None,)], "title string")
    found = word_counts(df, stop_words=["the", "and", *fixed.TITLE_STOP_WORDS])
    assert [tuple(row) for row in found.collect()] == [("night", 3)]


def test_stop_words_inside_signs_go_too(spark):
    texts = ["It’s The–Night", "you’re élan", "they", "theéatre"]
    df = spark.createDataFrame([(text,) for text in texts], "title string")
    found = {row.word: row.freq for row in word_counts(df, stop_words=fixed.ENGLISH_STOP_WORDS).collect()}
    assert found == {"–night": 1, "’re": 1, "élan": 1, "theéatre": 1}


def groups(spark, genres, rules):
    return dict(zip(genres, values(spark, lambda c: first_match(c, rules, "Other"), genres)))


def test_first_rule_wins(spark):
    genres = ["dance pop", "pop rap", "Folk-POP", "trap music", "UK HIP HOP", "glam metal", "r&b", "reggaeton",
              "soul jazz", "vocal jazz", "zydeco", None]
    ten = groups(spark, genres, fixed.GROUP_RULES_10)
    assert ten == {
        "dance pop": "Pop", "pop rap": "Pop", "Folk-POP": "Pop", "trap music": "Hip Hop/Rap",
        "UK HIP HOP": "Hip Hop/Rap", "glam metal": "Rock", "r&b": "R&B/Soul", "reggaeton": "Latin",
        "soul jazz": "R&B/Soul", "vocal jazz": "Jazz/Blues", "zydeco": "Other", None: "Other",
    }
    assert groups(spark, ["vocal jazz"], fixed.GROUP_RULES_9) == {"vocal jazz": "Other"}
    assert len(fixed.GROUP_RULES_9) == len(fixed.GROUP_RULES_10) - 1


def test_rules_may_be_regular_expressions(spark):
    rules = [("^pop$", "Only pop"), ("k.pop|j.pop", "Asian"), ("pop", "Pop")]
    assert groups(spark, ["POP", "K-Pop", "Pop rap", "jazz"], rules) == {
        "POP": "Only pop", "K-Pop": "Asian", "Pop rap": "Pop", "jazz": "Other",
    }


def test_every_listed_genre_resolves(spark):
    """Each listed genre gets its first list's label, or is dead because its group is another one."""
    rows = [(group, genre, label) for group, lists in fixed.SUB_GROUPS.items() for label, names in lists
            for genre in names]
    df = spark.createDataFrame(rows, "listed_group string, genre string, label string")
    real = first_match(F.col("genre"), fixed.GROUP_RULES_10, fixed.DEFAULT_GROUP)
    df = df.withColumn("genre_group", real).withColumn(
        "sub_group", sub_group(F.col("genre_group"), F.col("genre"), fixed.SUB_GROUPS, fixed.SUB_GROUP_DEFAULTS)
    )
    odd = {(r.listed_group, r.genre, r.label, r.genre_group, r.sub_group)
           for r in df.where("sub_group <> label or genre_group <> listed_group").collect()}
    assert odd == {
        ("Pop", "boy band", "Teen Pop", "Other", "boy band"),
        ("Other", "indietronica", "Electronic", "Other", "Indie/Alternative"),
    }


def test_sub_group_defaults(spark):
    def of(group, genre):
        df = spark.createDataFrame([(group, genre)], "g string, x string")
        column = sub_group(F.col("g"), F.col("x"), fixed.SUB_GROUPS, fixed.SUB_GROUP_DEFAULTS)
        return df.select(column).first()[0]

    assert of("Pop", "k-pop") == "Other Pop"
    assert of("Hip Hop/Rap", "memphis rap") == "Other Hip Hop"
    assert of("Other", "zydeco") == "zydeco"
    assert of("Rock", "glam metal") == "Rock"


def test_fixed_tables_have_the_right_sizes():
    assert len(fixed.CORRECTIONS) == 9
    assert len(fixed.FEATURES) == 8
    assert {name: width for name, width, _, _ in fixed.FEATURES if width == 1} == {"db": 1, "spch": 1}
    assert len(fixed.ENGLISH_STOP_WORDS) == len(set(fixed.ENGLISH_STOP_WORDS))

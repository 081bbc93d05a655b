"""What must hold for any input: whole totals, order-free answers, skewed keys, brute-force agreement."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest

from rankloom.operators import (
    counts,
    distinct_entities,
    hierarchy,
    hierarchy_json,
    hierarchy_lines,
    hierarchy_nodes,
    histogram,
    ranked_share,
    stack_segments,
    top_k,
    top_k_per_period,
    top_k_rows,
    top_k_with_ties,
    word_counts,
)
from rankloom.plans import part_rules

SCHEMA = "title string, artist string, genre string, year_released int, chart_year int, artist_type string, pop int"


def _rows(count=3000, seed=7):
    """Songs of which a third are one song of one artist in one year, with few scores, so ties are common."""
    draw = random.Random(seed)
    genres = ["red ring", "blue rod", "old bolt", "cold gear", "hot rod", "large plate", "new ring", "plain"]
    rows = []
    for _ in range(count):
        if draw.random() < 1 / 3:
            rows.append(("hit", "star", "red ring", 2010, draw.randint(2010, 2012), "Solo", draw.randint(0, 3)))
        else:
            rows.append((
                f"song {draw.randint(1, 40)}", f"artist {draw.randint(1, 30)}", draw.choice(genres),
                draw.randint(2008, 2012), draw.randint(2010, 2019), draw.choice(["Solo", "Duo"]), draw.randint(0, 9),
            ))
    return rows


@pytest.fixture(scope="module")
def data():
    return _rows()


@pytest.fixture(scope="module")
def songs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(6).cache()


def _collected(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.mark.parametrize("direction", ["top", "bottom"])
@pytest.mark.parametrize("n", [1, 3, 1000, 5000])
def test_shares_agree_with_brute_force(songs, data, direction, n):
    totals = defaultdict(int)
    for title, artist, _, year, _, _, pop in data:
        totals[year, title, artist] += pop
    years = defaultdict(list)
    for (year, title, artist), total in totals.items():
        years[year].append((-total if direction == "top" else total, title, artist, total))
    expected = []
    for year, entries in years.items():
        whole = sum(entry[3] for entry in entries)
        for rn, (_, title, artist, total) in enumerate(sorted(entries)[:n], 1):
            expected.append((year, title, artist, total, whole, total / whole, rn))
    found = ranked_share(songs, "year_released", ["title", "artist"], n, direction=direction)
    assert _collected(found) == sorted(expected, key=repr)


def test_all_shares_of_a_period_sum_to_one(songs):
    found = ranked_share(songs, "chart_year", ["artist"], 1000).groupBy("chart_year").sum("prop").collect()
    assert all(abs(row[1] - 1) < 1e-9 for row in found)


def test_order_of_rows_does_not_matter(spark, songs, data):
    shuffled = list(data)
    random.Random(3).shuffle(shuffled)
    other = spark.createDataFrame(shuffled, SCHEMA).repartition(3)
    for build in (
        lambda df: ranked_share(df, "year_released", ["genre"], 3, repeats=False),
        lambda df: top_k(df, ["artist"], 7, direction="bottom"),
        lambda df: top_k_rows(df.drop("chart_year"), 9, ties=["title", "artist"]),
        lambda df: top_k_per_period(df, "chart_year", ["artist"], 2),
        lambda df: top_k_with_ties(df, ["title"], 4),
    ):
        assert _collected(build(songs)) == _collected(build(other))


@pytest.mark.parametrize("direction", ["top", "bottom"])
@pytest.mark.parametrize("n", [1, 5, 12, 100_000])
def test_top_rows_agree_with_brute_force(songs, data, direction, n):
    distinct = {(t, a, g, y, k, p) for t, a, g, y, _, k, p in data}
    sign = -1 if direction == "top" else 1
    expected = sorted(distinct, key=lambda r: (sign * r[5], r[0], r[1], r[3], r[2], r[4]))[:n]
    found = top_k_rows(songs.drop("chart_year"), n, ties=["title", "artist", "year_released"], direction=direction)
    assert [tuple(row)[:6] for row in found.orderBy("position").collect()] == expected


def test_top_rows_with_null_scores_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 2), ("c", 2)], "title string, pop int")
    for direction, expected in (("top", ["c", "b", "a"]), ("bottom", ["b", "c", "a"])):
        found = top_k_rows(df, 3, ties=["title"], direction=direction).orderBy("position").collect()
        assert [row.title for row in found] == expected


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_ties_are_kept_whole(songs, data, n):
    totals = Counter()
    for _, artist, _, _, _, _, _ in data:
        totals[artist] += 0
    for row in data:
        totals[row[1]] += row[6]
    nth = sorted(totals.values(), reverse=True)[min(n, len(totals)) - 1]
    expected = {name: total for name, total in totals.items() if total >= nth}
    assert {r.artist: r.total_popularity for r in top_k_with_ties(songs, ["artist"], n).collect()} == expected


def test_counts_add_up(songs, data):
    assert sum(r["count"] for r in counts(songs, "chart_year", "artist_type").collect()) == len(data)
    unique = {r.artist_type: r["count"] for r in distinct_entities(songs, "artist_type").collect()}
    assert unique == {kind: len({r[1] for r in data if r[5] == kind}) for kind in ("Solo", "Duo")}
    rough = distinct_entities(songs, "artist_type", approximate=True).collect()
    assert all(abs(r["count"] - unique[r.artist_type]) <= 3 for r in rough)


def test_words_add_up(songs, data):
    found = {r.word: r.freq for r in word_counts(songs, "title").collect()}
    assert found == Counter(word for row in data for word in ["".join(c for c in w if not c.isdigit())
                                                              for w in row[0].split()] if len(word) >= 3)


def test_histogram_counts_every_row(songs, data):
    for flags in ((True, True), (False, False)):
        found = histogram(songs, {"pop": 2, "chart_year": 3}, *flags)
        assert {r.feature: r["sum(count)"] for r in found.groupBy("feature").sum("count").collect()} == {
            "pop": len(data), "chart_year": len(data),
        }


def test_parents_are_the_sum_of_their_children(songs, data):
    table = hierarchy(songs, part_rules.PART_RULES, part_rules.PART_LISTS, part_rules.PART_DEFAULTS)
    nodes = hierarchy_nodes(table).collect()
    for level in range(4):
        assert sum(node["size"] for node in nodes if node["level"] == level) == len(data)
    for node in nodes:
        if node["level"] == 1:
            below = [n["size"] for n in nodes if n["level"] == 2 and n["genre_group"] == node["genre_group"]]
            assert sum(below) == node["size"]


def test_a_tree_in_lines_has_every_genre(songs):
    table = hierarchy(songs, part_rules.PART_RULES, part_rules.PART_LISTS, part_rules.PART_DEFAULTS)
    found = [json.loads(row.json) for row in hierarchy_lines(table).collect()]
    assert sorted((*line["path"][1:], line["name"], line["size"]) for line in found) == sorted(map(tuple, table.collect()))


def test_a_tree_may_have_nulls_and_quotes(spark):
    table = spark.createDataFrame(
        [("G", 'q"s', "b", 2), ("G", 'q"s', "a\\", 1), (None, None, None, 3)],
        "genre_group string, sub_group string, genre string, count long",
    )
    assert json.loads(hierarchy_json(table).first().json) == {"name": "Genres", "children": [
        {"children": [{"children": [{"size": 3}]}]},
        {"name": "G", "children": [{"name": 'q"s', "children": [{"name": "a\\", "size": 1}, {"name": "b", "size": 2}]}]},
    ]}


def test_segments_are_stacked_in_order(songs):
    ranked = ranked_share(songs, "year_released", ["genre"], 3)
    found = stack_segments(ranked, "year_released", "total_popularity", ["genre"]).collect()
    for year in {row.year_released for row in found}:
        at = 0
        for row in sorted((r for r in found if r.year_released == year), key=lambda r: r.genre):
            assert (row.seg_start, row.seg_mid) == (at, at + row.total_popularity / 2)
            at += row.total_popularity

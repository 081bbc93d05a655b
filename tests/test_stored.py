"""Tables that are written once and asked often: what they read, how they are cut, and that nothing is lost."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import first_match
from rankloom.operators import (
    add_batch,
    classify_by_rules,
    distinct_in,
    hierarchy_json,
    merged_counts,
    merged_totals,
    page_at,
    question_sums,
    read_positions,
    search,
    search_index,
    sort_table,
    stack_positions,
    stack_segments,
    totals,
    write_bitmaps,
    write_positions,
    write_question_sums,
    write_search_index,
    write_tree,
)
from rankloom.operators.trigrams import runs
from rankloom.plans import part_rules
from rankloom.sources import read_mixed_csv
from tests.test_plans import final_plan


def _rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "stored")


# ---- pages by position ----


def test_a_page_far_away_reads_one_or_two_ranges(spark, path):
    table = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("score"), F.col("id"))
    write_positions(table, ["-score", "id"], path, partitions=16)
    page = page_at(spark, path, 2, 100_000)
    plan = final_plan(page)
    assert "TakeOrderedAndProject" not in plan and re.search(r"PartitionFilters: \[.*_part", plan) and "PushedFilters: [IsNotNull(_place), GreaterThanOrEqual(_place" in plan
    read = spark.read.parquet(f"{path}/rows").where(F.col("_part").isin([int(x) for x in re.findall(r"_part#\d+ (?:=|IN) \(?(\d+)", plan)]))
    assert 0 < read.select("_part").distinct().count() <= 2
    want = sorted(((i * 7919 % 200_003, i) for i in range(200_000)), key=lambda r: (-r[0], r[1]))[199_998:]
    assert [tuple(r) for r in page.collect()] == [(s, i, 199_999 + k) for k, (s, i) in enumerate(want)]


@pytest.mark.parametrize("order", [["a"], ["-a", "b"], ["b", "-a"]])
def test_positions_are_those_of_the_sorted_table(spark, path, order):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None])) for _ in range(150)] + [(2, "x")] * 200
    table = spark.createDataFrame(data, "a int, b string").repartition(5)
    write_positions(table, order, path, partitions=7)
    want = [tuple(r) for r in sort_table(table, *order).collect()]
    found = read_positions(spark, path).orderBy("position").collect()
    assert [tuple(r)[:2] for r in found] == want and [r.position for r in found] == list(range(1, 351))
    pages = [r for k in range(1, 26) for r in page_at(spark, path, 15, k).collect()]
    assert [tuple(r) for r in pages] == [tuple(r) for r in found]
    # a row that fills more than half of the table is cut too
    sizes = [r.n for r in spark.read.parquet(f"{path}/index").collect()]
    assert len(sizes) == 7 and max(sizes) < 150


def test_an_empty_table_has_empty_pages(spark, path):
    write_positions(spark.createDataFrame([], "a int"), ["a"], path)
    assert page_at(spark, path, 10, 1).collect() == read_positions(spark, path).collect() == []
    with pytest.raises(ValueError):
        page_at(spark, path, 10, 0)


# ---- search ----


@pytest.mark.parametrize("text", ["needle", "NEEDLE blue", "ne", "x ne", "", "nowhere", "café", "😀😀a", "needle 7"])
def test_an_index_finds_what_a_search_finds(spark, path, text):
    data = [(k, f"row {k} of plain hay", "blue" if k % 2 else None) for k in range(3000)]
    data += [(3000, "a Needle here", "Blue"), (3001, "two needles, 7", None), (3002, "Café 😀😀a", ""), (3003, None, None), (3004, "ne", "x")]
    table = spark.createDataFrame(data, "id int, name string, hue string").sort("id")
    write_search_index(table, path, block_rows=100)
    found = search_index(spark, path, text)
    assert _rows(found) == _rows(search(table, text)) and found.columns == table.columns
    asked = re.search(r"_block#\d+L? (?:=|IN) \(?([\d, ]+)", final_plan(found))
    blocks = spark.read.parquet(f"{path}/rows").select("_block").distinct().count()
    assert blocks >= 30
    if text in ("needle", "NEEDLE blue", "café", "😀😀a"):
        assert asked and len(asked[1].split(",")) <= 2  # of 30 blocks and more


def test_a_search_of_some_columns(spark, path):
    table = spark.createDataFrame([(1, "abc", "def"), (2, "def", "abc")], "id int, a string, b string")
    write_search_index(table, path, ["a"])
    assert [r.id for r in search_index(spark, path, "ABC", ["a"]).collect()] == [1]


def test_runs_of_letters(spark):
    data = ["", "a", "ab", "abc", "abcabc", "日本語 😀x", None, "x" * 5000]
    got = spark.createDataFrame([(t,) for t in data], "t string").select("t", runs(F.col("t")).alias("r")).collect()
    for r in got:
        assert r.r is None if r.t is None else sorted(r.r) == sorted({r.t[k : k + 3] for k in range(len(r.t) - 2)})


# ---- rules as a table ----

RULES = "priority int, text string, label string"


def _by_hand(value, rules, default):
    fits = [(p, lb) for p, t, lb in rules if None not in (p, t, lb) and value is not None and t.lower() in value.lower()]
    return min(fits)[1] if fits else default


def test_ten_thousand_rules_agree_with_the_chain(spark):
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", F.col("p_name").alias("genre"))
    rng = random.Random(1)
    rules = [(k, t, lb) for k, (pattern, lb) in enumerate(part_rules.PART_RULES) for t in pattern.split("|")]
    rules += [(rng.randrange(10), "q" + "".join(rng.choices("aeilnorst", k=rng.randrange(3, 9))), "never") for _ in range(10_000)]
    got = classify_by_rules(parts, "genre", spark.createDataFrame(rules, RULES), "Other", "group")
    want = parts.withColumn("group", first_match(F.col("genre"), part_rules.PART_RULES, "Other"))
    assert _rows(got) == _rows(want)
    plan = final_plan(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("always", [True, False])
def test_rules_of_any_length_against_brute_force(spark, always):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcß é", k=n))
    values = [None, "", "Ab", *[text(rng.randrange(0, 9)) for _ in range(60)]] * 3
    rules = [(rng.randrange(6), text(rng.randrange(1, 5)).upper(), rng.choice("uvw")) for _ in range(40)]
    rules += [(None, "a", "u"), (1, None, "u"), (1, "a", None), (3, "abcabcabcabc", "v")] + [(4, "", "every")] * always
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").repartition(3)
    got = {r.id: r.label for r in classify_by_rules(df, "v", spark.createDataFrame(rules, RULES), "none").collect()}
    assert got == {k: _by_hand(v, rules, "none") for k, v in enumerate(values)}
    nothing = classify_by_rules(df, "v", spark.createDataFrame([], RULES), "none")
    assert {r.label for r in nothing.collect()} == {"none"} and nothing.count() == len(values)


# ---- bitmaps ----


def test_any_span_of_years_from_stored_bitmaps(spark, path):
    rng = random.Random(2)
    data = [(2000 + rng.randrange(10), rng.choice(["Solo", "Duo"]), rng.choice([None, *map(str, range(300))])) for _ in range(3000)]
    songs = spark.createDataFrame(data, "year int, kind string, artist string")
    write_bitmaps(songs, ["year", "kind"], "artist", path)
    for first, last in ((2000, 2009), (2003, 2003), (2001, 2007), (2050, 2060)):
        own = [r for r in data if first <= r[0] <= last and r[2] is not None]
        found = distinct_in(spark, path, "kind", where=f"year BETWEEN {first} AND {last}")
        assert _rows(found) == sorted((k, len({r[2] for r in own if r[1] == k})) for k in {r[1] for r in own})
        assert [r["count"] for r in distinct_in(spark, path, where=F.col("year").between(first, last)).collect()] == [len({r[2] for r in own})]
        assert all("/bitmaps/" in f for f in found.inputFiles())


def test_more_entities_than_a_bitmap_holds(spark, path):
    songs = spark.range(100_000).select((F.col("id") % 3).alias("year"), (F.col("id") % 70_000).cast("string").alias("artist"))
    write_bitmaps(songs, ["year"], "artist", path)
    assert spark.read.parquet(f"{path}/bitmaps").count() == 9
    assert [r["count"] for r in distinct_in(spark, path).collect()] == [70_000]
    assert _rows(distinct_in(spark, path, "year")) == _rows(songs.groupBy("year").agg(F.count_distinct("artist")))


def test_batches_of_bitmaps_add_up(spark, path):
    rng = random.Random(9)
    data = [(2000 + rng.randrange(6), str(int(rng.triangular(0, 400, 0)))) for _ in range(2000)]
    songs = spark.createDataFrame(data, "year int, artist string")
    for batch, rows in enumerate(("year < 2003", "year = 2003", "year > 2003")):
        write_bitmaps(songs.where(rows), ["year"], "artist", path, batch)
    write_bitmaps(songs.where("year > 2003"), ["year"], "artist", path, 2)  # the last one again
    for first, last in ((2000, 2005), (2002, 2004)):
        found = distinct_in(spark, path, where=F.col("year").between(first, last)).first()["count"]
        assert found == len({a for y, a in data if first <= y <= last})
    numbers = [r[0] for r in spark.read.parquet(f"{path}/numbers").select("_number").collect()]
    assert sorted(numbers) == list(range(1, len({a for _, a in data}) + 1))
    with pytest.raises(ValueError):
        write_bitmaps(songs, ["year"], "artist", path, 1)


# ---- trees in parts ----


def test_parts_of_a_tree_make_the_document(spark, path):
    data = [(f"g{k % 3}", f"s{k % 7}", f"n{k}", k) for k in range(400)]
    data += [("hot", "hot", f'quote " and \\ {k}', 1) for k in range(800)] + [(None, "s", "x", 1), ("g0", None, None, 2), ("é", "ü", "日", 3)]
    table = spark.createDataFrame(data, "genre_group string, sub_group string, genre string, count bigint").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a tree is one file
    write_tree(table, path, "All", partitions=8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(str(f) for f in __import__("pathlib").Path(path, "json").glob("part-*"))
    text = "".join(open(f).read() for f in files)
    assert json.loads(text) == json.loads(hierarchy_json(table, "All").first().json)
    hot = spark.read.schema("genre_group string, _part int").parquet(f"{path}/rows/rows").where("genre_group = 'hot'")
    assert hot.select("_part").distinct().count() >= 4 and len(files) > 1


def test_an_empty_tree(spark, path):
    write_tree(spark.createDataFrame([], "genre_group string, sub_group string, genre string, count bigint"), path)
    text = "".join(r.value for r in spark.read.text(f"{path}/json").orderBy(F.desc("value")).collect())
    assert json.loads(text) == {"name": "Genres", "children": []}


# ---- stacks ----


def test_a_large_period_is_stacked_in_several_tasks(spark, path):
    hot = spark.range(20_000).select(F.lit(1).alias("year"), F.col("id"), (F.col("id") % 11 - 3).alias("value"))
    more = [(2, 5, 7), (2, 6, None), (2, 7, 1), (None, 1, 4), (None, 2, 5), (3, 1, 0)]
    table = hot.union(spark.createDataFrame(more, "year int, id bigint, value bigint"))
    write_positions(table, ["year", "id"], path, partitions=6)
    found = stack_positions(spark, path, "year", "value")
    assert found.columns == [*table.columns, "seg_start", "seg_mid"]
    assert _rows(found) == _rows(stack_segments(table, "year", "value", ["id"]))
    cut = spark.read.schema("year int, _part int").parquet(f"{path}/rows").where("year = 1")
    assert cut.select("_part").distinct().count() >= 5


# ---- several questions, and batches ----


def test_many_questions_read_the_songs_once(spark, path, tmp_path):
    data = [(f"g{k % 5}", f"a{k % 11}", None if k % 13 == 0 else 2000 + k % 3, k) for k in range(300)]
    spark.createDataFrame(data, "genre string, artist string, year int, pop int").write.parquet(str(tmp_path / "songs"))
    songs = spark.read.parquet(str(tmp_path / "songs"))
    sets = [["year", "genre"], ["genre"], ["artist", "year"], ["genre", "year"], ["year"]]
    write_question_sums(songs, sets, path)
    for columns in sets:
        found = question_sums(spark, path, *columns)
        assert _rows(found.select(*columns, "total_popularity")) == _rows(totals(songs, *columns))
        assert sum(r["count"] for r in found.collect()) == 300
        assert "PartitionFilters: [isnotnull(_set" in final_plan(found)
    wanted = songs.groupingSets(sets, "year", "genre", "artist").agg(F.sum("pop"))
    assert final_plan(wanted).count("FileScan") == 1


def test_batches_add_up_and_replace_themselves(spark, path):
    data = [(2000 + k % 4, f"t{k % 3}", k) for k in range(100)]
    songs = spark.createDataFrame(data, "year int, kind string, pop int")
    for batch, rows in (("a", "year < 2002"), ("b", "year = 2002"), ("c", "year = 2003"), ("b", "year = 2002")):
        add_batch(songs.where(rows), ["year", "kind"], path, batch, "pop")
    assert _rows(merged_counts(spark, path, "year", "kind")) == _rows(songs.groupBy("year", "kind").count())
    assert _rows(merged_totals(spark, path, "kind")) == _rows(totals(songs, "kind"))


# ---- files of several headers ----


def test_files_of_several_headers_are_read_by_their_own(spark, tmp_path):
    folder = tmp_path / "charts of two"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n1,one\n2,two\n")
    (folder / "b.csv").write_text("v,k\nthree,3\n")
    (folder / "c.csv").write_text("k,v\r\n4,four\r\n")
    (folder / "d.csv").write_text('﻿k,extra\n5,"a, b"\n')
    (folder / "e.csv").write_text("")
    columns = [("k", "k", "int"), ("v", "v", "string")]
    found = read_mixed_csv(spark, str(folder), columns)
    assert _rows(found.select("k", "v", "extra")) == [(1, "one", None), (2, "two", None), (3, "three", None), (4, "four", None), (5, None, "a, b")]
    with pytest.raises(ValueError, match="columns not in"):
        read_mixed_csv(spark, str(folder), [*columns, ("w", "w", "int")])
    (folder / "f.csv").write_text("k,v\n6,six,more\n")
    with pytest.raises(Exception, match="too many or too few"):
        read_mixed_csv(spark, str(folder), columns).collect()


def test_empty_tables_give_empty_answers(spark, path):
    none = spark.createDataFrame([], "year int, kind string, artist string, pop int")
    write_search_index(none, f"{path}/search")
    assert search_index(spark, f"{path}/search", "abc").collect() == search_index(spark, f"{path}/search", "").collect() == []
    write_bitmaps(none, ["year"], "artist", f"{path}/bits")
    assert [r["count"] for r in distinct_in(spark, f"{path}/bits").collect()] == [0]
    assert distinct_in(spark, f"{path}/bits", "year").collect() == []
    write_positions(none, ["year", "kind"], f"{path}/stack")
    assert stack_positions(spark, f"{path}/stack", "year", "pop").collect() == []
    write_question_sums(none, [["year"], ["kind"]], f"{path}/sums")
    assert question_sums(spark, f"{path}/sums", "year").collect() == []
    add_batch(none, ["year"], f"{path}/kept", "a", "pop")
    assert merged_totals(spark, f"{path}/kept", "year").collect() == merged_counts(spark, f"{path}/kept", "year").collect() == []
    assert classify_by_rules(none, "kind", spark.createDataFrame([(1, "a", "b")], RULES), "x").collect() == []

from __future__ import annotations

import pytest

from rankloom.fixed_values import CORRECTIONS, DROPPED_YEARS
from rankloom.operators import apply_corrections, clean, histogram, page, search, sort_table, top_k_with_ties
from rankloom.sources import read_chart_csv, scratch_folder, write_csv, write_json, write_table
from tests import golden


def test_csv_quotes_order_and_extra_columns(spark, tmp_path):
    path = tmp_path / "chart.csv"
    path.write_text(
        "﻿pop,Title,artist,top genre,year released,top year,artist type,bpm,Added Note\n"
        '70,"Say ""Hi"", Bob",Ann,pop,2011,2012,Solo,NA,x\n'
        "71.0,NA,Ann,pop,2011.5, 2012 ,Solo,90,\n",
        encoding="utf-8",
    )
    df = read_chart_csv(spark, str(path), golden.COLUMNS)
    assert df.columns == ["pop", "title", "artist", "genre", "year_released", "chart_year", "artist_type", "bpm",
                          "added_note"]
    first, second = df.collect()
    assert (first.title, first.pop, first.bpm, first.added_note) == ('Say "Hi", Bob', 70, None, "x")
    assert (second.title, second.pop, second.year_released, second.chart_year, second.added_note) == (
        None, 71, None, 2012, ""
    )


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = golden.write(tmp_path, ['"Two\nLines",Ann,pop,2011,2011,Solo,10,90'])
    assert read_chart_csv(spark, path, golden.COLUMNS, multi_line=True).first().title == "Two\nLines"


def test_csv_missing_column(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("title\nGold\n")
    with pytest.raises(ValueError, match="top genre"):
        read_chart_csv(spark, str(path), golden.COLUMNS)


def test_cleaning_order(spark):
    """A row of a dropped year, or without a year, is not rescued by a correction of its title."""
    df = spark.createDataFrame([("Gold", 1975), ("Gold", None), ("Gold", 1999), ("Other", 1999)],
                               "title string, year_released int")
    found = sorted(tuple(r) for r in clean(df, CORRECTIONS, DROPPED_YEARS).collect())
    assert found == [("Gold", 2015), ("Other", 1999)]


@pytest.mark.parametrize("more", [0, 60, 200_000])
def test_corrections_of_every_size_agree(spark, more):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), (None, 3)], "title string, year_released int")
    found = apply_corrections(df, {"a": 9, "b": None, None: 7, **{f"other {i}": i for i in range(more)}})
    assert sorted(map(str, map(tuple, found.collect()))) == ["('a', 9)", "('b', None)", "('c', 2)", "(None, 3)"]
    words = spark.createDataFrame([(1, "x"), (2, "y")], "id long, word string")
    found = apply_corrections(words, {1: "new", **{-i - 1: "z" for i in range(more)}}, "id", "word")
    assert sorted(map(tuple, found.collect())) == [(1, "new"), (2, "y")]


def test_no_corrections_change_nothing(spark):
    df = spark.createDataFrame([("a", 1)], "title string, year_released int")
    assert apply_corrections(df, {}).collect() == df.collect()


CSV = [("k", "k", "int"), ("v", "v", "string")]


def _files(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_headers_in_another_order_fail(spark, tmp_path):
    path = _files(tmp_path, a="k,v\n1,x\n", b="v,k\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_chart_csv(spark, path, CSV).collect()


@pytest.mark.parametrize("row", ["2,y,more", "2", '3,"two\nlines"', '"4\n5",z'])
def test_ragged_rows_are_told(spark, tmp_path, row):
    path = _files(tmp_path, a=f"k,v\n1,x\n{row}\n")
    with pytest.raises(Exception, match="too many or too few"):
        read_chart_csv(spark, path, CSV).collect()
    kept = read_chart_csv(spark, path, CSV, ragged="raw")
    assert kept.where("raw is null").select("k", "v").first() == (1, "x")
    assert kept.where("raw is not null").count() >= 1


def test_written_text_comes_back_as_it_was(spark, tmp_path):
    df = spark.createDataFrame([(1, " lead"), (2, "trail "), (3, None), (4, ""), (5, 'q"x,'), (None, "two\nlines")], "k int, v string")
    write_csv(df, str(tmp_path / "c"))
    back = read_chart_csv(spark, str(tmp_path / "c"), CSV, multi_line=True)
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session)


def test_ties_and_null_totals(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None)], "e string, pop int")
    names = lambda n: sorted(r.e for r in top_k_with_ties(df, ["e"], n).collect())
    assert names(1) == ["a", "b"] and names(3) == ["a", "b", "c"] and names(4) == ["a", "b", "c", "d"]


def test_histogram_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (31.0,)], "x double")
    found = sorted(map(tuple, histogram(df, {"x": 10}).collect()))
    assert found == [("x", 0, 1), ("x", 10, 0), ("x", 20, 0), ("x", 30, 1)]


def test_corrections_from_a_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), (None, 3)], "title string, year_released int")
    fixes = spark.createDataFrame([("a", 9), ("z", 8)], "title string, year_released int")
    found = apply_corrections(df, fixes)
    assert found.columns == df.columns
    assert sorted(map(str, ((r.title, r.year_released) for r in found.collect()))) == [
        "('a', 9)", "('a', 9)", "('b', 1)", "(None, 3)",
    ]


def test_repeated_correction_keys_fail(spark):
    df = spark.createDataFrame([("a", 1)], "title string, year_released int")
    fixes = spark.createDataFrame([("a", 9), ("a", 8)], "title string, year_released int")
    with pytest.raises(Exception, match="repeat a key"):
        apply_corrections(df, fixes).collect()


def test_table_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(2011, 'a "b"', 1), (2012, "", 2), (2012, "c,d", 3)], "y int, t string, n bigint")
    expected = sorted(tuple(r) for r in df.collect())
    write_table(df, str(tmp_path / "p"), partition_by=["y"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("y", "t", "n").collect()) == expected
    write_csv(df, str(tmp_path / "c"))
    columns = [("y", "y", "int"), ("t", "t", "string"), ("n", "n", "bigint")]
    assert sorted(tuple(r) for r in read_chart_csv(spark, str(tmp_path / "c"), columns).collect()) == expected
    write_json(spark.createDataFrame([('{"a":1}',)], "json string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().a == 1


def test_scratch_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_folder(spark), scratch_folder(spark)
    assert first != second
    assert shared is None or first.startswith(f"{shared}/")


def test_search_needs_every_term(spark):
    df = spark.createDataFrame([(1, "Red Ring"), (2, "Blue ring"), (3, None)], "id int, name string")
    assert [r.id for r in search(df, "RING re").collect()] == [1]
    assert search(df, "").count() == 3
    assert [r.id for r in search(df, "3").collect()] == [3]
    assert [r.id for r in search(df, "2", ["name"]).collect()] == []


def test_pages_make_up_the_table(spark):
    df = spark.range(25).selectExpr("id", "id % 3 as k")
    order = ["-k", "id"]
    whole = [r.id for r in sort_table(df, *order).collect()]
    pages = [r.id for number in (1, 2, 3) for r in page(df, order, 10, number).collect()]
    assert pages == whole
    last, seen = None, []
    while rows := page(df, order, 10, after=last).collect():
        seen += [r.id for r in rows]
        last = {"k": rows[-1].k, "id": rows[-1].id}
    assert seen == whole

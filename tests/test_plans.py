"""The shape of the plans: what reaches the scan, how often data is shuffled, what runs in one task."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import (
    apply_corrections,
    classify_by_rules,
    histogram,
    ranked_share,
    sort_table,
    top_k,
    top_k_rows,
    top_k_with_ties,
)
from rankloom.plans import catalog, stored, views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def songs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "songs")
    rows = [(f"t{i}", f"a{i % 7}", f"g{i % 5}", 2000 + i % 3, 2010 + i % 4, "Solo", i % 10, i) for i in range(200)]
    spark.createDataFrame(
        rows, "title string, artist string, genre string, year_released int, chart_year int, artist_type string,"
              "pop int, bpm int"
    ).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df) -> str:
    """The plan that ran, without the plans it started from."""
    df.collect()
    kept, skipped_from = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skipped_from is not None and depth >= skipped_from:
            continue
        skipped_from = depth if "== Initial Plan ==" in line else None
        if skipped_from is None:
            kept.append(line)
    return "\n".join(kept)


def scanned(plan: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_a_share_reads_and_shuffles_the_songs_once(songs):
    plan = final_plan(ranked_share(songs, "year_released", ["genre"], 3))
    assert plan.count("FileScan") == 1
    assert "ReusedExchange" in plan
    assert scanned(plan) == [{"genre", "year_released", "pop"}]
    assert re.search(r"WindowGroupLimit .* Partial", plan) and re.search(r"WindowGroupLimit .* Final", plan)
    assert "SinglePartition" not in plan


def test_distinct_shares_read_once(songs):
    plan = final_plan(ranked_share(songs, "year_released", ["title", "artist"], 3, repeats=False))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_no_cut_is_pushed_away_for_large_n(songs):
    plan = final_plan(ranked_share(songs, "year_released", ["title"], 2000, slices=8))
    assert "_slice" in plan and plan.count("FileScan") == 1


def test_top_k_keeps_n_rows_per_task(songs):
    plan = final_plan(top_k(songs, ["artist"], 3))
    assert "TakeOrderedAndProject(limit=3" in plan
    assert "SinglePartition" not in plan
    assert scanned(plan) == [{"artist", "pop"}]


def test_ties_have_no_window_and_share_the_shuffle(songs):
    plan = final_plan(top_k_with_ties(songs, ["genre"], 3))
    assert "Window" not in plan and "ReusedExchange" in plan
    assert plan.count("FileScan") == 1


def shuffled_rows(df) -> list[int]:
    """The rows that each shuffle of the plan that ran has written, without those of its subqueries."""
    df.collect()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_top_rows_are_cut_before_the_only_shuffle_of_rows(songs):
    top = top_k_rows(songs.drop("chart_year"), 3)
    plan = final_plan(top)
    assert "WindowGroupLimit" not in plan and "Join" not in plan and "TakeOrderedAndProject" in plan
    assert sum(shuffled_rows(top)) <= 4 * 8  # of 200 rows, 20 of which share the best measure


@pytest.mark.parametrize("direction", ["top", "bottom"])
def test_a_row_that_fills_half_the_table_is_sent_once_a_task(spark, tmp_path, direction):
    hot, n = 9 if direction == "top" else -9, 3
    rows = [(1, hot)] * 4000 + [(i, i % 2) for i in range(2, 4002)]
    spark.createDataFrame(rows, "id long, pop int").repartition(8).write.parquet(str(tmp_path / "t"))
    top = top_k_rows(spark.read.parquet(str(tmp_path / "t")), n, direction=direction)
    assert [tuple(r)[:2] for r in top.orderBy("position").collect()] == [(1, hot), *([(3, 1), (5, 1)] if hot > 0 else [(2, 0), (4, 0)])]
    assert sum(shuffled_rows(top)) <= 8 * 2 * n


def test_a_share_without_its_columns_still_reads_once(songs):
    shares = ranked_share(songs, "year_released", ["genre"], 3)
    for columns in (["genre", "rn"], ["year_released"], ["total_popularity"]):
        plan = final_plan(shares.select(*columns))
        assert plan.count("FileScan") == 1, columns


@pytest.mark.parametrize("empty_bins", [True, False])
@pytest.mark.parametrize("include_lowest", [True, False])
def test_histograms_read_once(songs, empty_bins, include_lowest):
    plan = final_plan(histogram(songs, {"bpm": 10, "pop": 2}, empty_bins, include_lowest))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_trees_read_once(songs):
    plan = final_plan(views.genre_tree(songs))
    assert plan.count("FileScan") == 1


@pytest.fixture
def hot_titles(spark, tmp_path):
    """Half of the rows have one title, under settings in which small tables are joined as large ones."""
    rows = spark.range(400_000).selectExpr("if(id % 2 = 0, 'hot', concat('t', id % 5000)) as title", "2000 + cast(id % 9 as int) as year_released")
    rows.write.parquet(f"{tmp_path}/songs")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield spark.read.parquet(f"{tmp_path}/songs")
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_titles_are_split(spark, tmp_path, hot_titles):
    spark.range(5000).selectExpr("concat('t', id) as title", "1990 as year_released").write.parquet(f"{tmp_path}/fixes")
    assert "skew=true" in final_plan(apply_corrections(hot_titles, spark.read.parquet(f"{tmp_path}/fixes")))


def test_hot_values_are_classified_in_several_tasks(spark, hot_titles):
    rules = spark.createDataFrame([(1, "t99", "many"), (2, "ot", "hot")], "priority int, text string, label string")
    found = classify_by_rules(hot_titles, "title", rules, "none").select("year_released", "label")
    plan = final_plan(found)
    # the join that the rows go through is the topmost one
    top = re.search(r"SortMergeJoin[^\n]*", plan[plan.index("== Final Plan =="):])
    assert "skew=true" in top[0] and "LeftOuter" in top[0]
    assert {r.label for r in found.distinct().collect()} == {"many", "hot", "none"}


def test_filters_reach_the_scan(songs):
    plan = final_plan(views.popular_artists_of_type(songs, "Solo", 3, "Each Year"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(artist_type,Solo\)", plan)


def test_a_sort_can_split_one_value(songs):
    plan = final_plan(sort_table(songs.select("genre", "title"), "genre"))
    assert re.search(r"rangepartitioning\(genre#\d+ ASC NULLS LAST, title#\d+ ASC NULLS LAST", plan)


def test_groups_are_classified_after_genres_are_summed(songs):
    plan = final_plan(views.popular_genre_groups(songs, 3, "Release Years"))
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "CASE" not in below


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(stored.queries())))  # those write before they answer
def test_no_python_workers_and_no_cross_joins(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan, word

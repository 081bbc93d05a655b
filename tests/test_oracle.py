"""Every catalog query against its SQL twin on the test tables."""

from __future__ import annotations

import os

import pytest

from rankloom.plans import catalog, oracle
from tests.compare import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_same_names():
    assert set(catalog.queries()) == set(oracle.sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    assert differences(catalog.queries()[name](spark, FOLDER), duck, oracle.sql()[name]) is None


# Settings under which the small test tables are joined as very large ones would be.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.shuffle.partitions": "9",
}


@pytest.fixture
def as_large(spark):
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("name", [
    "corrected_by_table", "distinct_songs", "genre_tree", "unique_artists_by_type_and_year", "top_songs",
    "top_genres_in_group_with_ties", "share_top_songs_by_release_year", "share_bottom_artists_of_type_by_chart_year",
    "feature_histograms", "parts_by_rule_table", "artists_kept_up", "stacked_lines", "six_shares",
])
def test_shuffled_and_split_joins_give_the_same(spark, duck, as_large, name):
    assert differences(catalog.queries()[name](spark, FOLDER), duck, oracle.sql()[name]) is None


def test_differences_are_seen(spark, duck):
    df = catalog.queries()["songs_by_type"](spark, FOLDER)
    changed = oracle.sql()["songs_by_type"].replace("count(*)", "count(*) + 1")
    assert differences(df, duck, changed) is not None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0

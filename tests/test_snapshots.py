"""Stored tables: readers see whole states, failed writes change nothing, parts that aren't touched stay where they are."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketgrain.sources import feeds, folders, sinks
from marketgrain.sources.snapshots import Snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v string")


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/table")


def test_a_frame_that_was_opened_before_still_reads(spark, store):
    old = store.replace(frame(spark, (1, "a"), (2, "b")))
    new = sinks.refreshed(frame(spark, (3, "c")), store.path)
    assert rows(old) == [(1, "a"), (2, "b")] and rows(new) == rows(store.read()) == [(3, "c")]
    store.vacuum()
    assert rows(store.read()) == [(3, "c")] and len([n for n in folders.names(spark, store.path) if n.startswith("data-")]) == 1


def test_a_failed_write_changes_nothing(spark, store):
    store.replace(frame(spark, (1, "a")))
    bad = frame(spark, (1, "x")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.replace(bad)
    assert rows(store.read()) == [(1, "a")] and store.state()["version"] == 1


def test_of_two_writers_the_later_fails(spark, store, monkeypatch):
    store.replace(frame(spark, (1, "a")))
    state = store.state()
    store.append(frame(spark, (2, "b")))
    with pytest.raises(FileExistsError):
        store._swap(state, {}, state["schema"], None)
    assert rows(store.read()) == [(1, "a"), (2, "b")]


def test_parts_are_replaced_alone(spark, store):
    part = F.col("k") % 3
    store.replace(frame(spark, (1, "a"), (2, "b"), (4, "c"), (None, "n")), part)
    before = store.state()["parts"]
    store.replace_parts(frame(spark, (1, "new")), part, ledger={"batch": 1}, emptied=["2"])
    after = store.state()
    assert rows(store.read().where("k is not null")) == [(1, "new")] and store.read().count() == 2
    assert after["parts"]["__HIVE_DEFAULT_PARTITION__"] == before["__HIVE_DEFAULT_PARTITION__"] and store.ledger() == {"batch": 1}


def test_retention_drops_months_and_rewrites_one(spark, store):
    days = [datetime.datetime(2024, m, d) for m in range(1, 6) for d in (1, 15, 28)]
    store.replace(spark.createDataFrame([(d,) for d in [*days, None]], "t timestamp_ntz"), sinks.month_of("t"))
    before = store.state()["parts"]
    cut = datetime.datetime(2024, 3, 15)
    assert sinks.delete_older(store, "t", cut) == len([d for d in days if d < cut])
    assert rows(store.read().where("t is not null")) == [(d,) for d in days if d >= cut] and store.read().where("t is null").count() == 1
    after = store.state()["parts"]
    assert set(before) - set(after) == {"202401", "202402"} and after["202404"] == before["202404"] and after["202403"] != before["202403"]
    assert sinks.delete_older(store, "t", cut) == 0 and store.state()["version"] == 2


def test_truncate_tells_what_was_there(spark, tmp_path):
    stores = {n: Snapshots(spark, f"file://{tmp_path}/{n}") for n in "ab"}
    stores["a"].replace(frame(spark, (1, "a"), (2, "b")))
    stores["b"].replace(frame(spark))
    assert sinks.truncated(stores) == {"a": 2, "b": 0}
    assert stores["a"].read().count() == 0 and stores["a"].read().columns == ["k", "v"]


def test_repeated_keys_give_one_row_always(spark, store):
    store.replace(frame(spark, (1, "old")))
    new = frame(spark, (2, "b"), (2, "z"), (1, "x"), (2, "a"))
    assert rows(sinks.insert_stored(store, new, ["k"])) == [(1, "old"), (2, "z")]
    assert rows(sinks.replace_stored(store, frame(spark, (2, "q"), (3, "r")), ["k"])) == [(1, "old"), (2, "q"), (3, "r")]


def test_monthly_partitions_are_there_ahead(spark, tmp_path):
    prices = spark.createDataFrame([(1, 20231105), (2, 20231231), (3, 20240101), (4, 20240430), (5, 20240501), (6, 20200101)], "id int, date_id int")
    table = sinks.MonthlyTable(spark, "ahead_test")
    table.create(prices, f"file://{tmp_path}/ahead")
    try:
        table.ensure(20231101, 20240115)
        table.ensure(20231101, 20240115)
        assert table.months() == [-1, 202311, 202312, 202401, 202402, 202403, 202404]
        table.insert(prices)
        got = rows(table.partitions())
        assert got[1:] == [(202311, 20231101, 20231201, 1), (202312, 20231201, 20240101, 1), (202401, 20240101, 20240201, 1), (202402, 20240201, 20240301, 0), (202403, 20240301, 20240401, 0), (202404, 20240401, 20240501, 1)]
        assert got[0] == (-1, None, None, 2)
    finally:
        table.drop()


def test_later_sources_are_not_read(spark):
    def broken(n):
        return spark.range(n).select(F.raise_error(F.lit("read")).cast("long").alias("id"))

    few, enough = spark.range(3).toDF("id"), spark.range(30).toDF("id")
    assert feeds.first_filled([few, enough, broken(5)], least=10).count() == 30
    assert feeds.first_filled([few.limit(0), few]).count() == 3
    assert feeds.first_filled([enough, few], least=31).count() == 3

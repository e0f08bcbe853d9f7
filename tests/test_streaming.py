"""Streams give what the batch rules give, over several micro-batches, restarts, repeated and failed batches."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from marketgrain.operators import ingest, lifecycle
from marketgrain.sources.snapshots import Snapshots
from marketgrain.streaming import ingest as streams
from marketgrain.streaming import queue, state

NOON = datetime.datetime(2024, 5, 1, 12)


def _observations(spark):
    rows = [(i, i % 3, 1_700_000_000 + i * 60, float(10 + (i // 4) % 2), "EUR", None if i % 5 == 0 else True) for i in range(40)]
    return spark.createDataFrame(rows, "id long, listing_id long, observed_at long, price double, currency string, in_stock boolean")


def _runs(parts, plan, mode, folder, limit=60):
    """Each part arrives and is worked off by a run of its own, which is a restart; returns all rows with their batch."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = plan(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        run = stream.writeStream.foreachBatch(streams.to_files(f"{folder}/out")).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        assert run.awaitTermination(limit)
    return spark.read.parquet(f"{folder}/out")


def test_suppression_equals_batch(spark, tmp_path):
    frame = _observations(spark)
    parts = [frame.where(f"id >= {k * 10} and id < {k * 10 + 10}").coalesce(1) for k in range(4)]
    found = _runs(parts, streams.suppressed, "append", tmp_path)
    full = frame.selectExpr("*", "'n' AS product_name", "'t' AS title", "cast(null as double) AS original_price", "'' AS currency_raw", "array('EUR') AS allowed")
    batch = {r.id: r.outcome for r in ingest.ingest(full).collect()}
    assert {r.id: r.outcome for r in found.collect()} == batch


def _attempts(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), NOON + datetime.timedelta(minutes=i), "success" if rng.random() < 0.05 else rng.choice(["timeout", "error"])) for i in range(240)]
    return spark.createDataFrame(rows, "id long, listing_id long, created_at timestamp, status string")


def test_listing_state_equals_batch(spark, tmp_path):
    logs = _attempts(spark)
    batch = lifecycle.attempt_streaks(logs).select("id", "listing_id", "errors", "last_error", "streak", "active")
    good = F.col("status") == "success"
    attempts = logs.select("listing_id", "id", "created_at", good.alias("ok"), F.when(~good, F.col("status")).alias("error"))
    # the first hundred are a batch table; the listings' states go on from there
    known = lifecycle.attempt_streaks(logs.where("id < 100")).groupBy("listing_id").agg(F.max(F.struct("id", "streak", "active")).alias("x")).select("listing_id", "x.streak", "x.active")
    first = [known]
    with state.rocksdb(spark):
        parts = [attempts.where(f"id >= {a} and id < {b}") for a, b in ((100, 120), (120, 200), (200, 240))]
        found = _runs(parts, lambda rows: state.listing_states(rows, first.pop() if first else None), "append", tmp_path)
    assert sorted(map(tuple, found.drop("batch").collect())) == sorted(map(tuple, batch.where("id >= 100").collect()))
    told = batch.collect()
    assert {r.active for r in told} == {True, False}
    assert all((r.errors, r.last_error) == (0, None) for r in told if r.streak == 0)  # cleared before the attempt, and nothing failed
    assert all(r.errors == 1 and r.last_error for r in told if r.streak > 0)  # never more than this attempt's


def test_an_inactive_listing_stays_so(spark):
    logs = spark.createDataFrame([(i, 1, NOON + datetime.timedelta(minutes=i), "success" if i == 16 else "timeout") for i in range(18)], "id long, listing_id long, created_at timestamp, status string")
    told = {r.id: (r.streak, r.active) for r in lifecycle.attempt_streaks(logs).collect()}
    assert told[13] == (14, True) and told[14] == (15, False) and told[16] == (0, False) and told[17] == (1, False)


def test_heartbeats_that_are_missed_in_event_time(spark, tmp_path):
    at = lambda s: NOON + datetime.timedelta(seconds=s)
    frame = lambda *rows: spark.createDataFrame([(j, at(s)) for j, s in rows], "job_id long, beat_at timestamp")
    parts = [
        frame((1, 0), (1, 500), (2, 0), (3, 10), (4, 0), (4, 601)),  # job 4 misses one between two beats
        frame((1, 1000), (2, 600), (3, 1211)),  # time is 1151: no job has missed more than 600 seconds but 4
        frame((2, 1300), (5, 2400)),  # time is 2340: job 1, silent since 1000, is told without input of its own; 2 missed one
    ]
    with state.rocksdb(spark):
        found = _runs(parts, state.missed_heartbeats, "append", tmp_path)
    got = {(r.job_id, r.last_beat, r.reaped_at) for r in found.collect()}
    assert got == {(4, at(0), at(600)), (1, at(1000), at(1600)), (2, at(600), at(1200)), (3, at(10), at(610))}
    assert found.count() == len(got)


def test_heartbeats_by_the_clock_are_told_without_input(spark, tmp_path):
    spark.createDataFrame([(7, datetime.datetime.now())], "job_id long, beat_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id long, beat_at timestamp").parquet(f"{tmp_path}/in")
    with state.rocksdb(spark):
        found = state.missed_heartbeats(stream, limit_s=2, event_time=False)
        run = found.writeStream.foreachBatch(streams.to_files(f"{tmp_path}/out")).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        told, end = [], time.time() + 60
        while not told and time.time() < end:
            time.sleep(0.5)
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("*/_SUCCESS")):
                told = spark.read.schema("job_id long, last_beat timestamp, reaped_at timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    finally:
        run.stop()
    assert [r.job_id for r in told] == [7]


def test_upsert_keeps_the_last(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/table")
    write = streams.upsert_batches(store, ["k"], ["at"], 4)
    stored = lambda: sorted(tuple(r) for r in store.read().select("k", "v").collect())
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, at int, v string").repartition(3)
    write(frame((1, 1, "a"), (2, 3, "late"), (2, 2, "z"), (2, 1, "y")), 0)  # of a key's rows in one batch the last counts
    assert stored() == [(1, "a"), (2, "late")]
    second = frame((2, 1, "c"), (3, 1, "d"))
    write(second, 1)
    assert stored() == [(1, "a"), (2, "c"), (3, "d")]
    version = store.state()["version"]
    write(second, 1)  # again, as after a restart
    write(frame((1, 1, "old")), 0)
    assert stored() == [(1, "a"), (2, "c"), (3, "d")] and store.state()["version"] == version


def test_a_failed_upsert_changes_no_part(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/table")
    write = streams.upsert_batches(store, ["k"], [], 4)
    write(spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v")), 0)
    bad = spark.range(20).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise("b").cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        write(bad, 1)
    assert {r.v for r in store.read().collect()} == {"a"} and store.ledger() == {"batch": 0}
    write(bad.where("k < 19"), 1)
    assert sorted(r.v for r in store.read().collect()) == ["a"] + ["b"] * 19


@pytest.fixture
def urls(spark, tmp_path):
    """1,500 URLs as a stored list; the first of each pair of neighbours from 1,400 on repeats the other."""
    rows = spark.range(1500).select("id", F.concat(F.lit("http://shop.example/p/item-"), F.when(F.col("id") < 1400, F.col("id")).otherwise(F.floor(F.col("id") / 2))).alias("url"))
    return queue.stored_list(rows, "id", f"file://{tmp_path}/list", files=4), f"file://{tmp_path}/list"


def test_saving_stops_at_the_deadline_and_goes_on(spark, tmp_path, urls):
    stored, folder = urls
    store = Snapshots(spark, f"file://{tmp_path}/saved")
    # the deadline is looked at between batches: the first one is saved even if it has passed
    assert queue.save_in_batches(spark, stored, folder, store, "url", 500, deadline=time.time() - 1) == (500, 500, True)
    assert store.read().agg(F.max("id")).first()[0] == 499
    assert queue.save_in_batches(spark, stored, folder, store, "url", 400, deadline=time.time() - 1) == (400, 900, True)
    # the rest: 500 more URLs without repeats, and 50 that stand twice (ids 1400 on are 700 to 749 again, which are stored)
    assert queue.save_in_batches(spark, stored, folder, store, "url", 500) == (500, 1500, False)
    assert store.read().count() == 1400 == store.read().select("url").distinct().count()
    assert queue.save_in_batches(spark, stored, folder, store, "url", 500) == (0, 1500, False)


def test_what_is_stored_is_not_saved_again(spark, tmp_path, urls):
    stored, folder = urls
    store = Snapshots(spark, f"file://{tmp_path}/saved")
    store.replace(stored.where("id % 2 = 0 and id < 1000"))
    assert queue.save_in_batches(spark, stored, folder, store, "url", 500, deadline=0) == (250, 500, True)
    assert queue.save_in_batches(spark, stored, folder, store, "url", 5000)[1:] == (1500, False)
    assert store.read().count() == 1400


def test_a_batch_that_fails_is_saved_once(spark, tmp_path, urls, monkeypatch):
    stored, folder = urls
    store = Snapshots(spark, f"file://{tmp_path}/saved")
    append, calls = Snapshots.append, []

    def failing(self, df, part=None, ledger=None):
        calls.append(ledger)
        if len(calls) == 2:
            raise RuntimeError("the driver was lost")
        return append(self, df, part, ledger)

    monkeypatch.setattr(Snapshots, "append", failing)
    with pytest.raises(Exception, match="lost"):
        queue.save_in_batches(spark, stored, folder, store, "url", 600)
    assert store.ledger() == {"offset": 600, "saved": 600}
    assert queue.save_in_batches(spark, stored, folder, store, "url", 600) == (800, 1500, False)


def test_slices_follow_rows_not_files(spark, tmp_path, urls, monkeypatch):
    monkeypatch.setattr(queue, "TASK_ROWS", 100)
    _, folder = urls
    reader = queue.ListReader({"path": folder, "rows": "450", "start": "30"})
    assert (reader.initialOffset(), reader.latestOffset(), reader.latestOffset()) == ({"row": 30}, {"row": 480}, {"row": 930})
    slices = reader.partitions({"row": 30}, {"row": 480})
    assert sum(s.rows for s in slices) == 450 and max(s.rows for s in slices) <= 100
    rows = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(30, 480)) == [r[queue.PLACE] for r in rows]


def test_streaks_by_batch_go_on_from_what_is_stored(spark, tmp_path):
    from marketgrain.sources.snapshots import Snapshots

    rng = random.Random(11)
    rows = [(rng.choice([None, *range(5)]), k, NOON + datetime.timedelta(minutes=k // 2), rng.choice([True, False, False, False, None])) for k in range(90)]
    store = Snapshots(spark, f"file://{tmp_path}/streaks")
    write, want = streams.streak_batches(store, partitions=4), {}
    for number in range(3):
        # the last batch has one listing only, the others stay
        part = [r for r in rows if r[1] // 30 == number and (number < 2 or r[0] == 1)]
        for listing, _, _, ok in part:
            want[listing] = 0 if ok else want.get(listing, 0) + 1
        batch = spark.createDataFrame(rng.sample(part, len(part)), "listing_id long, id long, created_at timestamp, ok boolean").repartition(3)
        write(batch, number)
        write(batch, number)  # repeated: told by the ledger
    assert {r.listing_id: (r.streak, r.deactivated) for r in store.read().collect()} == {k: (n, n >= 15) for k, n in want.items()}


def test_a_part_is_written_by_one_task(spark, tmp_path):
    from marketgrain.sources.snapshots import Snapshots

    store = Snapshots(spark, f"file://{tmp_path}/parts")
    store.replace(spark.range(0, 400, numPartitions=8).withColumn("v", F.col("id") * 2), F.col("id") % 5)
    assert len(list(tmp_path.glob("parts/data-*/*/*.parquet"))) == 5 and store.read().count() == 400


def test_changed_batches_equal_the_batch_rule(spark, tmp_path):
    from marketgrain.sources.snapshots import Snapshots

    frame, told = _observations(spark), []
    write = streams.changed_batches(Snapshots(spark, f"file://{tmp_path}/last"), lambda rows, number: told.extend((number, r.id) for r in rows.collect()))
    for number in range(4):
        write(frame.where(f"id >= {number * 10} and id < {number * 10 + 10}"), number)
    full = frame.selectExpr("*", "'n' AS product_name", "'t' AS title", "cast(null as double) AS original_price", "'' AS currency_raw", "array('EUR') AS allowed")
    want = [r.id for r in ingest.ingest(full.where("id < 40")).where("outcome = 'success'").collect()]
    assert sorted(told) == sorted((k // 10, k) for k in want)

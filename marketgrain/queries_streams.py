"""Streams over the stored tables, run to their end; their results are what the batch rules give.

Input arrives in parts by time, each run a restart from the checkpoint of the one before; results are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions import numbers
from marketgrain.operators import ingest as rules
from marketgrain.operators import lifecycle
from marketgrain.queries import ORACLE_SQL, query
from marketgrain.queries_more import _observed
from marketgrain.queries_rules import _STATES
from marketgrain.sources import sinks
from marketgrain.sources.folders import fresh_folder, remove
from marketgrain.sources.snapshots import Snapshots
from marketgrain.sources.star import Star
from marketgrain.streaming import ingest, queue, state

PARTS = 3


def _part(rows: DataFrame, time: str) -> DataFrame:
    """Add ``part``: in which third of the rows' time a row lies."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    least, most = rows.agg(F.min(micros), F.max(micros)).first()
    span = ((most or 0) - (least or 0)) // PARTS + 1
    return rows.withColumn("part", F.floor((micros - F.lit(least or 0)) / F.lit(span)).cast("int"))


def _streamed(rows: DataFrame, time: str, plan: Callable[[DataFrame], DataFrame], mode: str, write: Callable, first: int = 0) -> None:
    """Runs a stream over parts of ``rows`` by time, from the part ``first`` on: each arrives and is worked off by a run of its own, all with one checkpoint."""
    spark, folder = rows.sparkSession, fresh_folder(rows.sparkSession, "stream")
    placed = _part(rows, time)
    for k in range(first, PARTS):
        placed.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = plan(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    remove(spark, folder)


def _to_files(rows: DataFrame, time: str, plan: Callable[[DataFrame], DataFrame], mode: str, first: int = 0) -> DataFrame:
    """The batches of such a stream's result, told apart by ``batch``."""
    spark, out = rows.sparkSession, fresh_folder(rows.sparkSession, "streamed")
    _streamed(rows, time, plan, mode, ingest.to_files(out), first)
    return spark.read.option("basePath", out).parquet(out)


def _newest(batches: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch that told it."""
    others = [c for c in batches.columns if c not in (*keys, "batch")]
    last = batches.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("x"))
    return last.select(*keys, *[F.col("x")[c].alias(c) for c in others])


def _logs(s: Star) -> DataFrame:
    return s.logs().withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("SELECT w AS start, w + INTERVAL 24 HOUR AS \"end\", marketplace_id, count(*) AS scrapes, count(*) FILTER (WHERE status = 'success') AS successes, avg(duration_ms) AS avg_ms FROM (SELECT *, date_trunc('hour', created_at) - k * INTERVAL 1 HOUR AS w FROM logs, generate_series(0, 23) AS g(k)) GROUP BY ALL")
def stream_activity(s: Star) -> DataFrame:
    done = _newest(_to_files(_logs(s), "created_at", ingest.activity, "update"), "start", "end", "marketplace_id")
    return done.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


ORACLE_SQL["stream_streaks"] = ORACLE_SQL["win_failure_streak"]


@query()
def stream_streaks(s: Star) -> DataFrame:
    logs = _logs(s).select("listing_id", "id", "created_at", F.col("status").isin("success", "no_change").alias("ok"))
    store = Snapshots(s.spark, fresh_folder(s.spark, "streaks"))
    _streamed(logs, "created_at", lambda stream: stream, "append", ingest.streak_batches(store))
    return store.read().select("listing_id", "streak", "deactivated")


_FIRST_PART = "(SELECT min(epoch_us(created_at)) + (max(epoch_us(created_at)) - min(epoch_us(created_at))) // 3 + 1 FROM logs)"


@query(f"SELECT id, listing_id, errors, last_error, streak, active FROM ({_STATES}) WHERE epoch_us(created_at) >= {_FIRST_PART}")
def stream_listing(s: Star) -> DataFrame:
    """The first third of the attempts is a batch table, whose listings' states the stream over the rest starts from."""
    logs = _logs(s)
    stored = lifecycle.attempt_streaks(_part(logs, "created_at").where("part = 0"))
    known = stored.groupBy("listing_id").agg(F.max(F.struct("created_at", "id", "streak", "active")).alias("x")).select("listing_id", "x.streak", "x.active")
    good = F.col("status").isin("success", "no_change")
    attempts = logs.select("listing_id", "id", "created_at", good.alias("ok"), F.when(~good, F.col("status")).alias("error"))
    first = [known]  # initial state belongs to the checkpoint's first run

    def plan(stream: DataFrame) -> DataFrame:
        return state.listing_states(stream, first.pop() if first else None)

    with state.rocksdb(s.spark):
        return _to_files(attempts, "created_at", plan, "append", first=1).drop("batch")


_BEATS = "(SELECT DISTINCT CAST(strftime(created_at, '%Y%m%d') AS BIGINT) * 10 + marketplace_id AS job_id, date_trunc('second', created_at) AS t FROM logs)"


@query(f"SELECT job_id, min(t) AS last_beat, min(t) + INTERVAL 600 SECOND AS reaped_at FROM (SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t) AS later, max(t) OVER () - INTERVAL 60 SECOND AS clock FROM {_BEATS}) WHERE coalesce(later, clock) > t + INTERVAL 600 SECOND GROUP BY 1")
def stream_heartbeats(s: Star) -> DataFrame:
    """A job for each marketplace and day; its beats are its attempts."""
    job = F.date_format("created_at", "yyyyMMdd").cast("long") * 10 + F.col("marketplace_id")
    beats = _logs(s).select(job.alias("job_id"), F.date_trunc("second", "created_at").alias("beat_at"))
    with state.rocksdb(s.spark):
        found = _to_files(beats, "beat_at", state.missed_heartbeats, "append").drop("batch")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_beat", "reaped_at")})


ORACLE_SQL["stream_one_per_day"] = ORACLE_SQL["ing_one_per_day"]


@query()
def stream_one_per_day(s: Star) -> DataFrame:
    """Observations pass the gate and are compared with the last one kept; the day's last price of each listing is upserted."""
    observed = rules.gate(_observed(s)).where("passed").select("listing_id", "id", F.col("observed_at").cast("timestamp").alias("observed_at"), "price", "currency", "in_stock")
    store, last = (Snapshots(s.spark, fresh_folder(s.spark, name)) for name in ("daily", "last"))
    upsert = ingest.upsert_batches(store, ["listing_id", "date_id"], ["observed_at", "id", "price"])

    def write(rows: DataFrame, number: int) -> None:
        upsert(rows.select("listing_id", F.date_format("observed_at", "yyyyMMdd").cast("int").alias("date_id"), "observed_at", "id", "price"), number)

    _streamed(observed, "observed_at", lambda stream: stream, "append", ingest.changed_batches(last, write))
    before = F.lag("price").over(Window.partitionBy("listing_id").orderBy("date_id"))
    return store.read().select("listing_id", "date_id", "price", numbers.change_pct(F.col("price"), before).alias("change_pct"))


_HASH = "sha256(lower(rtrim(trim(url), '/')))"


@query(f"SELECT DISTINCT {_HASH} AS url_hash, {_HASH} IN (SELECT {_HASH} FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL) AS known FROM pages WHERE url IS NOT NULL")
def sink_batched(s: Star) -> DataFrame:
    """URLs saved in batches: every third page's is known before; time runs out after one batch, and a later run goes on from there."""
    from marketgrain.functions import urls

    rows = s.table("pages").where("url is not null").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))
    store = Snapshots(s.spark, fresh_folder(s.spark, "saved"))
    store.replace(sinks.one_per_key(rows.where("page_id % 3 = 0"), ["url_hash"]).withColumn("known", F.lit(True)))
    folder = fresh_folder(s.spark, "list")
    listed = queue.stored_list(rows.withColumn("known", F.lit(False)), "page_id", folder)
    size = max(1, -(-listed.count() // 4))
    saved, reached, stopped = queue.save_in_batches(s.spark, listed, folder, store, "url_hash", size, deadline=0)
    if reached != min(size, listed.count()):
        raise ValueError(f"{reached} rows were taken, not {size}")
    queue.save_in_batches(s.spark, listed, folder, store, "url_hash", size)
    remove(s.spark, folder)
    return store.read().select("url_hash", "known")

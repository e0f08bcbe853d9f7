"""Streaming forms: activity by window, suppression of unchanged prices, failure streaks and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketgrain.operators.ingest import SAME_PRICE, unchanged
from marketgrain.operators.lifecycle import DEACTIVATE_AFTER
from marketgrain.sources import folders, sinks
from marketgrain.sources.snapshots import Snapshots


def activity(logs: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts, successes and mean duration of each marketplace in sliding windows."""
    window = F.window("created_at", length, slide)
    good = F.count_if(F.col("status") == "success")
    return logs.withWatermark("created_at", late).groupBy(window, "marketplace_id").agg(F.count("*").alias("scrapes"), good.alias("successes"), F.avg("duration_ms").alias("avg_ms")).select("window.start", "window.end", "marketplace_id", "scrapes", "successes", "avg_ms")


def suppressed(observations: DataFrame) -> DataFrame:
    """Passing observations (listing_id, id, observed_at, price, currency, in_stock and more) with their outcome, against the last
    one kept in state: the batch rule of ``ingest`` on a stream."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["observed_at", "id"])
        price, currency, known = rows["price"].to_numpy().astype(float), rows["currency"].to_numpy(object), rows["in_stock"].notna().to_numpy()
        stock = np.full(len(rows), -1)  # unknown
        stock[known] = rows["in_stock"].to_numpy()[known].astype(bool)
        last = state.get if state.exists else (np.nan, None, None)  # no price is near none
        before = lambda now, first: np.concatenate([np.array([first], now.dtype), now[:-1]])
        near = np.abs(price - before(price, last[0])) < SAME_PRICE
        same = near & (currency == before(currency, last[1])) & (stock == before(stock, -1 if last[2] is None else int(last[2])))
        state.update((float(price[-1]), currency[-1], None if stock[-1] < 0 else bool(stock[-1])))
        yield rows.assign(outcome=np.where(same, "no_change", "success"))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in observations.schema)
    return observations.groupBy("listing_id").applyInPandasWithState(judge, f"{own}, outcome string", "price double, currency string, in_stock boolean", "append", GroupStateTimeout.NoTimeout)


def to_files(path: str):
    """A foreachBatch function: each batch's rows in a folder of its own (column ``batch``), written anew if the batch is repeated."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def upsert_batches(store: Snapshots, keys: list[str], last: list[str] = [], partitions: int = 64):
    """A foreachBatch function: each batch's rows replace stored rows with their keys; of a batch's rows with one key that
    with the greatest ``last`` counts.

    The table has parts by key hash; a batch rewrites those that it touches and no others, and all of them appear at once, with the
    batch's number in the ledger. So a batch that fails changes nothing, and one that is repeated isn't applied again.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(partitions))

    def write(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, store.state()
        if number <= state["ledger"].get("batch", -1):
            return
        with folders.passing_folder(spark, "batch") as path:
            sinks.one_per_key(batch, keys, last).withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
            touched = [n.partition("=")[2] for n in folders.names(spark, path) if n.startswith("_part=")]
            new = spark.read.schema(batch.schema).parquet(path).select(*batch.columns)
            rows = new if state["schema"] is None else sinks.replaced_by_key(store.read(touched, state), new, keys)
            store.replace_parts(rows.select(*batch.columns), part, ledger={"batch": number})

    return write


def changed_batches(last: Snapshots, write_changed: Callable[[DataFrame, int], None]):
    """A foreachBatch function: of passing observations those that changed something go to ``write_changed``, judged natively by
    one window a listing against the last one kept in ``last``; ``suppressed`` is the same rule on Spark's own state.

    ``write_changed`` comes first and must know repeated batches; what was kept last is told by the batch alone.
    """
    kept = ["listing_id", "observed_at", "id", "price", "currency", "in_stock"]
    remember = upsert_batches(last, kept[:1], kept[1:])
    w = Window.partitionBy("listing_id").orderBy(F.col("_old").desc(), "observed_at", "id")

    def write(batch: DataFrame, number: int) -> None:
        rows, state = batch.select(*kept).withColumn("_old", F.lit(False)), last.state()
        if state["schema"] is not None:
            rows = rows.unionByName(last.read(state=state).select(*kept).withColumn("_old", F.lit(True)))
        pairs = [x for c in kept[3:] for x in (F.col(c), F.lag(c).over(w))]
        write_changed(rows.withColumn("_same", unchanged(*pairs)).where("not _old and not _same").select(*kept), number)
        remember(batch.select(*kept), number)

    return write


def batch_streaks(attempts: DataFrame) -> DataFrame:
    """Each listing of a batch (listing_id, id, created_at, ok): its failures since its last success there, and whether it had one."""
    last = F.max(F.when(F.col("ok"), F.struct("created_at", "id"))).over(Window.partitionBy("listing_id"))
    after = F.coalesce(F.struct("created_at", "id") > F.col("last"), F.lit(True))
    return attempts.withColumn("last", last).groupBy("listing_id").agg(F.count_if(after).alias("failed"), F.max(F.col("last").isNotNull()).alias("reset"))


def streak_batches(store: Snapshots, partitions: int = 64):
    """A foreachBatch function: each listing's current failures in a row, and whether they deactivate it (listing_id, streak,
    deactivated), go on from what is stored. Batches are aggregated natively, so a listing costs a row and no call of its own.

    Parts and ledger are as in ``upsert_batches``.
    """
    part = F.pmod(F.xxhash64("listing_id"), F.lit(partitions))

    def write(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, store.state()
        if number <= state["ledger"].get("batch", -1):
            return
        with folders.passing_folder(spark, "batch") as path:
            batch_streaks(batch).withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
            touched = [n.partition("=")[2] for n in folders.names(spark, path) if n.startswith("_part=")]
            new = spark.read.schema("listing_id long, failed long, reset boolean").parquet(path).select("listing_id", "failed", "reset")
            if state["schema"] is not None:
                stored = store.read(touched, state).select("listing_id", F.col("streak").alias("failed"), F.lit(None).cast("boolean").alias("reset"))
                new = new.unionByName(stored)
            own, reset = F.sum(F.when(F.col("reset").isNotNull(), F.col("failed"))), F.coalesce(F.max("reset"), F.lit(False))
            rows = new.groupBy("listing_id").agg(F.when(reset, own).otherwise(F.sum("failed")).alias("streak"))
            store.replace_parts(rows.withColumn("deactivated", F.col("streak") >= DEACTIVATE_AFTER), part, ledger={"batch": number})

    return write

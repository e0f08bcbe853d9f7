"""Writes in sets: appends, upserts by key, insert-if-absent, retention, partitions ahead; stored tables are ``Snapshots``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.sources.snapshots import Snapshots

#: Days that rows of each log are kept.
RETENTION_DAYS = {"scrape_logs": 30, "api_logs": 60, "chat_messages": 365, "alert_events": 180}
#: Fixed value: months whose partitions are there before their first row.
MONTHS_AHEAD = 3
#: The partition of rows whose month has none.
DEFAULT_MONTH = -1


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def refreshed(df: DataFrame, path: str) -> DataFrame:
    """A stored summary replaced as a whole by new rows, and read back. Readers see the old rows until the new ones are all there."""
    return Snapshots(df.sparkSession, path).replace(df)


def truncated(stores: dict[str, Snapshots]) -> dict[str, int]:
    """Stored tables without their rows from now on; returns how many each had."""
    before = {}
    for name, store in stores.items():
        state = store.state()
        rows = store.read(state=state)
        before[name] = rows.count()
        store.replace(rows.limit(0))
    return before


def month_of(column: str) -> Column:
    """The part of a row's month, yyyyMM."""
    return F.date_format(column, "yyyyMM")


def delete_older(store: Snapshots, column: str, oldest: datetime.datetime) -> int:
    """Delete from a store with parts by ``month_of`` what is older; returns how many rows. Whole months are dropped without reading
    their rows; only the month of the limit is written anew. Rows without a time stay."""
    state = store.state()
    limit = f"{oldest:%Y%m}"
    months = [p for p in state["parts"] if p.isdigit()]
    gone = [p for p in months if p < limit]
    deleted = store.read(gone, state).count()
    edge = store.read([p for p in months if p == limit], state)
    young = F.col(column) >= F.lit(oldest).cast(edge.schema[column].dataType)
    old = edge.where(~young).count()
    if gone or old:
        store.replace_parts(edge.where(young), month_of(column), emptied=[*gone, limit])
    return deleted + old


def changed_keys(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The keys of rows that an update gave other values."""
    renamed = after.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return before.join(renamed, key).where(~same).select(key)


def replaced_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones whose keys they don't have."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def one_per_key(df: DataFrame, keys: list[str], last: list[str] = []) -> DataFrame:
    """One row for each key: that with the greatest ``last``, then the greatest other values, so that the choice is the same each time."""
    others = [*last, *[c for c in df.columns if c not in keys and c not in last]]
    if not others:
        return df.distinct()
    chosen = df.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def inserted_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(unseen(new, existing, *keys))


def unseen(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """New rows whose key isn't stored, one a key."""
    return one_per_key(new, list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def replace_stored(store: Snapshots, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the keys of ``new`` give way to its rows, in one write; returns the table."""
    return store.replace(replaced_by_key(store.read(), new, keys))


def insert_stored(store: Snapshots, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored are added; returns the table."""
    return store.append(unseen(new, store.read(), *keys))


def updated_where(df: DataFrame, condition: F.Column, changes: dict[str, F.Column]) -> DataFrame:
    """Rows that meet the condition with changed columns; the others as they are."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def _months_after(date_id: int, n: int) -> int:
    """yyyyMM of the n-th month after that of a date_id."""
    year, month = divmod(date_id // 100 // 100 * 12 + date_id // 100 % 100 - 1 + n, 12)
    return year * 100 + month + 1


class MonthlyTable:
    """A catalog table with a partition for each month of ``date_id``, and one for rows of months that have none."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def create(self, like: DataFrame, path: str) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, month_id INT) USING parquet PARTITIONED BY (month_id) LOCATION '{path}'")
        self._add([DEFAULT_MONTH])

    def _add(self, months: list[int]) -> None:
        parts = " ".join(f"PARTITION (month_id = {m})" for m in months)
        self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {parts}")

    def months(self) -> list[int]:
        return sorted(int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def ensure(self, first: int, today: int) -> None:
        """Partitions from a date_id's month to so many months after today's; those that are there stay."""
        last = _months_after(today, MONTHS_AHEAD)
        months = [_months_after(first, n) for n in range((last // 100 - first // 10000) * 12 + last % 100 - first // 100 % 100 + 1)]
        self._add(months)

    def insert(self, df: DataFrame) -> None:
        """Append rows to the partitions of their months."""
        month = F.floor(F.col("date_id") / 100).cast("int")
        known = month.isin(self.months())
        rows = df.withColumn("month_id", F.when(known, month).otherwise(DEFAULT_MONTH))
        rows.repartition("month_id", F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.insertInto(self.name)

    def partitions(self) -> DataFrame:
        """month_id, starts and ends (date_ids, the end excluded; null for the default partition), n rows."""
        counts = {r["month_id"]: r["n"] for r in self.spark.table(self.name).groupBy("month_id").agg(F.count("*").alias("n")).collect()}
        bounds = [(m, None if m == DEFAULT_MONTH else m * 100 + 1, None if m == DEFAULT_MONTH else _months_after(m * 100, 1) * 100 + 1, counts.get(m, 0)) for m in self.months()]
        return self.spark.createDataFrame(bounds, "month_id int, starts int, ends int, n long")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def invalid_rows(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows with a value outside its column's vocabulary; null is none."""
    bad = F.lit(False)
    for column, values in allowed.items():
        bad = bad | F.coalesce(~F.col(column).isin(*values), F.lit(False))
    return df.where(bad)

"""A stored list read as a stream: a Python data source with row offsets that stops at a deadline, and the saving of its batches.

The list is written in order, in files of any number; an offset is a row of the list. Each micro-batch has so many rows, whatever
the files' sizes, and is planned as slices of the files that hold them. When the deadline has passed no further batch is offered:
the one that runs is saved, and the ledger of the target says where a later run goes on.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from marketgrain.sources import folders, sinks
from marketgrain.sources.snapshots import Snapshots

#: The column with a row's place in the list.
PLACE = "place"
#: Rows that one task reads.
TASK_ROWS = 100_000


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[len("file:") :])


@dataclass
class Slice(InputPartition):
    """Rows of one file; ``place`` is that of the first in the list."""

    path: str
    first: int
    rows: int
    place: int


class ListReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options["rows"])
        self.start, self.deadline = int(options.get("start", 0)), float(options.get("deadline", "inf"))
        fs, root = _file_system(self.path)
        from pyarrow.fs import FileSelector

        found = sorted(i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name.endswith(".parquet"))
        self.files = [(p, pq.ParquetFile(fs.open_input_file(p)).metadata.num_rows) for p in found]
        self.total = sum(n for _, n in self.files)
        self.last = None

    def initialOffset(self) -> dict:
        return {"row": min(self.start, self.total)}

    def latestOffset(self) -> dict:
        """The end of the next batch. The first one is always offered, further ones until the deadline."""
        if self.last is None:
            self.last = min(self.start, self.total)
        elif time.time() >= self.deadline:
            return {"row": self.last}
        self.last = min(self.last + self.size, self.total)
        return {"row": self.last}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        found, at = [], 0
        for path, n in self.files:
            first, stop = max(start["row"], at), min(end["row"], at + n)
            found += [Slice(path, i - at, min(TASK_ROWS, stop - i), i) for i in range(first, stop, TASK_ROWS)]
            at += n
        return found

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            file, at = pq.ParquetFile(f), 0
            stop = partition.first + partition.rows
            for k in range(file.num_row_groups):
                n = file.metadata.row_group(k).num_rows
                first, end = max(partition.first, at), min(stop, at + n)
                if first < end:
                    rows = file.read_row_group(k).slice(first - at, end - first)
                    place = pa.array(range(partition.place + first - partition.first, partition.place + end - partition.first), pa.int64())
                    yield from rows.append_column(PLACE, place).combine_chunks().to_batches()
                at += n


class ListSource(DataSource):
    """``spark.readStream.format("stored_list")``; options: path, rows, start, deadline (epoch seconds)."""

    @classmethod
    def name(cls) -> str:
        return "stored_list"

    def streamReader(self, schema) -> ListReader:
        return ListReader({k.lower(): v for k, v in self.options.items()})


def stored_list(df: DataFrame, order: str, folder: str, files: int = 8) -> DataFrame:
    """``df`` written in the order of a column; returns it as it is stored."""
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def save_in_batches(spark: SparkSession, stored: DataFrame, folder: str, store: Snapshots, key: str, rows: int, deadline: float = float("inf")) -> tuple[int, int, bool]:
    """Save a list's rows whose key isn't stored, from where the last run stopped, ``rows`` of the list at once.

    Returns how many are new, the offset at which a later run goes on, and whether time ran out before the end. A batch's rows
    and the offset after it appear in one step, so a batch that is repeated after a failure saves nothing twice.
    """
    spark.dataSource.register(ListSource)
    before = store.ledger()
    start = before.get("offset", 0)

    def save(batch: DataFrame, number: int) -> None:
        known = store.state()
        from_ = known["ledger"].get("offset", 0)
        fresh = batch.where(F.col(PLACE) >= from_)
        end = fresh.agg(F.max(PLACE)).first()[0]
        if end is None:
            return
        new = sinks.one_per_key(fresh.drop(PLACE), [key])
        if known["schema"] is not None:
            new = new.join(store.read(state=known).select(key), key, "left_anti")
        with folders.passing_folder(spark, "new") as path:
            new.select(*stored.columns).write.parquet(path)
            ready = spark.read.schema(stored.schema).parquet(path)
            store.append(ready, ledger={"offset": end + 1, "saved": known["ledger"].get("saved", 0) + ready.count()})

    schema = StructType([*stored.schema.fields, StructField(PLACE, LongType())])
    source = spark.readStream.format("stored_list").schema(schema).option("path", folder).option("rows", rows).option("start", start).option("deadline", deadline).load()
    with folders.passing_folder(spark, "offsets") as checkpoint:
        run = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    after = store.ledger()
    offset = after.get("offset", start)
    return after.get("saved", 0) - before.get("saved", 0), offset, offset < stored.count()

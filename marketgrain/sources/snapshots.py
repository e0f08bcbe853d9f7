"""Stored tables as snapshots: folders of data that are never changed, and numbered pointers that say which of them count.

A write puts its data into a folder of its own and then adds the next pointer, a small file that appears whole. So a reader
sees the table before a write or after it, never between; a frame that was opened before still reads what it was opened
on; a write that fails leaves the table as it was; and of two writers that start from one state the later one fails.
Old data stays until ``vacuum``.

A table may have parts, by the value of an expression; a write may replace some parts and leave the files of others where they
are. A pointer names the folders of each part, so it grows with the number of parts. Its ``ledger`` keeps what a
stream or a job must know of its own last write, and is swapped with the data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketgrain.sources import folders

_POINTER = "_pointer-"
_PART = "_part"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _newest(self) -> int:
        """The last pointer's number; 0 if nothing was written."""
        return max((int(n[len(_POINTER) :]) for n in folders.names(self.spark, self.path) if n.startswith(_POINTER) and n[len(_POINTER) :].isdigit()), default=0)

    def state(self) -> dict:
        """version, schema, parts (the folders of each part's data), ledger."""
        version = self._newest()
        if not version:
            return {"version": 0, "schema": None, "parts": {}, "ledger": {}}
        return json.loads(folders.read_text(self.spark, f"{self.path}/{_POINTER}{version}"))

    def ledger(self) -> dict:
        return self.state()["ledger"]

    def read(self, parts: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """The table as it is now, or some of its parts."""
        state = state or self.state()
        if state["schema"] is None:
            raise ValueError(f"nothing is stored in {self.path}")
        schema = StructType.fromJson(state["schema"])
        wanted = [f for p, found in state["parts"].items() if parts is None or p in parts for f in found]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in wanted])

    def _written(self, df: DataFrame, part: Column | None) -> dict[str, list[str]]:
        """The rows in a new folder; the folders of their parts."""
        folder = f"data-{uuid.uuid4().hex}"
        to = f"{self.path}/{folder}"
        if part is None:
            df.write.parquet(to)
            return {"": [folder]}
        # a part's rows meet first: else every task leaves a file in every part
        df.withColumn(_PART, part).hint("rebalance", _PART).write.partitionBy(_PART).parquet(to)
        inside = [n for n in folders.names(self.spark, to) if n.startswith(f"{_PART}=")]
        return {n[len(_PART) + 1 :]: [f"{folder}/{n}"] for n in inside}

    def _swap(self, before: dict, parts: dict[str, list[str]], schema: dict, ledger: dict | None) -> None:
        after = {"version": before["version"] + 1, "schema": schema, "parts": parts, "ledger": before["ledger"] | (ledger or {})}
        folders.put_text(self.spark, f"{self.path}/{_POINTER}{after['version']}", json.dumps(after))

    def replace(self, df: DataFrame, part: Column | None = None, ledger: dict | None = None) -> DataFrame:
        """The table's rows are those of ``df`` from now on. Returns the table."""
        before = self.state()
        self._swap(before, self._written(df, part), json.loads(df.schema.json()), ledger)
        return self.read()

    def replace_parts(self, df: DataFrame, part: Column, ledger: dict | None = None, emptied: list[str] = []) -> DataFrame:
        """Parts that ``df`` has rows of have these rows only, parts named in ``emptied`` no others; the rest stays where it is."""
        before = self.state()
        kept = {p: f for p, f in before["parts"].items() if p not in emptied}
        self._swap(before, kept | self._written(df, part), before["schema"] or json.loads(df.schema.json()), ledger)
        return self.read()

    def append(self, df: DataFrame, part: Column | None = None, ledger: dict | None = None) -> DataFrame:
        """The rows of ``df`` beside what is stored."""
        before, parts = self.state(), {}
        for found in (before["parts"], self._written(df, part)):
            for p, f in found.items():
                parts[p] = parts.get(p, []) + f
        self._swap(before, parts, before["schema"] or json.loads(df.schema.json()), ledger)
        return self.read()

    def vacuum(self) -> None:
        """Delete the data that no reader of the newest state needs, and old pointers."""
        state = self.state()
        wanted = {f.partition("/")[0] for found in state["parts"].values() for f in found}
        for name in folders.names(self.spark, self.path):
            old = name.startswith(_POINTER) and name != f"{_POINTER}{state['version']}"
            if old or name.startswith("data-") and name not in wanted:
                folders.remove(self.spark, f"{self.path}/{name}")


def same_parts(part: Column) -> Column:
    """How a part's value is named: as the pointer names it."""
    return F.coalesce(part.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))

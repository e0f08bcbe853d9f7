"""The folder that driver and executors share, for tables that queries write and read back, and what is done with files there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="marketgrain-")
        spark.conf.set("spark.checkpoint.dir", known)
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, in order; none if it isn't there."""
    files, place = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


@contextmanager
def passing_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder that is deleted on leaving."""
    path = fresh_folder(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _place(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that appears whole. Raises a FileExistsError if there is one of its name."""
    files, place = _place(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(place) or not files.rename(staged, place):
        files.delete(staged, False)
        raise FileExistsError(path)

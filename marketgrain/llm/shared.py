"""Where stages keep what they cut off: the folder that driver and executors share; and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in so many of a table's rows is hot, so there are fewer hot keys than this; and it has more rows than that.
HOT_KEYS = 2_000
LEAST_HOT_ROWS = 64

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        known = "file://" + tempfile.mkdtemp(prefix="marketgrain-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor then costs a reread, not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """On leaving, also by an exception, the folders that were written inside are deleted."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            remove(spark, path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """What ``make`` returns, written to ``path``; the folders that it wrote on the way are deleted, and on an exception this one too."""
    try:
        with cleared(spark):
            df = make()
            df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        remove(spark, path)
        raise
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """As ``settle``, in a new folder."""
    return settle(spark, make, fresh_path(spark, name))


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, of few rows a key, on ``key``; rows of a hot key are dealt over tasks by ``by``.

    ``counts`` (key, n) may tell how many rows of ``big`` each key has, ``total`` how many it has in all. Fewer than
    HOT_KEYS keys are hot, by their share of all rows; the plan holds their hashes, and ``small`` repeats their rows once
    a task, some 2 * HOT_KEYS in all. Written tables only: hot keys are counted before.
    """
    n = big.count() if total is None else total
    least = max(LEAST_HOT_ROWS, n // HOT_KEYS)
    counts = counts if counts is not None else big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hashed, by_parts = F.xxhash64(key), {2: [0]}
    for r in counts.where(F.col("n") > least).select(hashed.alias("h"), "n").collect():
        by_parts.setdefault(1 << (-(-r["n"] // least) - 1).bit_length(), []).append(r["h"])
    parts = F.lit(1)
    for number, hashes in by_parts.items():
        parts = F.when(hashed.isin(hashes), number).otherwise(parts)
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    return dealt.join(small.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [key, "_part"], how).drop("_part")


def with_carry(docs: DataFrame, id_column: str, text_column: str, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, text and carry, a struct of the columns named; text is null where carry holds it, see ``textarrays.text_of``."""
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    text = F.lit(None).cast("string") if text_column in carry else F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), carried.alias("carry"))


def file_system(uri: str):
    """pyarrow's file system for ``uri`` and the path in it; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)

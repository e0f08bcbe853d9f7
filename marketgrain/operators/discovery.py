"""Category discovery: a breadth-first crawl over parsed pages, level by level, that can be stopped and taken up again.

Hubs and pages of unknown role lead on, listings are collected and lead on above the last depth, products lead nowhere. Each
level's queue and what was read of it are written before the next one begins, so a stop or a lost executor costs one level at
most. Sites share levels: all their queues are read in one join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.sources import folders

#: How deep pages are read, and the paths that are tried where no listing was found.
DEPTH = 3
FALLBACKS = ("/catalog", "/categories", "/shop", "/store", "/all")


class Recon:
    """A crawl's state in a folder: ``queue-k`` (site, url) of level k, ``read-k`` (site, url, role; null: no page)."""

    def __init__(self, roots: DataFrame, pages: DataFrame, links: DataFrame, folder: str):
        """``roots``: site, url; ``pages``: url, role, one row a url; ``links``: url, link (a page's own site only)."""
        self.spark, self.roots, self.pages, self.links, self.folder = roots.sparkSession, roots.select("site", "url"), pages, links, folder.rstrip("/")

    def _has(self, name: str) -> bool:
        return folders.exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def _all(self, kind: str, last: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(f"{kind}-{k}").withColumn("depth", F.lit(k)) for k in range(last + 1)])

    def queued(self) -> int | None:
        """The level that would be read next; None if nothing is kept."""
        level = max((k for k in range(DEPTH + 2) if self._has(f"queue-{k}")), default=None)
        return level

    def listings(self, last: int) -> DataFrame:
        """Listings read so far: site, url, depth. A site's root isn't one."""
        if last < 0:
            return self.roots.limit(0).withColumn("depth", F.lit(0))
        found = self._all("read", last).where("role = 'listing'")
        return found.join(self.roots, ["site", "url"], "left_anti").select("site", "url", "depth")

    def _level(self, k: int) -> None:
        if not self._has(f"read-{k}"):
            self._write(self._read(f"queue-{k}").join(self.pages, "url", "left").select("site", "url", "role"), f"read-{k}")
        leads = F.col("role").isin("hub", "unknown") | ((F.col("role") == "listing") & F.lit(k < DEPTH))
        found = self._read(f"read-{k}").where(leads).join(self.links, "url").select("site", F.col("link").alias("url")).distinct()
        self._write(found.join(self._all("queue", k).drop("depth"), ["site", "url"], "left_anti"), f"queue-{k + 1}")

    def _fallbacks(self) -> DataFrame:
        """Pages at the usual paths of sites without a listing: listings and hubs that weren't queued before."""
        bare = self.roots.join(self.listings(DEPTH).select("site"), "site", "left_anti")
        tried = bare.select("site", F.explode(F.array(*[F.concat(F.regexp_replace("url", "/+$", ""), F.lit(p)) for p in FALLBACKS])).alias("url"))
        fresh = tried.join(self._all("queue", DEPTH + 1).drop("depth"), ["site", "url"], "left_anti")
        return fresh.join(self.pages, "url").where(F.col("role").isin("listing", "hub")).select("site", "url", F.lit(None).cast("int").alias("depth"))

    def run(self, stop: Callable[[int], bool] = lambda level: False) -> tuple[DataFrame, bool]:
        """Returns the listings (site, url, depth; null for a usual path) and whether the crawl was stopped first.

        ``stop`` is asked before each level is read. A stopped crawl leaves its state, from which the next run goes on; one that
        ended leaves only its result, and the next run begins anew.
        """
        at = self.queued()
        if at is None:
            at = 0
            self._write(self.roots.distinct(), "queue-0")
        for k in range(at, DEPTH + 1):
            if stop(k):
                return self.listings(k - 1), True
            self._level(k)
        self._write(self.listings(DEPTH).unionByName(self._fallbacks()), "listings")
        for k in range(DEPTH + 2):
            for kind in ("queue", "read"):
                folders.remove(self.spark, f"{self.folder}/{kind}-{k}")
        return self._read("listings"), False

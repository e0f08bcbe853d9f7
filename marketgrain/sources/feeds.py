"""Provider feeds as rows: JSON and XML payloads in, normalised records out; bad rows are dropped, never raised."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from marketgrain.sources.folders import fresh_folder, remove

#: Where sitemaps are looked for besides what robots.txt names.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")


def forex_feed(payloads: DataFrame, *keys: str) -> DataFrame:
    """``{"base": ..., "rates": {code: rate}}`` in column ``body``: pair, bid, ask (bid + 0.0001), spread, after the columns ``keys``."""
    parsed = payloads.select(*keys, F.from_json("body", "base string, rates map<string,string>").alias("p"))
    rows = parsed.select(*keys, F.col("p.base").alias("base"), F.explode("p.rates").alias("code", "text"))
    rate = F.col("text").try_cast("double")
    return rows.where(rate > 0).select(*keys, F.concat("base", F.lit("/"), "code").alias("pair"), rate.alias("bid"), (rate + 0.0001).alias("ask"), F.lit(0.0001).alias("spread"))


def base_rates(feed: DataFrame, base: str, *keys: str) -> DataFrame:
    return feed.where(F.col("pair").startswith(base + "/")).select(*keys, "pair", (F.floor(F.col("bid") * 1e6 + 0.5) / 1e6).alias("rate"))


def first_filled(sources: list[DataFrame], least: int = 1) -> DataFrame:
    """The rows of the first source that has ``least`` of them; a last one counts however many it has.

    Sources are tried one after another, each up to ``least`` rows; those after the first that has enough aren't read.
    """
    for source in sources[:-1]:
        if source.limit(least).count() >= least:
            return source
    return sources[-1]


def crypto_ticker(payloads: DataFrame, top: int = 50) -> DataFrame:
    """An exchange's pairs against USDT by volume: symbol without USDT, price, volume."""
    rows = payloads.select(F.explode(F.from_json("body", "array<struct<symbol:string,lastPrice:string,quoteVolume:string>>")).alias("r")).select("r.*")
    volume, price = F.col("quoteVolume").try_cast("double"), F.col("lastPrice").try_cast("double")
    kept = rows.where(F.col("symbol").endswith("USDT") & (volume > 0) & price.isNotNull())
    return kept.select(F.replace("symbol", F.lit("USDT"), F.lit("")).alias("symbol"), price.alias("price"), volume.alias("volume")).orderBy(F.col("volume").desc(), "symbol").limit(top)


def crypto_markets(payloads: DataFrame, *keys: str) -> DataFrame:
    """Coins of a market list: symbol, price, market_cap, change_24h, after the payload's own columns ``keys``."""
    coins = F.from_json("body", "array<struct<symbol:string,current_price:double,market_cap:double,price_change_percentage_24h:double>>")
    rows = payloads.select(*keys, F.explode(coins).alias("r")).select(*keys, "r.*")
    return rows.where("symbol is not null and current_price is not null").select(*keys, F.upper("symbol").alias("symbol"), F.col("current_price").alias("price"), "market_cap", F.col("price_change_percentage_24h").alias("change_24h"))


def metals(payloads: DataFrame) -> DataFrame:
    """symbol, price (else close), change (chp else change_24h)."""
    get = lambda path: F.get_json_object("body", f"$.{path}").try_cast("double")
    return payloads.select("symbol", F.coalesce(get("price"), get("close")).alias("price"), F.coalesce(get("chp"), get("change_24h")).alias("change_pct")).where("price is not null")


def energy(payloads: DataFrame) -> DataFrame:
    """The latest of two values, and its change from the one before; null without one or from zero."""
    data = F.from_json("body", "data array<struct<value:string>>")["data"]
    latest, before = F.get(data, F.lit(0))["value"].try_cast("double"), F.get(data, F.lit(1))["value"].try_cast("double")
    return payloads.select("symbol", latest.alias("price"), F.when(before != 0, (latest - before) / before * 100).alias("change_pct")).where("price is not null")


def fuel_feed(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(F.explode(F.from_json("body", "array<struct<symbol:string,price:string,unit:string>>")).alias("r")).select("r.*")
    return rows.select(F.substring("symbol", 1, 20).alias("symbol"), F.col("price").try_cast("double").alias("price"), F.substring("unit", 1, 20).alias("unit")).where("price is not null")


def looks_like_sitemap(body: Column) -> Column:
    return F.lower(F.substring(body, 1, 800)).rlike(r"<(urlset|sitemapindex)|<\?xml")


def _locations(xml: str | None) -> dict[str, list[str]]:
    from xml.etree import ElementTree

    found: dict[str, list[str]] = {"urls": [], "sitemaps": []}
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return found
    local = lambda e: e.tag.rpartition("}")[2].lower()
    for entry in root.iter():
        kind = {"url": "urls", "sitemap": "sitemaps"}.get(local(entry))
        if kind:
            found[kind] += [c.text.strip() for c in entry if local(c) == "loc" and c.text and c.text.strip()]
    return found


@F.pandas_udf(StructType([StructField(n, ArrayType(StringType())) for n in ("urls", "sitemaps")]))
def sitemap_locations(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A sitemap's or an index's locations in any namespace; malformed XML has none."""
    for b in bodies:
        yield pd.DataFrame([_locations(x) for x in b], columns=["urls", "sitemaps"])


def robots_roots(robots: DataFrame) -> DataFrame:
    """Where each site's sitemaps may be (``site``, its base URL, and the ``body`` of its robots.txt or null): the addresses after ``sitemap:`` in
    the order of their lines, then the usual paths. Returns site, url, place; lines that name nothing are passed over."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, r"[\t\x0B\f]", " ")))
    named = F.filter(F.transform(F.filter(lines, lambda line: F.lower(line).startswith("sitemap:")), lambda line: F.trim(F.substring(line, 9, 1 << 30))), lambda u: u != "")
    # a path from the root replaces the base's own path
    host = F.regexp_extract("site", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    usual = F.array(*[F.concat(host, F.lit(p)) for p in SITEMAP_PATHS])
    every = F.concat(named, F.filter(usual, lambda u: ~F.array_contains(named, u)))
    return robots.select("site", F.posexplode(every).alias("place", "url")).select("site", "url", "place")


def sitemap_walk(files: DataFrame, roots: DataFrame, most_files: int | None = 15, most_urls: int | None = 50_000) -> DataFrame:
    """The URLs that each site's sitemaps list, over stored files (``url``, ``body``): breadth first from its roots (``site``, ``url``, ``place``).

    Files are parsed once and written. Those named in one file come in its order, after all that were named before; each is visited
    once. A site's visits, of files that aren't stored too, end with ``most_files`` of them, its URLs with ``most_urls``, repeats counted; None
    lifts a limit. Returns site, url, each once.
    """
    spark, folder = files.sparkSession, fresh_folder(files.sparkSession, "sitemaps")
    files.where(looks_like_sitemap(F.col("body"))).select("url", sitemap_locations("body").alias("x")).select("url", "x.urls", "x.sitemaps").write.parquet(f"{folder}/parsed")
    parsed = spark.read.parquet(f"{folder}/parsed")
    named, level = roots.select("site", "url", F.array("place").alias("path")), 0
    visited: list[DataFrame] = []
    while True:
        # a file that is named several times counts where it is named first
        fresh = named.groupBy("site", "url").agg(F.min("path").alias("path"))
        if visited:
            before = reduce(DataFrame.unionByName, visited)
            fresh = fresh.join(before.select("site", "url"), ["site", "url"], "left_anti")
        if most_files is not None:
            used = before.groupBy("site").agg(F.count("*").alias("used")) if visited else fresh.select("site").distinct().withColumn("used", F.lit(0))
            place = F.row_number().over(Window.partitionBy("site").orderBy("path"))
            fresh = fresh.withColumn("nth", place).where(F.col("nth") <= most_files).join(used, "site").where(F.col("nth") + F.col("used") <= most_files).drop("nth", "used")
        fresh.write.parquet(f"{folder}/level-{level}")
        now = spark.read.parquet(f"{folder}/level-{level}")
        if now.isEmpty():
            break
        visited.append(now.withColumn("level", F.lit(level)))
        named = now.join(parsed, "url").select("site", "path", F.posexplode("sitemaps").alias("at", "url")).select("site", "url", F.concat("path", F.array("at")).alias("path"))
        level += 1
    if not visited:
        return roots.select("site", "url").limit(0)
    listed = reduce(DataFrame.unionByName, visited).join(parsed, "url").select("site", "level", "path", F.posexplode("urls").alias("at", "url"))
    if most_urls is not None:
        nth = F.row_number().over(Window.partitionBy("site").orderBy("level", "path", "at"))
        listed = listed.withColumn("nth", nth).where(F.col("nth") <= most_urls)
    listed.select("site", "url").distinct().write.parquet(f"{folder}/urls")
    for name in ("parsed", *(f"level-{k}" for k in range(level + 1))):
        remove(spark, f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/urls")

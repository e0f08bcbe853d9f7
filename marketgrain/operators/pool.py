"""The product pool: star join, filters, sorts, pages, histories and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.numbers import change_pct
from marketgrain.sources.star import Star

#: Countries shown to privileged users only.
BLOCKED_COUNTRIES = ("RU", "BY")
HISTORY_POINTS = 14


def with_changes(prices: DataFrame) -> DataFrame:
    """Each price row with the earlier price of its listing and the change from it."""
    prev = F.lag("price").over(Window.partitionBy("listing_id").orderBy("date_id"))
    return prices.withColumn("prev", prev).withColumn("change_pct", change_pct(F.col("price"), F.col("prev")))


def latest_changes(prices: DataFrame) -> DataFrame:
    """The newest row of each listing."""
    newest = with_changes(prices).groupBy("listing_id").agg(F.max(F.struct("date_id", "change_pct", "price")).alias("x"))
    return newest.select("listing_id", "x.date_id", "x.change_pct", "x.price")


def priced(star: Star) -> DataFrame:
    """id, price and currency of the pool's rows, without the histories that changes need."""
    listings = star.listings().where(F.col("is_active").eqNullSafe(True))
    known = listings.join(star.products().select("product_id"), "product_id", "left_semi").join(F.broadcast(star.marketplaces().select("marketplace_id")), "marketplace_id", "left_semi")
    return known.select(F.col("listing_id").alias("id"), F.col("last_price").cast("double").alias("price"), F.col("last_currency_code").alias("currency"))


def pool(star: Star, only_active: bool = True) -> DataFrame:
    """Listings with product, marketplace and latest change under their public names. Dimensions are joined by size."""
    listings = star.listings()
    if only_active:
        listings = listings.where(F.col("is_active").eqNullSafe(True))
    joined = listings.join(star.products(), "product_id").join(F.broadcast(star.marketplaces().drop("is_active")), "marketplace_id").join(latest_changes(star.prices()).select("listing_id", "change_pct"), "listing_id", "left")
    return joined.select(
        F.col("listing_id").alias("id"),
        "product_id",
        F.col("name").alias("product_name"),
        "category_id",
        "brand_id",
        "image_url",
        "marketplace_id",
        "marketplace_name",
        "domain",
        "marketplace_code",
        "country_code",
        F.col("last_price").cast("double").alias("price"),
        F.col("last_currency_code").alias("currency"),
        F.col("last_in_stock").alias("in_stock"),
        "last_checked_at",
        F.col("change_pct").alias("price_change_pct"),
        F.when(F.col("is_active"), "active").otherwise("inactive").alias("status"),
    )


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows whose product name contains the text, ignoring case; % and _ stay wildcards."""
    return df.where(F.col("product_name").ilike(f"%{text}%"))


def of_category(df: DataFrame, text: str) -> DataFrame:
    like = [F.col(c).ilike(f"%{text}%") for c in ("domain", "marketplace_name", "marketplace_code")]
    return df.where(like[0] | like[1] | like[2])


def visible(df: DataFrame, privileged: bool = False) -> DataFrame:
    return df if privileged else df.where(~F.col("country_code").isin(*BLOCKED_COUNTRIES))


def sort_keys(mode: str) -> list[Column]:
    """The order of a named mode, ended by id so that pages are stable; unknown names mean recent."""
    change = F.col("price_change_pct")
    recent = F.col("last_checked_at").desc_nulls_last()
    modes = {
        "recent": recent,
        "trending": recent,
        "name_asc": F.col("product_name").asc_nulls_last(),
        "name_desc": F.col("product_name").desc_nulls_last(),
        "price_asc": F.col("price").asc_nulls_last(),
        "price_desc": F.col("price").desc_nulls_last(),
        "gainers": change.desc_nulls_last(),
        "losers": change.asc_nulls_last(),
        "volatile": F.abs(change).desc_nulls_last(),
    }
    return [modes.get(mode, recent), F.col("id").asc()]


def overview_mode(mode: str) -> str:
    known = ("recent", "trending", "name_asc", "name_desc", "price_asc", "price_desc", "gainers", "losers", "volatile")
    return mode if mode in known else "volatile"


def page(df: DataFrame, mode: str, limit: int, offset: int = 0) -> DataFrame:
    """One page: a top-k sort of what it needs, never a sort of everything written out."""
    return df.orderBy(*sort_keys(mode)).offset(offset).limit(limit)


def numbered_page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 with 1 to 100 rows."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def histories(prices: DataFrame, wanted: DataFrame | None = None, points: int = HISTORY_POINTS) -> DataFrame:
    """Each listing's last points, oldest first: listing_id, history (date_id, price, currency_code)."""
    if wanted is not None:
        prices = prices.join(wanted, "listing_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("listing_id").orderBy(F.col("date_id").desc()))
    last = prices.withColumn("k", rank).where(F.col("k") <= points)
    return last.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("date_id", "price", "currency_code"))).alias("history"))


def categories(df: DataFrame) -> DataFrame:
    return df.groupBy("marketplace_id", "marketplace_name").agg(F.count("*").alias("n"))


def marketplace_stats(listings: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """Active listings and their mean price for each active marketplace, those without listings too."""
    active = F.col("is_active").eqNullSafe(True)
    counts = listings.groupBy("marketplace_id").agg(F.count_if(active).alias("n"), F.sum(F.when(active, F.col("last_price"))).alias("total"), F.count(F.when(active, F.col("last_price"))).alias("priced"))
    joined = marketplaces.where("is_active").join(counts, "marketplace_id", "left")
    mean = F.try_divide(F.col("total").cast("double"), F.col("priced"))
    return joined.select("marketplace_id", "marketplace_name", F.coalesce("n", F.lit(0).cast("long")).alias("active_listings"), (F.floor(mean * 100 + 0.5) / 100).alias("avg_price"))


def kpis(df: DataFrame, now: DataFrame) -> DataFrame:
    """Updated within a day, moved by more than five percent, mean absolute change over all items, last update."""
    change = F.abs(F.coalesce("price_change_pct", F.lit(0.0)))
    timed = df.join(F.broadcast(now))
    return timed.agg(
        F.count_if(F.col("last_checked_at") >= F.col("now") - F.expr("INTERVAL 24 HOURS")).alias("updated_24h"),
        F.count_if(change > 5).alias("moved"),
        (F.floor(F.coalesce(F.avg(change), F.lit(0.0)) * 10000 + 0.5) / 10000).alias("mean_change"),
        F.max("last_checked_at").alias("last_update"),
    )

"""Market-data snapshots: currencies, crypto, commodities and fuel, and the ticker over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.money import newest_first

METALS = ("XAU", "XAG", "XPT", "XPD")


def forex(rates: DataFrame) -> DataFrame:
    return newest_first(rates, ["currency_code"], [F.col("source")])


def crypto(prices: DataFrame) -> DataFrame:
    """The newest snapshot's best rank for each symbol; no rank counts as 9999."""
    return newest_first(prices, ["symbol"], [F.coalesce("rank", F.lit(9999)), F.col("source")])


def commodities(prices: DataFrame) -> DataFrame:
    return newest_first(prices, ["symbol"], [F.col("source")])


def fuel(prices: DataFrame) -> DataFrame:
    """The rows of each country's newest date."""
    top = F.max("date_id").over(Window.partitionBy("country_code"))
    return prices.withColumn("_top", top).where(F.col("date_id") == F.col("_top")).drop("_top")


def fuel_pivot(prices: DataFrame, types: list[str]) -> DataFrame:
    return fuel(prices).groupBy("country_code").pivot("fuel_type", types).agg(F.min("price"))


def forex_quotes(rates: DataFrame) -> DataFrame:
    """Units per EUR with six decimals; EUR itself is left out."""
    rate = F.col("rate_to_eur").cast("double")
    quote = F.floor(F.when(rate > 0, 1 / rate).otherwise(rate) * 1e6 + 0.5) / 1e6
    return forex(rates).where("currency_code <> 'EUR'").select("currency_code", quote.alias("bid"), quote.alias("ask"), F.lit(0.0).alias("spread"))


def commodity_kind(symbol) -> F.Column:
    return F.when(F.upper(symbol).isin(*METALS), "metal").otherwise("energy")


def ticker(rates: DataFrame, coins: DataFrame, goods: DataFrame, fuels: DataFrame, favourites: list[str] | None = None, top: int = 5) -> DataFrame:
    """One row an instrument: type, symbol, value. The first coins are cut before favourites are looked at."""
    rows = forex_quotes(rates).select(F.lit("forex").alias("type"), F.col("currency_code").alias("symbol"), F.col("bid").alias("value"))
    best = crypto(coins).orderBy(F.coalesce("rank", F.lit(9999)).asc(), "symbol").limit(top)
    rows = rows.unionByName(best.select(F.lit("crypto").alias("type"), "symbol", F.col("price").cast("double").alias("value")))
    rows = rows.unionByName(commodities(goods).select(F.lit("commodity").alias("type"), "symbol", F.col("price").cast("double").alias("value")))
    rows = rows.unionByName(fuel(fuels).select(F.lit("fuel").alias("type"), F.col("fuel_type").alias("symbol"), F.col("price").cast("double").alias("value")))
    wanted = {f.strip().upper() for f in favourites or [] if f.strip()}
    return rows.where(F.upper("symbol").isin(*sorted(wanted))) if wanted else rows


def instruments(coins: DataFrame) -> DataFrame:
    """Coins by rank (none counts as 999999), market cap and symbol, numbered."""
    order = Window.orderBy(F.coalesce("rank", F.lit(999999)).asc(), F.col("market_cap").desc_nulls_last(), "symbol")
    return crypto(coins).withColumn("position", F.row_number().over(order))


def merged_preferences(stored, updates) -> F.Column:
    """A map of preferences with the updates' keys that have values."""
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(F.map_filter(updates, lambda a, b: b.isNotNull())), k)), F.map_filter(updates, lambda k, v: v.isNotNull()))

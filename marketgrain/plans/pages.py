"""Whole reads of the pool: a page with its history and display prices as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.functions import money
from marketgrain.operators import pool
from marketgrain.sources.star import Star


def overview(star: Star, mode: str = "gainers", limit: int = 20, offset: int = 0, privileged: bool = False) -> DataFrame:
    """A page of the pool with each row's last points and EUR price. The page is cut before histories are joined, so
    only its listings' rows are gathered."""
    rows = pool.page(pool.visible(pool.pool(star), privileged), mode, limit, offset)
    history = pool.histories(star.prices(), rows.select(F.col("id").alias("listing_id")))
    joined = rows.join(history.withColumnRenamed("listing_id", "id"), "id", "left")
    priced = money.with_factors(joined, money.latest_rates(star.rates()), "currency")
    return priced.withColumn("price_eur", money.rounded(money.converted(F.col("price"), F.col("to_eur")))).drop("to_eur", "to_usd")

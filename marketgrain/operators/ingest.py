"""The quality gate and the suppression of unchanged prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.numbers import change_pct, discount_pct

MAX_RAW_CURRENCY = 50
SAME_PRICE = 0.001


def whitelist(marketplaces: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Each marketplace's allowed currencies: its own, EUR, USD and configured codes of three letters."""
    more = F.array(*[F.lit(c) for c in ("EUR", "USD", *(extra or []))])
    allowed = F.array_sort(F.filter(F.array_distinct(F.concat(F.array("currency_code"), more)), lambda c: F.length(c) == 3))
    return marketplaces.select("marketplace_id", allowed.alias("allowed"))


def gate(rows: DataFrame) -> DataFrame:
    """Add passed, skip_reason and forced_log_status. An empty or missing whitelist allows every currency."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    name, money = ~(blank("product_name") & blank("title")), ~blank("currency")
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    short = F.coalesce(F.length("currency_raw") < MAX_RAW_CURRENCY, F.lit(True))
    listed = F.coalesce(F.size("allowed"), F.lit(0)) <= 0
    allowed = listed | F.coalesce(F.array_contains("allowed", F.col("currency")), F.lit(False))
    reason = F.when(~(name & money), "missing_name_or_currency").when(~priced, "price_not_positive").when(~short, "currency_raw_too_long").when(~allowed, "currency_country_mismatch")
    judged = rows.withColumn("skip_reason", reason)
    forced = F.col("skip_reason").isin("currency_raw_too_long", "currency_country_mismatch")
    return judged.withColumn("passed", F.col("skip_reason").isNull()).withColumn("forced_log_status", F.when(forced, "parse_error"))


def unchanged(price: Column, before: Column, currency: Column, currency_before: Column, stock: Column, stock_before: Column) -> Column:
    """Whether an observation repeats the last one: price, currency and three-valued stock."""
    same = F.abs(price.cast("double") - before.cast("double")) < SAME_PRICE
    return F.coalesce(same & (currency == currency_before) & stock.eqNullSafe(stock_before), F.lit(False))


def ingest(observations: DataFrame) -> DataFrame:
    """Gate passers in time order: success where something changed since the last passer, else no_change."""
    judged = gate(observations)
    w = Window.partitionBy("listing_id").orderBy("observed_at", "id")
    passed = judged.where("passed")
    before = lambda c: F.lag(c).over(w)
    same = unchanged(F.col("price"), before("price"), F.col("currency"), before("currency"), F.col("in_stock"), before("in_stock"))
    kept = passed.withColumn("outcome", F.when(same, "no_change").otherwise("success"))
    return kept.unionByName(judged.where("not passed").withColumn("outcome", F.col("forced_log_status")))


def one_per_day(outcomes: DataFrame) -> DataFrame:
    """The last written observation of each listing and day, with change from the last earlier day and discount."""
    day = F.date_format("observed_at", "yyyyMMdd").cast("int")
    last = outcomes.where("outcome = 'success'").groupBy("listing_id", day.alias("date_id")).agg(F.max(F.struct("observed_at", "id", "price", "original_price")).alias("x"))
    prev = F.lag("price").over(Window.partitionBy("listing_id").orderBy("date_id"))
    rows = last.select("listing_id", "date_id", "x.price", "x.original_price")
    return rows.withColumns({"change_pct": change_pct(F.col("price"), prev), "discount_pct": discount_pct(F.col("original_price"), F.col("price"))})


def enrich_products(products: DataFrame, found: DataFrame) -> DataFrame:
    """Replace a product's name by the title found for it, and set its image where it has none."""
    best = found.groupBy("product_id").agg(F.max(F.struct("observed_at", "title", "found_image")).alias("x")).select("product_id", "x.title", "x.found_image")
    joined = products.join(best, "product_id", "left")
    return joined.withColumns({"name": F.coalesce("title", "name"), "image_url": F.coalesce("image_url", "found_image")}).drop("title", "found_image")

"""Display currency and locale on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Countries of domain suffixes.
TLD_COUNTRY = {
    "md": "MD", "ro": "RO", "bg": "BG", "com.ua": "UA", "ua": "UA", "kz": "KZ", "ee": "EE", "lt": "LT", "lv": "LV", "pl": "PL", "hu": "HU",
    "cz": "CZ", "sk": "SK", "de": "DE", "fr": "FR", "it": "IT", "es": "ES", "uk": "GB", "co.uk": "GB",
}
#: Suffixes that tell no country.
GENERIC_TLDS = ["com", "net", "org", "shop", "store", "biz", "info", "io", "app", "co", "me", "eu"]
#: Currencies of countries.
COUNTRY_CURRENCY = {
    "MD": "MDL", "RO": "RON", "BG": "EUR", "UA": "UAH", "KZ": "KZT", "EE": "EUR", "LT": "EUR", "LV": "EUR", "PL": "PLN", "HU": "HUF",
    "CZ": "CZK", "SK": "EUR", "DE": "EUR", "FR": "EUR", "IT": "EUR", "ES": "EUR", "GB": "GBP",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def display_mode(value: Column) -> Column:
    """EUR or USD if so asked for, else local."""
    v = F.upper(F.trim(value))
    return F.when(v.isin("EUR", "USD"), v).otherwise("local")


def normal_domain(domain: Column) -> Column:
    """The host alone: no scheme, path, port, leading dots or ``www.``."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^(?:https://)?(?:http://)?\.*(?:www\.)?([^/:]*)", 1)


def tld(domain: Column) -> Column:
    """The longest known suffix of the domain: the leftmost one that starts at a label."""
    known = "|".join(suffix.replace(".", r"\.") for suffix in {**TLD_COUNTRY, **dict.fromkeys(GENERIC_TLDS)})
    return F.nullif(F.regexp_extract(normal_domain(domain), rf"(?:^|\.)({known})$", 1), F.lit(""))


def local_currency(domain: Column, country: Column) -> Column:
    """(code, source): the currency of the suffix's country, else of the country code, else unknown."""
    by_tld = lookup(lookup(tld(domain), TLD_COUNTRY), COUNTRY_CURRENCY)
    by_country = lookup(F.upper(F.trim(F.coalesce(country, F.lit("")))), COUNTRY_CURRENCY)
    source = F.when(by_tld.isNotNull(), "tld").when(by_country.isNotNull(), "country_code").otherwise("unknown")
    return F.struct(F.coalesce(by_tld, by_country).alias("code"), source.alias("source"))


def latest_rates(rates: DataFrame) -> DataFrame:
    """The newest date's rates, one row a currency: that of the least source."""
    return newest_first(rates, ["currency_code"], [F.col("source")]).select("currency_code", "rate_to_eur", "rate_to_usd", "source")


def live_rates(quotes: DataFrame) -> DataFrame:
    """Quotes per EUR (currency_code, rate) as one unit's value in EUR and USD."""
    usd = quotes.where("currency_code = 'USD'").agg(F.max("rate").alias("usd"))
    good = quotes.where((F.length("currency_code") == 3) & (F.col("rate") > 0))
    return good.join(F.broadcast(usd)).select("currency_code", (1 / F.col("rate")).alias("rate_to_eur"), (F.col("usd") / F.col("rate")).alias("rate_to_usd"))


def usd_per_eur(rates: DataFrame) -> DataFrame:
    """One row: 1 / USD's value in EUR, or else the ratio of the first other currency's two values."""
    own = F.max(F.when((F.col("currency_code") == "USD") & (F.col("rate_to_eur") > 0), 1 / F.col("rate_to_eur").cast("double")))
    other = F.min_by(F.col("rate_to_usd").cast("double") / F.col("rate_to_eur").cast("double"), F.when(F.col("rate_to_eur") > 0, F.col("currency_code")))
    return rates.agg(F.coalesce(own, other).alias("usd_per_eur"))


def with_factors(df: DataFrame, rates: DataFrame, currency: str) -> DataFrame:
    """Add to_eur, to_usd: what one unit of the column's currency is worth. The rate table has a row a currency and is broadcast."""
    small = rates.select(F.col("currency_code").alias(currency), F.col("rate_to_eur").cast("double").alias("_eur"), F.col("rate_to_usd").cast("double").alias("_usd"))
    per_eur = usd_per_eur(rates)
    joined = df.join(F.broadcast(small), currency, "left").join(F.broadcast(per_eur))
    code = F.col(currency)
    eur = F.when(code == "EUR", 1.0).otherwise(F.col("_eur"))
    usd = F.when(code == "USD", 1.0).when(code == "EUR", F.col("usd_per_eur")).otherwise(F.col("_usd"))
    return joined.withColumns({"to_eur": eur, "to_usd": usd}).drop("_eur", "_usd", "usd_per_eur")


def converted(amount: Column, factor: Column) -> Column:
    """Amount times factor; null if either is missing or the factor isn't positive."""
    return F.when(factor > 0, amount.cast("double") * factor)


def rounded(value: Column, digits: int = 2) -> Column:
    return F.floor(value * 10**digits + 0.5) / 10**digits


def display_price(amount: Column, to_eur: Column, to_usd: Column, currency: Column, local: Column, to_local: Column, mode: Column) -> Column:
    """The shown amount, its currency and whether it is available, by display mode."""
    own = F.struct(amount.cast("double").alias("amount"), currency.alias("currency"), F.lit(False).alias("available"), F.lit(True).alias("local_unavailable"))
    struct = lambda a, c, ok: F.struct(a.cast("double").alias("amount"), c.cast("string").alias("currency"), ok.alias("available"), F.lit(False).alias("local_unavailable"))
    none, yes, no = F.lit(None), F.lit(True), F.lit(False)
    in_local = rounded(converted(converted(amount, to_eur), 1 / to_local))
    locally = (
        F.when(local.isNull(), own)
        .when(amount.isNull(), struct(none, local, no))
        .when(currency.isNull() | (currency == local), struct(amount, local, currency.isNotNull()))
        .when(in_local.isNotNull(), struct(in_local, local, yes))
        .otherwise(struct(none, none, no))
    )
    shown = rounded(converted(amount, F.when(mode == "EUR", to_eur).otherwise(to_usd)))
    abroad = F.when(shown.isNotNull(), struct(shown, mode, yes)).otherwise(struct(none, none, no))
    return F.when(mode == "local", locally).otherwise(abroad)


def client_price(local_amount: Column, local: Column, shown: Column, shown_currency: Column, available: Column, mode: Column) -> Column:
    """Which amount a client shows, and whether a rate was missing."""
    has = F.coalesce(available, F.lit(False)) & shown.isNotNull() & shown_currency.isNotNull()
    struct = lambda a, c, missing: F.struct(a.cast("double").alias("amount"), c.cast("string").alias("currency"), F.lit(missing).alias("no_rate"))
    return (
        F.when(local_amount.isNull(), struct(F.lit(None), F.lit(None), False))
        .when(mode == "local", struct(local_amount, local, False))
        .when(has, struct(shown, shown_currency, False))
        .otherwise(struct(local_amount, local, True))
    )


def marketplace_label(name: Column, domain: Column, country_name: Column) -> Column:
    """A marketplace's name, with its country unless it is an international .com shop."""
    base = F.replace(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.trim(domain), F.lit("")), F.lit("_"), F.lit(" "))
    parts = F.split(normal_domain(domain), r"\.")
    international = F.coalesce((F.size(parts) == 2) & (parts[1] == "com"), F.lit(False))
    return F.when((base == "") | international | country_name.isNull(), base).otherwise(F.concat(base, F.lit(" ("), country_name, F.lit(")")))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ascending order, nulls first; of ties the least. A minimum combines before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *others)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in others]).select(*df.columns)


def newest_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of the newest ``date_id`` one for each key, as ``first_by`` picks it. A key's own newest row is found first; which date is the
    newest of all is then known from these few, so the table is read and shuffled once."""
    own = first_by(df, keys, [-F.col("date_id"), *order])
    return own.join(F.broadcast(own.agg(F.max("date_id").alias("date_id"))), "date_id", "left_semi").select(*df.columns)

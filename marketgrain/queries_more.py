"""Further queries: display currency, market data, ingest rules, lifecycle, documents, sources and sinks, streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions import money, numbers, text, urls
from marketgrain.operators import ingest, lifecycle, market, pool, summaries
from marketgrain.plans import pages as page_plans
from marketgrain.queries import ORACLE_SQL, QUERIES, _round, query
from marketgrain.sources import feeds, sinks
from marketgrain.sources.folders import fresh_folder
from marketgrain.sources.snapshots import Snapshots
from marketgrain.sources.star import Star

_LATEST = "SELECT currency_code, rate_to_eur, rate_to_usd, source FROM (SELECT *, row_number() OVER (PARTITION BY currency_code ORDER BY source) AS k FROM rates WHERE date_id = (SELECT max(date_id) FROM rates)) WHERE k = 1"


def _same(new: str, old: str) -> None:
    QUERIES[new] = QUERIES[old]
    if old in ORACLE_SQL:
        ORACLE_SQL[new] = ORACLE_SQL[old]


# --- display currency ---------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, CASE WHEN upper(trim(n_name)) IN ('EUR', 'USD') THEN upper(trim(n_name)) ELSE 'local' END AS mode FROM nation")
def cur_mode(s: Star) -> DataFrame:
    return s.table("nation").select("n_nationkey", money.display_mode(F.col("n_name")).alias("mode"))


@query(_LATEST)
def cur_latest_rates(s: Star) -> DataFrame:
    return money.latest_rates(s.rates())


for _name in ("md_forex", "win_first_per_key"):
    _same(_name, "cur_latest_rates")


@query(f"SELECT currency_code, {_round('1 / r', 8)} AS rate_to_eur, {_round('usd / r', 8)} AS rate_to_usd FROM (SELECT currency_code, CAST(rate_to_usd AS DOUBLE) AS r, (SELECT CAST(max(rate_to_usd) AS DOUBLE) FROM rates WHERE currency_code = 'USD') AS usd FROM rates WHERE source = 'feed_a')")
def cur_live_rates(s: Star) -> DataFrame:
    quotes = s.rates().where("source = 'feed_a'").select("currency_code", F.col("rate_to_usd").cast("double").alias("rate"))
    live = money.live_rates(quotes)
    return live.select("currency_code", money.rounded(F.col("rate_to_eur"), 8).alias("rate_to_eur"), money.rounded(F.col("rate_to_usd"), 8).alias("rate_to_usd"))


_same("md_fx_derive", "cur_live_rates")


@query(f"SELECT {_round('1 / CAST(rate_to_eur AS DOUBLE)', 8)} AS usd_per_eur FROM ({_LATEST}) WHERE currency_code = 'USD'")
def cur_usd_per_eur(s: Star) -> DataFrame:
    return money.usd_per_eur(money.latest_rates(s.rates())).select(money.rounded(F.col("usd_per_eur"), 8).alias("usd_per_eur"))


_FACTORS = f"(SELECT p.*, CASE WHEN p.currency = 'EUR' THEN 1.0 ELSE CAST(r.rate_to_eur AS DOUBLE) END AS e, CASE WHEN p.currency = 'USD' THEN 1.0 WHEN p.currency = 'EUR' THEN (SELECT 1 / CAST(rate_to_eur AS DOUBLE) FROM ({_LATEST}) WHERE currency_code = 'USD') ELSE CAST(r.rate_to_usd AS DOUBLE) END AS u FROM pool p LEFT JOIN ({_LATEST}) r ON r.currency_code = p.currency)"


@query(f"SELECT DISTINCT currency, {_round('e', 8)} AS to_eur, {_round('u', 8)} AS to_usd FROM {_FACTORS}")
def cur_factor(s: Star) -> DataFrame:
    rows = money.with_factors(pool.priced(s), money.latest_rates(s.rates()), "currency")
    return rows.select("currency", money.rounded(F.col("to_eur"), 8).alias("to_eur"), money.rounded(F.col("to_usd"), 8).alias("to_usd")).distinct()


@query(f"SELECT id, {_round('price * e', 2)} AS eur, {_round('price * u', 2)} AS usd FROM {_FACTORS}")
def cur_convert(s: Star) -> DataFrame:
    rows = money.with_factors(pool.priced(s), money.latest_rates(s.rates()), "currency")
    price = F.col("price")
    return rows.select("id", money.rounded(money.converted(price, F.col("to_eur"))).alias("eur"), money.rounded(money.converted(price, F.col("to_usd"))).alias("usd"))


@query(f"SELECT id, {_round('price * e * (1 / t)', 2)} AS pln FROM {_FACTORS}, (SELECT CAST(rate_to_eur AS DOUBLE) AS t FROM ({_LATEST}) WHERE currency_code = 'PLN')")
def cur_convert_any(s: Star) -> DataFrame:
    latest = money.latest_rates(s.rates())
    target = latest.where("currency_code = 'PLN'").select(F.col("rate_to_eur").cast("double").alias("t"))
    rows = money.with_factors(pool.priced(s), latest, "currency").join(F.broadcast(target))
    return rows.select("id", money.rounded(money.converted(money.converted(F.col("price"), F.col("to_eur")), 1 / F.col("t"))).alias("pln"))


@query(f"SELECT id, {_round('price * e', 2)} AS amount, CASE WHEN price * e IS NOT NULL THEN 'EUR' END AS shown, price * e IS NOT NULL AS available, price AS local_amount, currency AS local_shown FROM {_FACTORS}")
def cur_display_marketplace(s: Star) -> DataFrame:
    rows = money.with_factors(pool.priced(s), money.latest_rates(s.rates()), "currency")
    show = lambda mode: money.display_price(F.col("price"), F.col("to_eur"), F.col("to_usd"), F.col("currency"), F.col("currency"), F.col("to_eur"), F.lit(mode))
    shown = rows.select("id", show("EUR").alias("x"), show("local").alias("l"))
    return shown.select("id", "x.amount", F.col("x.currency").alias("shown"), "x.available", F.col("l.amount").alias("local_amount"), F.col("l.currency").alias("local_shown"))


@query(f"SELECT id, CASE WHEN u IS NOT NULL THEN {_round('price * u', 2)} ELSE price END AS amount, u IS NULL AS no_rate FROM {_FACTORS}")
def cur_client_resolve(s: Star) -> DataFrame:
    rows = money.with_factors(pool.priced(s), money.latest_rates(s.rates()), "currency")
    shown = money.rounded(money.converted(F.col("price"), F.col("to_usd")))
    x = money.client_price(F.col("price"), F.col("currency"), shown, F.lit("USD"), shown.isNotNull(), F.lit("USD"))
    return rows.select("id", x.alias("x")).select("id", "x.amount", "x.no_rate")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[/:].*$', ''), '^www\\.', '') AS domain FROM pages")
def loc_domain(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", money.normal_domain(F.col("url")).alias("domain"))


@query("SELECT marketplace_id, CASE WHEN tld = 'xyz' THEN NULL ELSE tld END AS tld FROM mp_literal")
def loc_tld(s: Star) -> DataFrame:
    return s.marketplaces().select("marketplace_id", money.tld(F.col("domain")).alias("tld"))


@query("SELECT marketplace_id, CASE country_code WHEN 'RU' THEN NULL WHEN 'BY' THEN NULL ELSE currency_code END AS code, CASE WHEN country_code IN ('RU', 'BY') THEN 'unknown' ELSE 'tld' END AS source FROM mp_literal")
def loc_currency(s: Star) -> DataFrame:
    return s.marketplaces().select("marketplace_id", money.local_currency(F.col("domain"), F.col("country_code")).alias("x")).select("marketplace_id", "x.code", "x.source")


@query("SELECT marketplace_id, CASE WHEN domain = 'shop7.com' THEN replace(marketplace_name, '_', ' ') ELSE replace(marketplace_name, '_', ' ') || ' (' || country_code || ')' END AS label FROM marketplaces")
def loc_label(s: Star) -> DataFrame:
    return s.marketplaces().select("marketplace_id", money.marketplace_label(F.col("marketplace_name"), F.col("domain"), F.col("country_code")).alias("label"))


# --- market data --------------------------------------------------------------------------------------------------------

_DAY = "CAST(strftime(l_shipdate, '%Y%m') AS INTEGER)"
_COINS = "(SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_id, 'C' || user_id % 30 AS symbol, 'feed' || event_id % 3 AS source, CASE WHEN user_id % 7 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS rank, value AS price, value * 1000 AS market_cap FROM events)"
_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(rank, 9999), source, price) AS k FROM {_COINS} WHERE date_id = (SELECT max(date_id) FROM {_COINS})) WHERE k = 1)"


def _coins(s: Star) -> DataFrame:
    user = F.col("user_id")
    rows = s.table("events").select(F.date_format("ts", "yyyyMMdd").cast("int").alias("date_id"), F.concat(F.lit("C"), (user % 30).cast("string")).alias("symbol"), F.concat(F.lit("feed"), (F.col("event_id") % 3).cast("string")).alias("source"), F.when(user % 7 != 0, (F.col("event_id") % 100).cast("int")).alias("rank"), F.col("value").alias("price"), (F.col("value") * 1000).alias("market_cap"))
    # equal ranks and sources: the least price stands for them
    return rows.groupBy("date_id", "symbol", "source", "rank").agg(F.min("price").alias("price"), F.min("market_cap").alias("market_cap"))


@query(f"SELECT symbol, rank, price FROM {_BEST}")
def md_crypto(s: Star) -> DataFrame:
    return market.crypto(_coins(s)).select("symbol", "rank", "price")


_same("win_best_rank", "md_crypto")


@query(f"SELECT symbol, row_number() OVER (ORDER BY coalesce(rank, 999999), market_cap DESC NULLS LAST, symbol) AS position FROM {_BEST}")
def md_instruments(s: Star) -> DataFrame:
    return market.instruments(_coins(s)).select("symbol", F.col("position").cast("long").alias("position"))


_same("sort_instruments", "md_instruments")
_GOODS = "(SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id, CASE o_custkey % 4 WHEN 0 THEN 'XAU' WHEN 1 THEN 'XAG' WHEN 2 THEN 'BRENT' ELSE 'GAS' END AS symbol, o_orderpriority AS source, CAST(max(o_totalprice) AS DECIMAL(12,2)) AS price FROM orders GROUP BY ALL)"
_GOODS_NEW = f"(SELECT symbol, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY source) AS k FROM {_GOODS} WHERE date_id = (SELECT max(date_id) FROM {_GOODS})) WHERE k = 1)"


def _goods(s: Star) -> DataFrame:
    k = F.col("o_custkey") % 4
    symbol = F.when(k == 0, "XAU").when(k == 1, "XAG").when(k == 2, "BRENT").otherwise("GAS")
    return s.table("orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_id"), symbol.alias("symbol"), F.col("o_orderpriority").alias("source")).agg(F.max("o_totalprice").cast("decimal(12,2)").alias("price"))


@query(f"SELECT symbol, price, CASE WHEN symbol IN ('XAU', 'XAG', 'XPT', 'XPD') THEN 'metal' ELSE 'energy' END AS kind FROM {_GOODS_NEW}")
def md_commodities(s: Star) -> DataFrame:
    return market.commodities(_goods(s)).select("symbol", "price", market.commodity_kind(F.col("symbol")).alias("kind"))


_same("md_commodity_kind", "md_commodities")
_FUEL = "(SELECT n_name AS country_code, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id, CASE o_orderkey % 3 WHEN 0 THEN 'diesel' WHEN 1 THEN 'petrol' ELSE 'lpg' END AS fuel_type, min(CAST(o_totalprice AS DECIMAL(12,2))) AS price FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"
_FUEL_NEW = f"(SELECT f.* FROM {_FUEL} f JOIN (SELECT country_code, max(date_id) AS date_id FROM {_FUEL} GROUP BY 1) m USING (country_code, date_id))"


def _fuels(s: Star) -> DataFrame:
    k = F.col("o_orderkey") % 3
    joined = s.table("orders").join(s.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(s.table("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_name").alias("country_code"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_id"), F.when(k == 0, "diesel").when(k == 1, "petrol").otherwise("lpg").alias("fuel_type")).agg(F.min(F.col("o_totalprice").cast("decimal(12,2)")).alias("price"))


@query(f"SELECT country_code, date_id, fuel_type, price FROM {_FUEL_NEW}")
def md_fuel(s: Star) -> DataFrame:
    return market.fuel(_fuels(s)).select("country_code", "date_id", "fuel_type", "price")


@query(f"SELECT country_code, min(price) FILTER (WHERE fuel_type = 'diesel') AS diesel, min(price) FILTER (WHERE fuel_type = 'petrol') AS petrol, min(price) FILTER (WHERE fuel_type = 'lpg') AS lpg FROM {_FUEL_NEW} GROUP BY 1")
def md_fuel_pivot(s: Star) -> DataFrame:
    return market.fuel_pivot(_fuels(s), ["diesel", "petrol", "lpg"])


_QUOTES = f"(SELECT currency_code, {_round('1 / CAST(rate_to_eur AS DOUBLE)', 6)} AS bid FROM ({_LATEST}))"


@query(f"SELECT currency_code, bid, bid AS ask, 0.0::DOUBLE AS spread FROM {_QUOTES}")
def md_forex_quote(s: Star) -> DataFrame:
    return market.forex_quotes(s.rates())


@query(f"SELECT 'forex' AS type, currency_code AS symbol, bid AS value FROM {_QUOTES} UNION ALL SELECT * FROM (SELECT 'crypto', symbol, price FROM {_BEST} ORDER BY coalesce(rank, 9999), symbol LIMIT 5) UNION ALL SELECT 'commodity', symbol, CAST(price AS DOUBLE) FROM {_GOODS_NEW} UNION ALL SELECT 'fuel', fuel_type, CAST(price AS DOUBLE) FROM {_FUEL_NEW}")
def md_ticker(s: Star) -> DataFrame:
    return market.ticker(s.rates(), _coins(s), _goods(s), _fuels(s))


@query(f"SELECT type, symbol, value FROM (SELECT 'crypto' AS type, symbol, price AS value FROM {_BEST} ORDER BY coalesce(rank, 9999), symbol LIMIT 5) WHERE symbol IN ('C1', 'C2', 'C3') UNION ALL SELECT 'forex', currency_code, bid FROM {_QUOTES} WHERE currency_code = 'MDL'")
def topk_crypto5(s: Star) -> DataFrame:
    return market.ticker(s.rates(), _coins(s), _goods(s), _fuels(s), ["c1", " C2", "c3", "mdl"])


@query(f"SELECT currency_code || '/EUR' AS label, bid AS value, '' AS prefix FROM {_QUOTES} UNION ALL SELECT symbol, CAST(price AS DOUBLE), '$' FROM {_GOODS_NEW}")
def md_ticker_legacy(s: Star) -> DataFrame:
    rows = market.ticker(s.rates(), _coins(s), _goods(s), _fuels(s)).where(F.col("type").isin("forex", "commodity"))
    forex = F.col("type") == "forex"
    return rows.select(F.when(forex, F.concat("symbol", F.lit("/EUR"))).otherwise(F.col("symbol")).alias("label"), "value", F.when(forex, "").otherwise("$").alias("prefix"))


@query("SELECT split_part(status || '/x', '/', 1) AS kind, max(created_at) FILTER (WHERE status = 'success') AS ok_at, max(created_at) FILTER (WHERE status <> 'success') AS failed_at FROM (SELECT * FROM logs ORDER BY created_at DESC, id DESC LIMIT 50) GROUP BY 1")
def md_refresh_audit(s: Star) -> DataFrame:
    last = s.logs().orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)
    good = F.col("status") == "success"
    kind = F.split(F.concat("status", F.lit("/x")), "/")[0]
    return last.groupBy(kind.alias("kind")).agg(F.max(F.when(good, F.col("created_at"))).alias("ok_at"), F.max(F.when(~good, F.col("created_at"))).alias("failed_at"))


@query("SELECT user_id, plan || ',' || CASE WHEN is_active THEN 'new' ELSE segment END AS preferences FROM users")
def md_preferences(s: Star) -> DataFrame:
    stored = F.create_map(F.lit("plan"), F.col("plan"), F.lit("topic"), F.col("segment"))
    updates = F.create_map(F.lit("plan"), F.lit(None).cast("string"), F.lit("topic"), F.when(F.col("is_active"), "new"))
    merged = market.merged_preferences(stored, updates)
    return s.users().select("user_id", merged.alias("m")).select("user_id", F.concat_ws(",", F.col("m")["plan"], F.col("m")["topic"]).alias("preferences"))


# --- gate and ingest ----------------------------------------------------------------------------------------------------

_OBSERVED = "(SELECT l_orderkey * 1000003 + l_partkey * 101 + l_linenumber AS id, l_partkey % 97 AS listing_id, CAST(l_suppkey % 10 AS INTEGER) AS marketplace_id, l_shipdate AS observed_at, CASE WHEN l_partkey % 31 <> 0 THEN 'name' END AS title, CAST(CASE WHEN l_linenumber % 7 = 6 THEN 0 ELSE round(l_quantity) END AS DECIMAL(12,2)) AS price, CASE l_partkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'ABC' ELSE 'MDL' END AS currency, repeat('x', CAST(l_orderkey % 60 AS INTEGER)) AS currency_raw, l_linestatus = 'O' AS in_stock FROM lineitem)"
_ALLOWED = "CASE WHEN currency IN ('EUR', 'USD') THEN TRUE ELSE currency = (SELECT currency_code FROM mp_literal m WHERE m.marketplace_id = o.marketplace_id) END"
_REASON = f"(SELECT o.*, CASE WHEN title IS NULL THEN 'missing_name_or_currency' WHEN price <= 0 THEN 'price_not_positive' WHEN length(currency_raw) >= 50 THEN 'currency_raw_too_long' WHEN NOT {_ALLOWED} THEN 'currency_country_mismatch' END AS skip_reason FROM {_OBSERVED} o)"


def _observed(s: Star) -> DataFrame:
    part = F.col("l_partkey")
    rows = s.table("lineitem").select(
        (F.col("l_orderkey") * 1000003 + part * 101 + F.col("l_linenumber")).alias("id"),
        (part % 97).alias("listing_id"),
        (F.col("l_suppkey") % 10).cast("int").alias("marketplace_id"),
        F.col("l_shipdate").alias("observed_at"),
        F.lit(None).cast("string").alias("product_name"),
        F.when(part % 31 != 0, "name").alias("title"),
        F.when(F.col("l_linenumber") % 7 == 6, 0.0).otherwise(F.round("l_quantity")).cast("decimal(12,2)").alias("price"),
        F.lit(None).cast("decimal(12,2)").alias("original_price"),
        F.when(part % 5 == 0, "EUR").when(part % 5 == 1, "USD").when(part % 5 == 2, "ABC").otherwise("MDL").alias("currency"),
        F.repeat(F.lit("x"), (F.col("l_orderkey") % 60).cast("int")).alias("currency_raw"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
    )
    return rows.join(F.broadcast(ingest.whitelist(s.marketplaces())), "marketplace_id", "left")


@query("SELECT marketplace_id, array_to_string(list_sort(list_distinct([currency_code, 'EUR', 'USD', 'CHF'])), ',') AS allowed FROM mp_literal")
def gate_whitelist(s: Star) -> DataFrame:
    return ingest.whitelist(s.marketplaces(), ["CHF", "TOOLONG"]).select("marketplace_id", F.array_join("allowed", ",").alias("allowed"))


_same("join_whitelist", "gate_whitelist")


@query(f"SELECT id, skip_reason IS NULL AS passed, skip_reason, CASE WHEN skip_reason LIKE 'currency%' THEN 'parse_error' END AS forced_log_status FROM {_REASON}")
def gate_five_checks(s: Star) -> DataFrame:
    return ingest.gate(_observed(s)).select("id", "passed", "skip_reason", "forced_log_status")


_OUTCOME = f"(SELECT *, CASE WHEN skip_reason IS NOT NULL THEN CASE WHEN skip_reason LIKE 'currency%' THEN 'parse_error' END WHEN abs(CAST(price AS DOUBLE) - CAST(bp AS DOUBLE)) < 0.001 AND currency = bc AND in_stock IS NOT DISTINCT FROM bs THEN 'no_change' ELSE 'success' END AS outcome FROM (SELECT *, lag(price) OVER w AS bp, lag(currency) OVER w AS bc, lag(in_stock) OVER w AS bs FROM {_REASON} WINDOW w AS (PARTITION BY listing_id, skip_reason IS NULL ORDER BY observed_at, id)))"


@query(f"SELECT id, outcome FROM {_OUTCOME}")
def ing_outcome(s: Star) -> DataFrame:
    return ingest.ingest(_observed(s)).select("id", "outcome")


@query(f"SELECT count(*) AS n FROM {_OUTCOME} WHERE outcome = 'no_change'")
def gate_no_change(s: Star) -> DataFrame:
    return ingest.ingest(_observed(s)).where("outcome = 'no_change'").agg(F.count("*").alias("n"))


@query(f"SELECT listing_id, date_id, price, CASE WHEN prev > 0 AND abs(CAST(price - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100) <= 9999.9999 THEN round(CAST(price - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100, 4) END AS change_pct FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY date_id) AS prev FROM (SELECT listing_id, CAST(strftime(observed_at, '%Y%m%d') AS INTEGER) AS date_id, price, row_number() OVER (PARTITION BY listing_id, CAST(observed_at AS DATE) ORDER BY observed_at DESC, id DESC, price DESC) AS k FROM {_OUTCOME} WHERE outcome = 'success') WHERE k = 1)")
def ing_one_per_day(s: Star) -> DataFrame:
    return ingest.one_per_day(ingest.ingest(_observed(s))).select("listing_id", "date_id", "price", "change_pct")


@query("SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'found ' || product_id ELSE name END AS name, coalesce(image_url, CASE WHEN product_id % 4 = 0 THEN 'http://found' END) AS image_url FROM products")
def ing_enrich_product(s: Star) -> DataFrame:
    found = s.products().where("product_id % 4 = 0").select("product_id", F.lit(1).alias("observed_at"), F.concat(F.lit("found "), F.col("product_id").cast("string")).alias("title"), F.lit("http://found").alias("found_image"))
    return ingest.enrich_products(s.products(), found).select("product_id", "name", "image_url")


# --- lifecycle and discovery ----------------------------------------------------------------------------------------------

_AGE = "CAST(floor(epoch(now)) - floor(epoch({})) AS BIGINT)".format


@query(f"SELECT id, coalesce(CASE job_type WHEN 'discovery' THEN {_AGE('started_at')} > 1200 ELSE {_AGE('started_at')} > 3600 END, FALSE) AS reap FROM jobs, as_of")
def life_reap_pure(s: Star) -> DataFrame:
    return s.jobs().join(F.broadcast(s.now())).select("id", lifecycle.should_reap(F.col("job_type"), F.col("started_at"), F.col("completed_at"), F.col("now")).alias("reap"))


@query(f"SELECT id, CASE WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead THEN a * 1000 END AS duration_ms FROM (SELECT id, status, {_AGE('started_at')} AS a, status = 'running' AND {_AGE('started_at')} > CASE job_type WHEN 'discovery' THEN 1200 ELSE 3600 END AS dead FROM jobs, as_of)")
def life_reap_apply(s: Star) -> DataFrame:
    return lifecycle.reap(s.jobs(), s.now()).select("id", "status", "duration_ms")


@query(f"SELECT id FROM jobs, as_of WHERE status = 'running' AND {_AGE('started_at')} > CASE job_type WHEN 'discovery' THEN 1020 ELSE 1080 END")
def life_reap_children(s: Star) -> DataFrame:
    return lifecycle.stale_children(s.jobs(), s.now()).select("id")


@query(f"SELECT id FROM jobs, as_of WHERE status = 'pending' AND {_AGE('started_at')} > 120")
def life_reconcile(s: Star) -> DataFrame:
    return lifecycle.waiting_children(s.jobs(), s.now()).select("id")


@query("SELECT id, greatest(started_at, completed_at) AS last_activity FROM jobs")
def life_activity(s: Star) -> DataFrame:
    return s.jobs().select("id", F.greatest("started_at", "completed_at").alias("last_activity"))


@query(f"SELECT id, {_AGE('started_at')} >= 3 * 86400 AS sitemap, CASE WHEN failed = 0 THEN TRUE WHEN successful % 3 > 0 THEN FALSE ELSE {_AGE('started_at')} >= 7 * 86400 END AS recon, CASE WHEN marketplace_id = 0 THEN 200000 ELSE greatest(marketplace_id * 10 - successful, 0) END AS remaining FROM jobs, as_of")
def disc_sitemap_policy(s: Star) -> DataFrame:
    started, now = F.col("started_at"), F.col("now")
    quota = F.when(F.col("marketplace_id") != 0, F.col("marketplace_id") * 10)
    return s.jobs().join(F.broadcast(s.now())).select("id", lifecycle.sitemap_due(F.lit(0), started, now).alias("sitemap"), lifecycle.recon_due(F.col("successful") % 3, F.col("failed"), started, now).alias("recon"), lifecycle.remaining_quota(quota, F.col("successful")).cast("long").alias("remaining"))


for _name in ("disc_recon_policy", "disc_quota"):
    _same(_name, "disc_sitemap_policy")


@query()
def disc_sample_trust(s: Star) -> DataFrame:
    rows = s.table("pages").select(F.regexp_extract("url", r"://([^/]*)", 1).alias("group"), "url", F.when(F.length("url") % 3 == 0, "product").otherwise("hub").alias("role"))
    return lifecycle.sampled_trust(rows).select("group", "url", "taken")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 500 AS src, l_suppkey * 7 % 500 AS dst FROM lineitem), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def disc_bfs_all(s: Star) -> DataFrame:
    """Plain reachability over the edges that all of lineitem makes."""
    edges = s.table("lineitem").select((F.col("l_partkey") % 500).alias("src"), (F.col("l_suppkey") * 7 % 500).alias("dst")).distinct()
    return lifecycle.reachable(edges, s.spark.range(1).select(F.col("id").alias("node")), 3)


@query("SELECT avg(CASE WHEN length(url) % 3 = 0 THEN 1.0 ELSE 0.0 END) AS x, count(*) AS n FROM pages")
def agg_classify_ratio(s: Star) -> DataFrame:
    return s.table("pages").agg(F.avg(F.when(F.length("url") % 3 == 0, 1.0).otherwise(0.0)).alias("x"), F.count("*").alias("n"))


# --- documents: see queries_documents


# --- sources and sinks ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part")
def src_table(s: Star) -> DataFrame:
    return s.table("part").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 5, 77)")
def src_pk_lookup(s: Star) -> DataFrame:
    return s.table("part").where(F.col("p_partkey").isin(1, 5, 77)).select("p_partkey", "p_name")


def _forex_payloads(s: Star) -> DataFrame:
    """A provider's payload for each date and source, with a bad entry."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency_code", (F.col("rate_to_usd") * 2).cast("string")))))
    days = s.rates().groupBy("date_id", "source").agg(entries.alias("rates"))
    rates = F.map_concat("rates", F.create_map(F.lit("BAD"), F.lit("n/a")))
    return days.select("date_id", "source", F.to_json(F.struct(F.lit("EUR").alias("base"), rates.alias("rates"))).alias("body"))


@query(f"SELECT date_id, source, 'EUR/' || currency_code AS pair, {_round('CAST(rate_to_usd * 2 AS DOUBLE)', 6)} AS bid, {_round('CAST(rate_to_usd * 2 AS DOUBLE) + 0.0001', 6)} AS ask FROM rates")
def src_forex_feed(s: Star) -> DataFrame:
    feed = feeds.forex_feed(_forex_payloads(s), "date_id", "source")
    return feed.select("date_id", "source", "pair", money.rounded(F.col("bid"), 6).alias("bid"), money.rounded(F.col("ask"), 6).alias("ask"))


@query(f"SELECT date_id, source, 'EUR/' || currency_code AS pair, {_round('CAST(rate_to_usd * 2 AS DOUBLE)', 6)} AS rate FROM rates")
def src_feed_normalise(s: Star) -> DataFrame:
    return feeds.base_rates(feeds.forex_feed(_forex_payloads(s), "date_id", "source"), "EUR", "date_id", "source")


@query("SELECT currency_code, date_id, source FROM rates WHERE source = 'feed_b'")
def src_fallback_chain(s: Star) -> DataFrame:
    rates = s.rates().select("currency_code", "date_id", "source")
    return feeds.first_filled([rates.where("source = 'feed_none'"), rates.where("source = 'feed_b'"), rates.where("source = 'feed_a'")])


@query("SELECT currency_code, source FROM rates WHERE source = 'feed_b' AND date_id = (SELECT max(date_id) FROM rates)")
def src_crypto_min10(s: Star) -> DataFrame:
    """A year's rates of one source are fewer than ten, so the second source is taken, though it has no more."""
    newest = s.rates().agg(F.max("date_id").alias("date_id"))
    rates = s.rates().join(F.broadcast(newest), "date_id").select("currency_code", "source")
    return feeds.first_filled([rates.where("source = 'feed_a'"), rates.where("source = 'feed_b'")], least=10)


@query("SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT 'S' || event_id % 80 AS symbol, event_id % 1000 AS volume FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def src_crypto_ticker(s: Star) -> DataFrame:
    sums = s.table("events").groupBy(F.concat(F.lit("S"), (F.col("event_id") % 80).cast("string"), F.lit("USDT")).alias("symbol")).agg(F.sum(F.col("event_id") % 1000).alias("v"))
    one = F.struct("symbol", F.lit("1.5").alias("lastPrice"), F.col("v").cast("string").alias("quoteVolume"))
    body = sums.agg(F.to_json(F.collect_list(one)).alias("body"))
    return feeds.crypto_ticker(body).select("symbol", F.col("volume").cast("long").alias("volume"))


# payloads made from every event: one for each user, or for each event where a payload has one row


@query("SELECT user_id, upper('c' || event_id % 50) AS symbol, CAST(event_id % 1000 AS DOUBLE) / 2 AS price, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END AS market_cap, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS change_24h FROM events WHERE event_id % 9 <> 0 AND event_id % 11 <> 0")
def src_crypto_markets(s: Star) -> DataFrame:
    n = F.col("event_id")
    coin = F.struct(F.when(n % 11 != 0, F.concat(F.lit("c"), (n % 50).cast("string"))).alias("symbol"), F.when(n % 9 != 0, (n % 1000).cast("double") / 2).alias("current_price"), F.when(n % 4 != 0, n.cast("double")).alias("market_cap"), F.when(n % 5 != 0, (n % 7).cast("double")).alias("price_change_percentage_24h"))
    bodies = s.table("events").groupBy("user_id").agg(F.to_json(F.collect_list(coin)).alias("body"))
    return feeds.crypto_markets(bodies, "user_id")


@query("SELECT 'X' || event_id AS symbol, CAST(CASE event_id % 3 WHEN 0 THEN event_id ELSE event_id + 1 END AS DOUBLE) AS price, CASE event_id % 3 WHEN 0 THEN 1.5::DOUBLE ELSE -2::DOUBLE END AS change_pct FROM events WHERE event_id % 3 < 2")
def src_commodity_metal(s: Star) -> DataFrame:
    n = F.col("event_id")
    body = F.when(n % 3 == 0, F.format_string('{"price": %d, "chp": 1.5}', n)).when(n % 3 == 1, F.format_string('{"close": "%d", "change_24h": -2}', n + 1)).otherwise("{}")
    return feeds.metals(s.table("events").select(F.concat(F.lit("X"), n.cast("string")).alias("symbol"), body.alias("body")))


@query("SELECT 'U' || user_id AS symbol, v AS price, CASE WHEN w <> 0 THEN (v - w) / w * 100 END AS change_pct FROM (SELECT user_id, CAST(event_id % 10 AS DOUBLE) AS v, lead(CAST(event_id % 10 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def src_commodity_energy(s: Star) -> DataFrame:
    values = F.reverse(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 10).cast("string").alias("value")))))
    body = F.to_json(F.struct(F.transform(values, lambda v: F.struct(v["value"].alias("value"))).alias("data")))
    return feeds.energy(s.table("events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol")).agg(body.alias("body")))


@query("SELECT 'diesel_with_a_very_l' AS symbol, CAST(event_id % 100 AS DOUBLE) / 4 AS price, 'litre' AS unit FROM events WHERE event_id % 6 <> 0")
def src_fuel_feed(s: Star) -> DataFrame:
    n = F.col("event_id")
    row = F.struct(F.lit("diesel_with_a_very_long_name").alias("symbol"), F.when(n % 6 == 0, "?").otherwise(((n % 100) / 4).cast("string")).alias("price"), F.lit("litre").alias("unit"))
    return feeds.fuel_feed(s.table("events").groupBy("user_id").agg(F.to_json(F.collect_list(row)).alias("body")))


def _sitemap_files(s: Star) -> DataFrame:
    """One sitemap file for each ten pages, twenty files for each site: site, n, url, body."""
    item = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc></url>"))
    numbered = s.table("pages").withColumns({"site": F.floor(F.col("page_id") / 200), "n": F.floor(F.col("page_id") % 200 / 10)})
    files = numbered.groupBy("site", "n").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</urlset>")).alias("body"))
    return files.select("site", "n", F.format_string("http://m%d.example/files/%d", "site", "n").alias("url"), "body")


def _sitemap_indexes(files: DataFrame) -> DataFrame:
    """Each site's index of its files, in their order: site, body."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: F.concat(F.lit("<sitemap><loc>"), x["url"], F.lit("</loc></sitemap>")))
    return files.groupBy("site").agg(F.concat(F.lit('<sitemapindex xmlns="http://x">'), F.array_join(named, ""), F.lit("</sitemapindex>")).alias("body"))


@query("SELECT 'http://m' || page_id // 200 || '.example/files/' || page_id % 200 // 10 AS url, count(*) AS n FROM pages GROUP BY 1")
def src_sitemap_xml(s: Star) -> DataFrame:
    parsed = _sitemap_files(s).select("url", feeds.sitemap_locations("body").alias("x")).where(F.size("x.urls") > 0)
    return parsed.select("url", F.size("x.urls").cast("long").alias("n"))


@query("SELECT DISTINCT 'http://m' || page_id // 200 || '.example/start' AS site, url FROM pages WHERE page_id % 200 // 10 < CASE page_id // 200 % 3 WHEN 0 THEN 10 ELSE 12 END")
def src_sitemap_walk(s: Star) -> DataFrame:
    """One crawl for each site within its own limits. A third of the sites name their index in robots.txt, among lines that name nothing; a
    third have no robots.txt and an index at a usual path; a third name a file, which the index names again."""
    files, k = _sitemap_files(s), F.col("site") % 3
    home = lambda path: F.format_string("http://m%d.example" + path, "site")
    at = F.when(k == 0, home("/maps/index")).when(k == 1, home("/sitemap_index.xml")).otherwise(home("/sitemap.xml"))
    indexes = _sitemap_indexes(files)
    named = F.concat(F.lit("User-agent: *\r\nDisallow: /sitemap:\r\n SITEMAP :x\nsitemap:\n  SiteMap:  "), home("/maps/index"), F.lit(" \nSitemap: "), home("/gone.xml"))
    robots = indexes.select(home("/start").alias("site"), F.when(k == 0, named).when(k == 2, F.concat(F.lit("Sitemap: "), home("/files/0"))).alias("body"))
    return feeds.sitemap_walk(files.select("url", "body").unionByName(indexes.select(at.alias("url"), "body")), feeds.robots_roots(robots))


@query("SELECT DISTINCT url FROM pages WHERE url IS NOT NULL")
def src_sitemap_walk_all(s: Star) -> DataFrame:
    """Every file of every site, without the limits of one crawl."""
    files = _sitemap_files(s)
    indexes = _sitemap_indexes(files).select(F.col("site").cast("string").alias("site"), F.format_string("http://m%d.example/index", "site").alias("url"), "body")
    roots = indexes.select("site", "url", F.lit(0).alias("place"))
    return feeds.sitemap_walk(files.select("url", "body").unionByName(indexes.select("url", "body")), roots, None, None).select("url").distinct()


_NEWEST = "date_id = (SELECT max(date_id) FROM rates) AND source = 'feed_a'"


@query(f"SELECT date_id, currency_code, source, rate_to_eur FROM rates WHERE NOT ({_NEWEST} AND currency_code <> 'GBP') UNION ALL SELECT date_id, currency_code, source, CAST(rate_to_eur * 3 AS DECIMAL(18,8)) FROM rates WHERE {_NEWEST} AND currency_code <> 'GBP' UNION ALL SELECT max(date_id), 'XAU', 'feed_a', CAST(7 AS DECIMAL(18,8)) FROM rates")
def sink_replace_key(s: Star) -> DataFrame:
    """A second delivery of the newest date of a source: other values for all currencies but one, and a currency that is new."""
    store = Snapshots(s.spark, fresh_folder(s.spark, "rates"))
    rates = store.replace(s.rates().select("date_id", "currency_code", "source", "rate_to_eur"))
    newest = rates.agg(F.max("date_id").alias("date_id"))
    again = rates.join(F.broadcast(newest), "date_id").where("source = 'feed_a' and currency_code <> 'GBP'").withColumn("rate_to_eur", (F.col("rate_to_eur") * 3).cast("decimal(18,8)"))
    added = newest.select("date_id", F.lit("XAU").alias("currency_code"), F.lit("feed_a").alias("source"), F.lit(7).cast("decimal(18,8)").alias("rate_to_eur"))
    return sinks.replace_stored(store, again.select(rates.columns).unionByName(added), ["date_id", "currency_code", "source"])


@query("SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, min(k) AS came_from FROM (SELECT DISTINCT o_orderdate AS d, 0 AS k FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT l_shipdate, 1 FROM lineitem) GROUP BY 1")
def sink_insert_ignore(s: Star) -> DataFrame:
    """The dates of some orders are stored; of the dates of all shipments those are added that aren't there."""
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int").alias("date_id")
    store = Snapshots(s.spark, fresh_folder(s.spark, "dates"))
    store.replace(s.table("orders").where("o_orderkey % 3 = 0").select(day("o_orderdate"), F.lit(0).alias("came_from")).distinct())
    return sinks.insert_stored(store, s.table("lineitem").select(day("l_shipdate"), F.lit(1).alias("came_from")), ["date_id"])


@query("SELECT count(*) AS n, count(DISTINCT lower(rtrim(url, '/'))) AS d FROM (SELECT min(url) AS url FROM pages WHERE sha256(lower(rtrim(trim(url), '/'))) NOT IN (SELECT sha256(lower(rtrim(trim(url), '/'))) FROM pages WHERE page_id % 3 = 0) GROUP BY sha256(lower(rtrim(trim(url), '/'))))")
def join_anti_seen(s: Star) -> DataFrame:
    hashed = s.table("pages").withColumn("url_hash", urls.url_hash(F.col("url")))
    fresh = sinks.unseen(hashed, hashed.where("page_id % 3 = 0"), "url_hash")
    return fresh.agg(F.count("*").alias("n"), F.count_distinct("url_hash").alias("d"))


_KEPT = "SELECT '{0}' AS name, count(*) FILTER (WHERE t < cut) AS deleted, count(*) FILTER (WHERE t >= cut) AS kept, min(t) FILTER (WHERE t >= cut) AS oldest FROM (SELECT t, max(t) OVER () + INTERVAL {2} DAY - INTERVAL {3} DAY AS cut FROM ({1}))".format
_LOGGED = {"scrape_logs": ("SELECT ts AS t FROM events", 12), "api_logs": ("SELECT o_orderdate AS t FROM orders", 0), "chat_messages": ("SELECT l_shipdate AS t FROM lineitem WHERE l_returnflag <> 'R'", 0), "alert_events": ("SELECT l_shipdate AS t FROM lineitem WHERE l_returnflag = 'R'", 0)}


@query(" UNION ALL ".join(_KEPT(name, sql, later, sinks.RETENTION_DAYS[name]) for name, (sql, later) in _LOGGED.items()))
def sink_delete_retention(s: Star) -> DataFrame:
    """Four stored logs, each cut at its own age some days after its last row, and read back."""
    returned = F.col("l_returnflag") == "R"
    rows = {
        "scrape_logs": s.table("events").select(F.col("ts").alias("t")),
        "api_logs": s.table("orders").select(F.col("o_orderdate").alias("t")),
        "chat_messages": s.table("lineitem").where(~returned).select(F.col("l_shipdate").alias("t")),
        "alert_events": s.table("lineitem").where(returned).select(F.col("l_shipdate").alias("t")),
    }
    told = []
    for name, days in sinks.RETENTION_DAYS.items():
        store = Snapshots(s.spark, fresh_folder(s.spark, name))
        store.replace(rows[name], sinks.month_of("t"))
        cut = rows[name].agg(F.max("t")).first()[0] + datetime.timedelta(days=_LOGGED[name][1] - days)
        deleted = sinks.delete_older(store, "t", cut)
        told.append(store.read().agg(F.count("*").alias("kept"), F.min("t").alias("oldest")).select(F.lit(name).alias("name"), F.lit(deleted).cast("long").alias("deleted"), "kept", "oldest"))
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


_ELAPSED = _round("CAST(epoch_us(CASE WHEN status IN ('running', 'pending') THEN now ELSE completed_at END) - epoch_us(started_at) AS DOUBLE) / 1e6", 3)


@query(f"SELECT id, elapsed, CASE WHEN elapsed > 0 AND done > 0 THEN {_round('CAST(done AS DOUBLE) / elapsed * 60', 3)} END AS speed, CASE WHEN elapsed > 0 AND done > 0 AND estimated > done THEN {_round('(estimated - done) / (CAST(done AS DOUBLE) / elapsed)', 3)} END AS eta FROM (SELECT id, {_ELAPSED} AS elapsed, CASE WHEN marketplace_id % 5 = 4 THEN 0 ELSE successful + failed END AS done, marketplace_id * 10 AS estimated FROM jobs, as_of)")
def agg_job_elapsed(s: Star) -> DataFrame:
    """Every job's time so far, speed, and time to go; those that run are timed until now."""
    end = F.when(F.col("status").isin("running", "pending"), F.col("now")).otherwise(F.col("completed_at"))
    elapsed = numbers.duration_seconds(F.lit(None).cast("long"), F.col("started_at"), end)
    done = F.when(F.col("marketplace_id") % 5 == 4, 0).otherwise(F.col("successful") + F.col("failed"))
    timed = s.jobs().join(F.broadcast(s.now())).select("id", elapsed.alias("elapsed"), done.alias("done"), (F.col("marketplace_id") * 10).alias("estimated"))
    told = summaries.job_progress(F.col("elapsed"), F.col("done"), F.col("estimated"))
    return timed.select("id", "elapsed", told.alias("x")).select("id", "elapsed", "x.speed", "x.eta")


@query("SELECT id, array_to_string(list_filter([CASE WHEN failed > 0 THEN 'failures' END, CASE WHEN successful + failed >= 20 AND failed >= 0.25 * (successful + failed) THEN 'ratio' END], lambda x: x IS NOT NULL), ',') AS flags FROM jobs")
def agg_warning_flags(s: Star) -> DataFrame:
    n = F.col("successful") + F.col("failed")
    found = F.array_compact(F.array(F.when(F.col("failed") > 0, "failures"), F.when((n >= 20) & (F.col("failed") >= 0.25 * n), "ratio")))
    return s.jobs().select("id", F.array_join(found, ",").alias("flags"))


@query(f"SELECT id, price, {_round('price * e', 2)} AS price_eur FROM (SELECT * FROM {_FACTORS} WHERE country_code NOT IN ('RU', 'BY')) ORDER BY price_change_pct DESC NULLS LAST, id LIMIT 20")
def plan_overview(s: Star) -> DataFrame:
    return page_plans.overview(s).select("id", "price", "price_eur")


@query("SELECT id, marketplace_id, price FROM (SELECT *, row_number() OVER (PARTITION BY marketplace_id ORDER BY sha256(CAST(id AS VARCHAR) || ':7'), id) AS k FROM pool) WHERE k <= 30")
def win_seeded_shuffle(s: Star) -> DataFrame:
    """Thirty rows of each marketplace in an order that a seed fixes."""
    order = F.sha2(F.concat(F.col("id").cast("string"), F.lit(":7")), 256)
    k = F.row_number().over(Window.partitionBy("marketplace_id").orderBy(order, "id"))
    return pool.pool(s).withColumn("k", k).where("k <= 30").select("id", "marketplace_id", "price")

"""Queries of status vocabularies, discovery and relay rules, job completion and sinks, each over every branch of its operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions import money, status, text
from marketgrain.functions.money import rounded
from marketgrain.operators import lifecycle, pool, summaries
from marketgrain.queries import query
from marketgrain.queries_more import _FACTORS, _round
from marketgrain.sources import feeds, sinks
from marketgrain.sources.folders import fresh_folder, passing_folder
from marketgrain.sources.snapshots import Snapshots
from marketgrain.sources.star import Star


def _pick(key: str, values: list[str | None]) -> tuple[Callable[[], Column], str]:
    """A value by the key's remainder, as what gives a column and in SQL."""
    column = lambda: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))
    return column, f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


# --- vocabularies ---------------------------------------------------------------------------------------------------------

_ERROR, _ERROR_SQL = _pick("id", ["timeout:httpx", "blocked:httpx", "captcha:httpx", "url_not_found", "price_not_found", "parse_error", "exception: ValueError", "other", None, "fetch_failed", "network down", "extract failed", "rate limit", ""])
_ATTEMPT_SQL = f"(SELECT id, id % 3 <> 0 AS success, {_ERROR_SQL} AS error, id % 5 = 0 AS empty, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN ' ' ELSE 'a title' END AS title, CASE WHEN id % 4 <> 1 THEN '9.50' END AS price, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 = 1 THEN '' ELSE 'EUR' END AS currency, id % 13 = 0 AS partial FROM logs)"
_FAILURE_SQL = "CASE WHEN lower(error) LIKE 'exception:%' THEN 'technical_error' WHEN lower(error) LIKE '%parse_error%' THEN 'parse_error' WHEN lower(error) LIKE '%price_not_found%' THEN 'price_not_found' WHEN lower(error) LIKE '%not_found%' THEN 'not_found' WHEN lower(error) LIKE '%captcha%' THEN 'captcha' WHEN lower(error) LIKE '%blocked%' THEN 'blocked' WHEN lower(error) LIKE '%timeout%' THEN 'timeout' ELSE 'error' END"


@query(f"SELECT id, CASE WHEN NOT success THEN {_FAILURE_SQL} WHEN empty OR (price IS NOT NULL AND trim(coalesce(currency, '')) = '') OR trim(coalesce(title, '')) = '' THEN 'missing_critical_data' WHEN price IS NULL THEN 'price_not_found' WHEN partial THEN 'missing_critical_data' ELSE 'success' END AS log_status FROM {_ATTEMPT_SQL}")
def map_log_status(s: Star) -> DataFrame:
    n = F.col("id")
    title, price = F.when(n % 7 > 1, "a title").when(n % 7 == 1, " "), F.when(n % 4 != 1, "9.50")
    currency = F.when(n % 11 > 1, "EUR").when(n % 11 == 1, "")
    return s.logs().select("id", status.log_status(n % 3 != 0, _ERROR(), n % 5 == 0, title, price, currency, n % 13 == 0).alias("log_status"))


@query(f"SELECT id, CASE WHEN error = '' THEN NULL WHEN error LIKE '%fetch%' OR error LIKE '%network%' THEN 'network' WHEN error LIKE '%parse%' OR error LIKE '%extract%' THEN 'parse' WHEN error LIKE '%timeout%' THEN 'network' WHEN error LIKE '%blocked%' OR error LIKE '%captcha%' THEN 'auth' WHEN error LIKE '%rate%' THEN 'rate_limit' WHEN error IS NOT NULL THEN 'parse' END AS category FROM {_ATTEMPT_SQL}")
def map_error_category(s: Star) -> DataFrame:
    return s.logs().select("id", status.error_category(_ERROR()).alias("category"))


_CODE, _CODE_SQL = _pick("id", ["timeout", "Timeout_read", "blocked", "captcha", "not_found", "rate_limit", "something", None])
_LAYER, _LAYER_SQL = _pick("listing_id", ["httpx", "decodo", "playwright"])


@query(f"SELECT id, CASE WHEN code LIKE 'timeout%' THEN 'timeout' WHEN code IN ('blocked', 'captcha', 'not_found', 'rate_limit') THEN code ELSE 'fetch_failed' END || ':' || layer AS code FROM (SELECT id, lower({_CODE_SQL}) AS code, {_LAYER_SQL} AS layer FROM logs)")
def src_error_map(s: Star) -> DataFrame:
    return s.logs().select("id", status.layer_error(_CODE(), _LAYER()).alias("code"))


_OUTCOME, _OUTCOME_SQL = _pick("id", ["partial_budget", "partial", "error", "no_categories", "completed"])


@query(f"SELECT id, CASE {_OUTCOME_SQL} WHEN 'error' THEN 'failed' WHEN 'partial_budget' THEN 'partial' WHEN 'partial' THEN 'partial' ELSE 'completed' END AS status FROM logs")
def map_discovery_status(s: Star) -> DataFrame:
    return s.logs().select("id", status.discovery_status(_OUTCOME()).alias("status"))


_STAGE, _STAGE_SQL = _pick("id", [None, "queued", "dispatching", "discovery", "scrape"])


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN stage WHEN coalesce(stage, 'queued') IN ('queued', 'dispatching') AND id % 2 = 0 THEN 'discovery' WHEN coalesce(stage, 'queued') = 'queued' AND id % 3 = 0 THEN 'scrape' WHEN stage = 'dispatching' THEN 'discovery' ELSE stage END AS stage FROM (SELECT id, {_STAGE_SQL} AS stage FROM logs)")
def map_stage(s: Star) -> DataFrame:
    n = F.col("id")
    return s.logs().select("id", status.stage(_STAGE(), F.when(n % 7 == 0, "completed").otherwise("running"), n % 2 == 0, n % 3 == 0).alias("stage"))


# --- displays -------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, {_round('price * e', 2)} AS eur, CASE WHEN price * e IS NOT NULL THEN 'EUR' END AS eur_code, price * e IS NOT NULL AS eur_available, {_round('price * u', 2)} AS usd, CASE WHEN price * u IS NOT NULL THEN 'USD' END AS usd_code, price * u IS NOT NULL AS usd_available FROM {_FACTORS}")
def cur_display(s: Star) -> DataFrame:
    rows = money.with_factors(pool.priced(s), money.latest_rates(s.rates()), "currency")
    show = lambda mode: money.display_price(F.col("price"), F.col("to_eur"), F.col("to_usd"), F.col("currency"), F.col("currency"), F.col("to_eur"), F.lit(mode))
    both = rows.select("id", show("EUR").alias("e"), show("USD").alias("u"))
    return both.select("id", *[F.col(f"{c}.{f}").alias(name + more) for c, name in (("e", "eur"), ("u", "usd")) for f, more in (("amount", ""), ("currency", "_code"), ("available", "_available"))])


_SNAPSHOTS = "(SELECT strftime(ts, '%Y%m%d') AS day, 'C' || user_id % 30 AS symbol, CASE WHEN user_id % 7 <> 0 THEN CAST(event_id % 100 AS INTEGER) END AS rank, 'feed' || event_id % 3 AS source, event_id, value AS price, CASE WHEN event_id % 5 <> 0 THEN value / 10 - 3 END AS change_24h, value * 1000 AS market_cap, ts AS fetched_at FROM events)"


@query(f"SELECT symbol, price, change_24h, market_cap, max(fetched_at) OVER () AS fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(rank, 9999), source, event_id) AS k FROM {_SNAPSHOTS} WHERE day = (SELECT max(day) FROM {_SNAPSHOTS})) WHERE k = 1")
def md_crypto_response(s: Star) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    rows = s.table("events").select(F.date_format("ts", "yyyyMMdd").alias("day"), F.concat(F.lit("C"), (user % 30).cast("string")).alias("symbol"), F.struct(F.coalesce(F.when(user % 7 != 0, event % 100), F.lit(9999)).alias("rank"), F.concat(F.lit("feed"), (event % 3).cast("string")).alias("source"), event, F.col("value").alias("price"), F.when(event % 5 != 0, F.col("value") / 10 - 3).alias("change_24h"), (F.col("value") * 1000).alias("market_cap"), F.col("ts").alias("fetched_at")).alias("x"))
    newest = rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day", "left_semi")
    best = newest.groupBy("symbol").agg(F.min("x").alias("x"))
    return best.select("symbol", "x.price", "x.change_24h", "x.market_cap").join(F.broadcast(best.agg(F.max("x.fetched_at").alias("fetched_at"))))


# --- jobs -------------------------------------------------------------------------------------------------------------------

_SEEDS = "SELECT parent_job_id, marketplace_id, job_type, CASE WHEN job_type = 'discovery' THEN CAST(successful AS BIGINT) ELSE 0 END AS created, 0 AS prices_saved, CAST(failed AS BIGINT) AS errors, (epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS duration_ms, status FROM jobs"


@query(f"SELECT * REPLACE (CAST(created AS BIGINT) AS created, CAST(prices_saved AS BIGINT) AS prices_saved) FROM ({_SEEDS})")
def life_child_agg(s: Star) -> DataFrame:
    return summaries.child_seeds(s.jobs())


_ROLLED = "SELECT CAST(strftime(created_at, '%Y%m%d') AS BIGINT) AS parent_job_id, marketplace_id, count(*) FILTER (WHERE status = 'success') AS p, count(*) FILTER (WHERE status <> 'success') AS e FROM logs GROUP BY ALL"


@query(f"SELECT parent_job_id, count(*) AS marketplaces, CAST(sum(coalesce(created, 0)) AS BIGINT) AS created, CAST(sum(coalesce(p, 0)) AS BIGINT) AS prices_saved, CAST(sum(coalesce(errors, 0) + coalesce(e, 0)) AS BIGINT) AS errors, CASE WHEN count(*) = count(*) FILTER (WHERE st = 'completed') THEN 'completed' WHEN count(*) FILTER (WHERE st = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status FROM (SELECT coalesce(x.parent_job_id, y.parent_job_id) AS parent_job_id, created, errors, p, e, coalesce(x.status, CASE WHEN e > 0 THEN 'failed' ELSE 'completed' END) AS st FROM (SELECT * FROM ({_SEEDS}) WHERE marketplace_id <> 9) x FULL JOIN ({_ROLLED}) y ON x.parent_job_id = y.parent_job_id AND x.marketplace_id = y.marketplace_id) GROUP BY 1")
def life_complete(s: Star) -> DataFrame:
    # one marketplace is known from logs alone
    seeds = summaries.child_seeds(s.jobs()).where("marketplace_id <> 9")
    return summaries.completed(seeds, summaries.job_rollup(s.logs()))


_STATES = "SELECT id, listing_id, created_at, errors, last_error, streak, max(streak) OVER (PARTITION BY listing_id ORDER BY created_at, id) < 15 AS active FROM (SELECT *, CAST(status NOT IN ('success', 'no_change') AS BIGINT) AS errors, CASE WHEN status NOT IN ('success', 'no_change') THEN status END AS last_error, count(*) FILTER (WHERE status NOT IN ('success', 'no_change')) OVER (PARTITION BY listing_id, run ORDER BY created_at, id) AS streak FROM (SELECT *, count(*) FILTER (WHERE status IN ('success', 'no_change')) OVER (PARTITION BY listing_id ORDER BY created_at, id) AS run FROM logs))"


@query(f"SELECT id, listing_id, errors, last_error, streak, active FROM ({_STATES})")
def life_listing(s: Star) -> DataFrame:
    return lifecycle.attempt_streaks(s.logs()).select("id", "listing_id", "errors", "last_error", "streak", "active")


_HARVEST, _HARVEST_SQL = _pick("id", ["useful", "bad", "timeout"])


@query(f"SELECT id, outcome, CASE outcome WHEN 'useful' THEN now WHEN 'bad' THEN now - INTERVAL 71 HOUR ELSE now - INTERVAL 48 HOUR END AS harvested_at FROM (SELECT id, {_HARVEST_SQL} AS outcome, now FROM jobs, as_of)")
def disc_cooldown(s: Star) -> DataFrame:
    return s.jobs().join(F.broadcast(s.now())).select("id", _HARVEST().alias("outcome"), lifecycle.harvested_at(_HARVEST(), F.col("now")).alias("harvested_at"))


_CATEGORIES = "SELECT c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, CAST(floor(abs(c_acctbal)) AS BIGINT) % 2 AS saved, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"
_WINDOWED = f"SELECT *, (g * 7) % n AS start, CASE WHEN g % 4 = 0 THEN (g * 7) % n + g % 5 END AS late FROM ({_CATEGORIES})"


@query(f"SELECT g, CAST(CASE WHEN d IS NOT NULL AND (c IS NULL OR d <= c) THEN d - start WHEN c IS NOT NULL THEN c - start + 1 ELSE least(n - start, 60) END AS INTEGER) AS read, CAST(CASE WHEN d IS NOT NULL AND (c IS NULL OR d <= c) THEN d WHEN c IS NOT NULL THEN 0 WHEN start + 60 < n THEN start + 60 ELSE 0 END AS INTEGER) AS next_index, CASE WHEN d IS NOT NULL AND (c IS NULL OR d <= c) THEN TRUE WHEN c IS NOT NULL THEN FALSE ELSE start + 60 < n END AS more FROM (SELECT g, any_value(n) AS n, any_value(start) AS start, min(i) FILTER (WHERE late IS NOT NULL AND i >= late) AS d, min(i) FILTER (WHERE i >= start + 2 AND quiet = 3) AS c FROM (SELECT *, count(*) FILTER (WHERE saved = 0) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS quiet FROM ({_WINDOWED}) WHERE i >= start AND i < start + 60) GROUP BY g)")
def disc_window(s: Star) -> DataFrame:
    rows = s.table("customer").select(F.col("c_nationkey").alias("g"), "c_custkey", (F.floor(F.abs("c_acctbal")) % 2).cast("int").alias("saved"))
    lists = lifecycle.category_windows(rows, "g", "c_custkey", (F.col("g") * 7) % F.col("n"))
    start = F.col("start")
    late = F.when(F.col("g") % 4 == 0, start + F.col("g") % 5)
    told = lists.select("g", lifecycle.harvest_window(F.col("window.saved"), F.col("n"), start, late).alias("w"))
    return told.select("g", "w.read", F.col("w.next_index").cast("int").alias("next_index"), "w.more")


_NOW_STAGE, _NOW_STAGE_SQL = _pick("id", ["queued", "dispatching", "scrape", None])


@query(f"SELECT id, epoch(date_trunc('second', now)) - epoch(date_trunc('second', greatest(beat, log, started_at))) > CASE stage WHEN 'queued' THEN 300 WHEN 'dispatching' THEN 600 ELSE 1800 END AS stale FROM (SELECT id, {_NOW_STAGE_SQL} AS stage, started_at, CASE WHEN id % 3 = 0 THEN now - INTERVAL 7 MINUTE END AS beat, CASE WHEN id % 5 = 0 THEN now - INTERVAL 4 MINUTE WHEN id % 5 = 1 THEN now - INTERVAL 25 MINUTE END AS log, now FROM jobs, as_of)")
def life_stale_pipeline(s: Star) -> DataFrame:
    n, now = F.col("id"), F.col("now").cast("timestamp")
    ago = lambda m: now - F.make_interval(mins=F.lit(m))
    beat, log = F.when(n % 3 == 0, ago(7)), F.when(n % 5 == 0, ago(4)).when(n % 5 == 1, ago(25))
    stale = lifecycle.stale_pipeline(_NOW_STAGE(), beat, log, F.col("started_at").cast("timestamp"), now)
    return s.jobs().join(F.broadcast(s.now())).select("id", stale.alias("stale"))


# --- catalog, feeds in another form, reports --------------------------------------------------------------------------------

_TABLES = ("dim_region", "dim_nation", "fact_lineitem", "fact_events", "stage_orders")


@query("SELECT name, count(*) AS columns FROM (SELECT CASE WHEN table_name IN ('region', 'nation') THEN 'dim_' ELSE 'fact_' END || table_name AS name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'lineitem', 'events')) GROUP BY 1")
def src_catalog_list(s: Star) -> DataFrame:
    """The dimension and fact tables that the catalog lists, and how many columns each has."""
    for name in _TABLES:
        s.table(name.partition("_")[2]).createOrReplaceTempView(name)
    catalog = s.spark.catalog
    listed = [t.name for t in catalog.listTables() if t.name in _TABLES and t.name.startswith(("dim_", "fact_"))]
    return s.spark.createDataFrame([(name, len(catalog.listColumns(name))) for name in sorted(listed)], "name string, columns long")


@query(f"SELECT 'EUR/' || currency_code AS pair, {_round('CAST(rate_to_usd AS DOUBLE)', 6)} AS bid, {_round('CAST(rate_to_usd AS DOUBLE) + 0.0001', 6)} AS ask, date_id FROM rates WHERE source = 'feed_b'")
def src_forex_feed_alt(s: Star) -> DataFrame:
    """The second provider's payloads, one a date, which carry an amount and the date beside base and rates."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency_code", F.col("rate_to_usd").cast("string")))))
    days = s.rates().where("source = 'feed_b'").groupBy("date_id").agg(entries.alias("rates"))
    body = F.to_json(F.struct(F.lit(1.0).alias("amount"), F.lit("EUR").alias("base"), F.col("date_id").cast("string").alias("date"), F.map_concat("rates", F.create_map(F.lit("BAD"), F.lit("-1"))).alias("rates")))
    feed = feeds.forex_feed(days.select("date_id", body.alias("body")), "date_id")
    return feed.select("pair", rounded(F.col("bid"), 6).alias("bid"), rounded(F.col("ask"), 6).alias("ask"), "date_id")


@query("SELECT user_id, 'c' || event_id % 90 AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events")
def win_rank_from_order(s: Star) -> DataFrame:
    """Ranks from the places in each payload's list."""
    coins = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("c"), (F.col("event_id") % 90).cast("string")).alias("symbol"))))
    bodies = s.table("events").groupBy("user_id").agg(F.to_json(F.transform(coins, lambda c: F.struct(c["symbol"].alias("symbol")))).alias("body"))
    rows = bodies.select("user_id", F.posexplode(F.from_json("body", "array<struct<symbol:string>>")).alias("place", "r"))
    return rows.select("user_id", "r.symbol", (F.col("place") + 1).cast("long").alias("rank"))


_RECENT = "(SELECT '{0}' AS report, id, created_at FROM logs{1} ORDER BY created_at DESC, id DESC LIMIT {2})".format


@query("SELECT report, id FROM " + _RECENT("last five", "", 5) + " UNION ALL SELECT report, id FROM " + _RECENT("last thirty", "", 30) + " UNION ALL SELECT report, id FROM " + _RECENT("last success", " WHERE status = 'success'", 1) + " UNION ALL SELECT report, id FROM " + _RECENT("last audits", " WHERE status = 'timeout'", 50))
def topk_recent_logs(s: Star) -> DataFrame:
    """The newest logs that the status, diagnostics and audit reports show."""

    def report(name: str, rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n).select(F.lit(name).alias("report"), "id")

    logs = s.logs()
    parts = [report("last five", logs, 5), report("last thirty", logs, 30), report("last success", logs.where("status = 'success'"), 1), report("last audits", logs.where("status = 'timeout'"), 50)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- relay and users ----------------------------------------------------------------------------------------------------------


@query("SELECT seq, line, max(seq) OVER () AS next_cursor FROM (SELECT * FROM (SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type || ' of ' || user_id END AS line FROM events) WHERE line <> '' ORDER BY seq DESC LIMIT 500) WHERE seq > (SELECT max(event_id) - 50 FROM events) ORDER BY seq DESC LIMIT 50")
def relay_buffer(s: Star) -> DataFrame:
    line = F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.concat("event_type", F.lit("  of\n"), F.col("user_id").cast("string")))
    lines = s.table("events").select(F.col("event_id").alias("seq"), text.relay_line(line).alias("line"))
    after = lines.agg(F.max("seq")).first()[0] - 50
    read = lifecycle.relay_tail(lines, after)
    return read.join(F.broadcast(read.agg(F.max("seq").alias("next_cursor"))))


_REASON = "CASE WHEN user_id = 100 THEN 'self' WHEN is_superuser AND {} <= 1 THEN 'last_superuser' END".format


@query(f"SELECT user_id, {_REASON('active')} AS deactivate, {_REASON('supers')} AS demote, {_REASON('supers')} AS delete FROM (SELECT user_id, is_superuser, count(*) FILTER (WHERE is_superuser) OVER () AS supers, count(*) FILTER (WHERE is_superuser AND is_active) OVER () AS active FROM (SELECT user_id, is_active, user_id IN (100, 900) AS is_superuser FROM users))")
def usr_guards(s: Star) -> DataFrame:
    users = s.users().withColumn("is_superuser", F.col("user_id").isin(100, 900))
    return lifecycle.admin_guards(users, 100)


# --- sinks: written, and read back ----------------------------------------------------------------------------------------------


def _read(s: Star, path: str) -> DataFrame:
    return s.spark.read.parquet(path)


@query("SELECT id, status, id % 2 AS run FROM logs")
def sink_append_log(s: Star) -> DataFrame:
    path = fresh_folder(s.spark, "scrape-logs")
    for run in (0, 1):
        sinks.append(s.logs().where(F.col("id") % 2 == run).select("id", "status", (F.col("id") % 2).alias("run")), path)
    return _read(s, path)


@query("SELECT id, status, 'timeout' AS was FROM logs WHERE status = 'timeout' UNION ALL SELECT id, status, 'error' FROM logs WHERE status = 'error'")
def sink_audit_log(s: Star) -> DataFrame:
    path = fresh_folder(s.spark, "audit")
    for was in ("timeout", "error"):
        sinks.append(s.logs().where(F.col("status") == was).select("id", "status", F.lit(was).alias("was")), path, "was")
    return _read(s, path)


@query("SELECT marketplace_id, count(*) AS runs FROM logs GROUP BY 1")
def sink_refresh_mv(s: Star) -> DataFrame:
    path, count = fresh_folder(s.spark, "summary"), lambda logs: logs.groupBy("marketplace_id").agg(F.count("*").alias("runs"))
    sinks.refreshed(count(s.logs().where("status = 'success'")), path)
    return sinks.refreshed(count(s.logs()), path)


@query("SELECT t.*, listings_left, products_left, prices_left, alerts, linked FROM (SELECT (SELECT count(*) FROM listings) AS deleted_listings, (SELECT count(*) FROM products) AS deleted_products, (SELECT count(*) FROM prices) AS deleted_prices) t, (SELECT 0 AS listings_left, 0 AS products_left, 0 AS prices_left) l, (SELECT count(*) AS alerts, 0 AS linked FROM logs) a")
def sink_truncate(s: Star) -> DataFrame:
    """The pool is cleared: how many rows went, how many are left, and that no alert points to a listing any more."""
    rows = {"listings": s.listings(), "products": s.products(), "prices": s.prices()}
    stores = {name: Snapshots(s.spark, fresh_folder(s.spark, name)) for name in rows}
    for name, store in stores.items():
        store.replace(rows[name])
    alerts = Snapshots(s.spark, fresh_folder(s.spark, "alerts"))
    alerts.replace(s.logs().select("id", "listing_id", "status"))
    linked = F.col("listing_id").isNotNull()
    freed = alerts.replace(sinks.updated_where(alerts.read(), linked, {"listing_id": F.lit(None).cast("long")}))
    before = sinks.truncated(stores)
    told = freed.agg(F.count("*").alias("alerts"), F.count("listing_id").cast("int").alias("linked"))
    for name, store in stores.items():
        told = told.withColumn(f"deleted_{name}", F.lit(before[name]).cast("long")).join(store.read().agg(F.count("*").cast("int").alias(f"{name}_left")))
    return told


_TODAY = "(SELECT CAST(strftime(date_trunc('month', strptime(CAST(max(date_id) AS VARCHAR), '%Y%m%d')) - INTERVAL 12 MONTH, '%Y%m%d') AS INTEGER) AS today, min(date_id) AS first FROM prices)"
_ID = "CAST(strftime({}, '{}') AS INTEGER)".format
_MONTHS = f"(SELECT {_ID('m', '%Y%m')} AS month_id, {_ID('m', '%Y%m%d')} AS starts, {_ID('m + INTERVAL 1 MONTH', '%Y%m%d')} AS ends FROM {_TODAY}, generate_series(date_trunc('month', strptime(CAST(first AS VARCHAR), '%Y%m%d')), strptime(CAST(today AS VARCHAR), '%Y%m%d') + INTERVAL 3 MONTH, INTERVAL 1 MONTH) AS t(m))"


@query(f"SELECT month_id, starts, ends, count(listing_id) AS n FROM {_MONTHS} LEFT JOIN prices ON date_id // 100 = month_id GROUP BY ALL UNION ALL SELECT -1, NULL, NULL, count(*) FROM prices WHERE date_id // 100 NOT IN (SELECT month_id FROM {_MONTHS})")
def sink_add_partition(s: Star) -> DataFrame:
    """Today is a year before the last price: months until then and three more have partitions, later rows go to the default one."""
    prices = s.prices().select("listing_id", "date_id", "price")
    first, last = prices.agg(F.min("date_id"), F.max("date_id")).first()
    table = sinks.MonthlyTable(s.spark, "fact_price_" + uuid.uuid4().hex)
    with passing_folder(s.spark, "monthly") as path:
        table.create(prices, path)
        table.ensure(first, last - 10_000)
        table.insert(prices)
        try:
            return table.partitions()
        finally:
            table.drop()


@query("SELECT id FROM jobs, as_of WHERE status = 'running' AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', started_at)) > CASE job_type WHEN 'discovery' THEN 1200 ELSE 3600 END")
def sink_update(s: Star) -> DataFrame:
    """The keys of the rows that the reaper changed."""
    return sinks.changed_keys(s.jobs().select("id", "status"), lifecycle.reap(s.jobs(), s.now()).select("id", "status"), "id", ["status"])

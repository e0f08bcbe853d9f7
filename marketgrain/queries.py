"""Queries over the driver's tables, one for each operator, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.functions import money, numbers, status, text, urls
from marketgrain.operators import ingest, lifecycle, market, pool, summaries
from marketgrain.plans import pages as page_plans
from marketgrain.sources import feeds, sinks
from marketgrain.sources.star import Star, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a Star as a query, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = with_ctes(sql)
        return f

    return add


def _round(sql: str, digits: int) -> str:
    return f"floor(({sql}) * 1e{digits} + 0.5) / 1e{digits}"


# --- pool: joins, filters, sorts, pages -------------------------------------------------------------------------------

_POOL = "id, product_id, product_name, category_id, brand_id, image_url, marketplace_id, marketplace_name, domain, country_code, price, currency, in_stock, last_checked_at, price_change_pct, status"
_POOL_COLUMNS = _POOL.split(", ")


@query(f"SELECT {_POOL} FROM pool")
def proj_pool_item(s: Star) -> DataFrame:
    return pool.pool(s).select(*_POOL_COLUMNS)


@query("SELECT count(*) AS n, count(p.name) AS named, sum(l.last_price) AS total FROM listings l JOIN products p USING (product_id) JOIN marketplaces m USING (marketplace_id)")
def join_star(s: Star) -> DataFrame:
    joined = s.listings().join(s.products(), "product_id").join(F.broadcast(s.marketplaces()), "marketplace_id")
    return joined.agg(F.count("*").alias("n"), F.count("name").alias("named"), F.sum("last_price").cast("decimal(38,2)").alias("total"))


@query("SELECT l.listing_id, x.date_id, x.change_pct FROM listings l LEFT JOIN latest x USING (listing_id)")
def join_left_latest(s: Star) -> DataFrame:
    return s.listings().select("listing_id").join(pool.latest_changes(s.prices()), "listing_id", "left").select("listing_id", "date_id", "change_pct")


@query("SELECT listing_id, date_id, change_pct, price FROM latest")
def win_latest_per_listing(s: Star) -> DataFrame:
    return pool.latest_changes(s.prices())


@query("SELECT listing_id, date_id, prev AS previous_price FROM ordered_prices")
def win_prev_price(s: Star) -> DataFrame:
    return pool.with_changes(s.prices()).select("listing_id", "date_id", F.col("prev").alias("previous_price"))


@query("SELECT listing_id, date_id, price, change_pct FROM changes")
def win_price_change(s: Star) -> DataFrame:
    return pool.with_changes(s.prices()).select("listing_id", "date_id", "price", "change_pct")


@query("SELECT p.listing_id, last(p.price ORDER BY p.date_id) AS earlier_price FROM prices p JOIN (SELECT listing_id, max(date_id) AS d FROM prices GROUP BY 1) l USING (listing_id) WHERE p.date_id < l.d GROUP BY 1")
def join_prev_scalar(s: Star) -> DataFrame:
    from pyspark.sql import Window

    # one exchange by listing serves the lag and the aggregate
    lagged = s.prices().withColumn("before", F.lag("price").over(Window.partitionBy("listing_id").orderBy("date_id")))
    return lagged.groupBy("listing_id").agg(F.max_by("before", "date_id").alias("earlier_price"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT listing_id, string_agg(date_id || ':' || price || currency_code, ',' ORDER BY date_id) AS history, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY date_id DESC) AS k FROM prices) WHERE k <= 14 GROUP BY 1")
def win_topn_history(s: Star) -> DataFrame:
    text_of = F.transform("history", lambda p: F.concat(p["date_id"].cast("string"), F.lit(":"), p["price"].cast("string"), p["currency_code"]))
    return pool.histories(s.prices()).select("listing_id", F.array_join(text_of, ",").alias("history"), F.size("history").cast("long").alias("points"))


@query("SELECT count(*) AS n FROM listings WHERE is_active")
def flt_active(s: Star) -> DataFrame:
    return s.listings().where(F.col("is_active").eqNullSafe(True)).agg(F.count("*").alias("n"))


@query("SELECT id, product_name FROM pool WHERE product_name ILIKE '%a%e%'")
def flt_search(s: Star) -> DataFrame:
    return pool.search(pool.pool(s), "a%e").select("id", "product_name")


@query("SELECT id, domain, marketplace_name FROM pool WHERE domain ILIKE '%com%' OR marketplace_name ILIKE '%com%' OR marketplace_code ILIKE '%com%'")
def flt_category(s: Star) -> DataFrame:
    return pool.of_category(pool.pool(s), "com").select("id", "domain", "marketplace_name")


@query("SELECT id, price FROM pool WHERE marketplace_id = 4")
def flt_marketplace(s: Star) -> DataFrame:
    return pool.pool(s).where("marketplace_id = 4").select("id", "price")


@query("SELECT country_code, count(*) AS n FROM pool WHERE country_code NOT IN ('RU', 'BY') GROUP BY 1")
def flt_country_block(s: Star) -> DataFrame:
    return pool.visible(pool.pool(s)).groupBy("country_code").agg(F.count("*").alias("n"))


@query("SELECT id, status FROM jobs WHERE status IN ('running', 'pending') AND marketplace_id IN (1, 2, 3)")
def flt_in_list(s: Star) -> DataFrame:
    return s.jobs().where(F.col("status").isin("running", "pending") & F.col("marketplace_id").isin(1, 2, 3)).select("id", "status")


@query("SELECT listing_id, last_checked_at FROM listings, as_of WHERE is_active AND (last_checked_at IS NULL OR last_checked_at < now - INTERVAL 24 HOURS) ORDER BY last_checked_at NULLS FIRST, listing_id LIMIT 500")
def flt_stale(s: Star) -> DataFrame:
    due = s.listings().where("is_active").join(F.broadcast(s.now())).where(F.col("last_checked_at").isNull() | (F.col("last_checked_at") < F.col("now") - F.expr("INTERVAL 24 HOURS")))
    return due.orderBy(F.col("last_checked_at").asc_nulls_first(), "listing_id").limit(500).select("listing_id", "last_checked_at")


@query("SELECT listing_id FROM listings, as_of WHERE is_active AND (last_checked_at IS NULL OR last_checked_at < now - INTERVAL 6 HOURS) AND marketplace_id IN (SELECT marketplace_id FROM marketplaces WHERE is_active) ORDER BY last_checked_at NULLS FIRST, listing_id LIMIT 1000")
def flt_due_batch(s: Star) -> DataFrame:
    due = s.listings().where("is_active").join(F.broadcast(s.marketplaces().where("is_active").select("marketplace_id")), "marketplace_id", "left_semi").join(F.broadcast(s.now()))
    due = due.where(F.col("last_checked_at").isNull() | (F.col("last_checked_at") < F.col("now") - F.expr("INTERVAL 6 HOURS")))
    return due.orderBy(F.col("last_checked_at").asc_nulls_first(), "listing_id").limit(1000).select("listing_id")


@query("SELECT listing_id FROM listings JOIN products USING (product_id) WHERE is_active AND (last_price IS NULL OR image_url IS NULL) ORDER BY listing_id LIMIT 100")
def flt_incomplete(s: Star) -> DataFrame:
    joined = s.listings().where("is_active").join(s.products().select("product_id", "image_url"), "product_id")
    return joined.where("last_price is null or image_url is null").select("listing_id").orderBy("listing_id").limit(100)


@query("SELECT count(*) AS n FROM listings, as_of WHERE is_active AND last_checked_at >= now - INTERVAL 24 HOURS AND last_price IS NOT NULL")
def flt_recent_priced(s: Star) -> DataFrame:
    return s.listings().join(F.broadcast(s.now())).where("is_active and last_checked_at >= now - INTERVAL 24 HOURS and last_price is not null").agg(F.count("*").alias("n"))


@query("SELECT id FROM jobs, as_of WHERE status = 'running' AND job_type = 'scrape' AND started_at < now - INTERVAL 1 HOUR")
def flt_running_stale(s: Star) -> DataFrame:
    return s.jobs().join(F.broadcast(s.now())).where("status = 'running' and job_type = 'scrape' and started_at < now - INTERVAL 1 HOUR").select("id")


@query("SELECT p.id FROM pool p JOIN (SELECT listing_id, count(*) AS n FROM prices GROUP BY 1) h ON h.listing_id = p.id WHERE domain IN ('shop0.md', 'shop5.de') AND n >= 2 AND price BETWEEN 1000 AND 50000")
def flt_client_overview(s: Star) -> DataFrame:
    rows = pool.pool(s).where(F.col("domain").isin("shop0.md", "shop5.de") & F.col("price").between(1000, 50000))
    return rows.join(pool.histories(s.prices()), F.col("id") == F.col("listing_id")).where(F.size("history") >= 2).select("id")


@query("SELECT user_id, plan FROM users WHERE (contains(lower(name), '1') OR contains(lower(segment), 'auto')) AND plan = 'pro' AND is_active")
def flt_client_users(s: Star) -> DataFrame:
    hit = F.lower(F.coalesce("name", F.lit(""))).contains("1") | F.lower(F.coalesce("segment", F.lit(""))).contains("auto")
    return s.users().where(hit & (F.col("plan") == "pro") & F.col("is_active")).select("user_id", "plan")


@query("SELECT marketplace_id, marketplace_name || ' (' || country_code || ')' AS label FROM marketplaces WHERE contains(lower(marketplace_name || ' (' || country_code || ')'), 'r')")
def flt_facet_label(s: Star) -> DataFrame:
    label = F.concat("marketplace_name", F.lit(" ("), "country_code", F.lit(")"))
    return s.marketplaces().select("marketplace_id", label.alias("label")).where(F.lower("label").contains("r"))


@query("SELECT user_id, name FROM users WHERE user_id = 7")
def flt_user_lookup(s: Star) -> DataFrame:
    return s.users().where("user_id = 7").select("user_id", "name")


@query("SELECT currency_code, rate_to_eur FROM rates WHERE upper(currency_code) IN ('MDL', 'USD')")
def flt_favourites(s: Star) -> DataFrame:
    wanted = sorted({x.strip().upper() for x in (" mdl", "USD ", "")} - {""})
    return s.rates().where(F.upper("currency_code").isin(wanted)).select("currency_code", "rate_to_eur")


@query("SELECT currency_code, count(*) AS n FROM rates WHERE length(currency_code) = 3 AND rate_to_eur > 0 GROUP BY 1")
def flt_symbol_whitelist(s: Star) -> DataFrame:
    return s.rates().where((F.length("currency_code") == 3) & (F.col("rate_to_eur") > 0)).groupBy("currency_code").agg(F.count("*").alias("n"))


@query("SELECT id, status FROM logs WHERE status NOT IN ('success', 'error', 'timeout')")
def val_enum(s: Star) -> DataFrame:
    return sinks.invalid_rows(s.logs(), {"status": ["success", "error", "timeout"]}).select("id", "status")


@query("SELECT count(*) AS invalid FROM logs WHERE status NOT IN (" + ", ".join(f"'{x}'" for x in status.SCRAPE_STATUSES) + ")")
def val_scrape_status_db(s: Star) -> DataFrame:
    return sinks.invalid_rows(s.logs(), {"status": list(status.SCRAPE_STATUSES)}).agg(F.count("*").alias("invalid"))


_SORTS = {
    "recent": "last_checked_at DESC NULLS LAST", "name_asc": "product_name ASC NULLS LAST", "name_desc": "product_name DESC NULLS LAST", "price_asc": "price ASC NULLS LAST", "price_desc": "price DESC NULLS LAST",
    "gainers": "price_change_pct DESC NULLS LAST", "losers": "price_change_pct ASC NULLS LAST", "volatile": "abs(price_change_pct) DESC NULLS LAST", "trending": "last_checked_at DESC NULLS LAST",
}
for _mode, _order in _SORTS.items():
    query(f"SELECT id, product_name, price, price_change_pct FROM pool ORDER BY {_order}, id LIMIT 50", f"sort_pool_{_mode}")(lambda s, m=_mode: pool.page(pool.pool(s), m, 50).select("id", "product_name", "price", "price_change_pct"))


@query("SELECT id, price_change_pct FROM pool ORDER BY abs(price_change_pct) DESC NULLS LAST, id LIMIT 10")
def sort_overview_whitelist(s: Star) -> DataFrame:
    return pool.page(pool.pool(s), pool.overview_mode("unheard_of"), 10).select("id", "price_change_pct")


@query("SELECT id, product_name, price_change_pct, n AS total FROM (SELECT *, count(*) OVER () AS n FROM pool) ORDER BY price_change_pct DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def page_limit_offset(s: Star) -> DataFrame:
    total = s.listings().where("is_active").agg(F.count("*").alias("total"))
    return pool.page(pool.pool(s), "gainers", 20, 20).join(F.broadcast(total)).select("id", "product_name", "price_change_pct", "total")


@query("SELECT id, status FROM logs ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50")
def page_clamped(s: Star) -> DataFrame:
    return pool.numbered_page(s.logs(), [F.col("created_at").desc(), F.col("id").desc()], 3, 25).select("id", "status")


@query("SELECT id, created_at, 100 < (SELECT count(*) FROM logs) AS has_more FROM logs ORDER BY created_at DESC, id DESC LIMIT 100")
def page_feed(s: Star) -> DataFrame:
    logs = s.logs()
    total = logs.agg(F.count("*").alias("total"))
    return logs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(100).join(F.broadcast(total)).select("id", "created_at", (F.col("total") > 100).alias("has_more"))


@query("SELECT id, started_at FROM jobs WHERE job_type = 'scrape' ORDER BY started_at DESC, id LIMIT 20")
def topk_runs(s: Star) -> DataFrame:
    return s.jobs().where("job_type = 'scrape'").orderBy(F.col("started_at").desc(), "id").limit(min(200, max(1, 20))).select("id", "started_at")


@query("SELECT id, status FROM jobs ORDER BY CASE WHEN status = 'running' THEN 0 ELSE 1 END, started_at DESC NULLS LAST, id LIMIT 1")
def topk_current_or_latest(s: Star) -> DataFrame:
    return s.jobs().orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.col("started_at").desc_nulls_last(), "id").limit(1).select("id", "status")


@query("SELECT marketplace_code FROM marketplaces WHERE is_active ORDER BY 1")
def sort_queue(s: Star) -> DataFrame:
    return s.marketplaces().where("is_active").select("marketplace_code").orderBy("marketplace_code")


@query("SELECT greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS pages FROM pool")
def page_client(s: Star) -> DataFrame:
    return pool.pool(s).agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / 24)).alias("pages"))


@query("SELECT marketplace_id, marketplace_name, count(*) AS n FROM pool GROUP BY ALL")
def agg_categories(s: Star) -> DataFrame:
    return pool.categories(pool.pool(s))


@query(f"SELECT m.marketplace_id, marketplace_name, count(*) FILTER (WHERE l.is_active) AS active_listings, {_round('CAST(sum(last_price) FILTER (WHERE l.is_active) AS DOUBLE) / count(last_price) FILTER (WHERE l.is_active)', 2)} AS avg_price FROM marketplaces m LEFT JOIN listings l USING (marketplace_id) WHERE m.is_active GROUP BY ALL")
def agg_marketplace_stats(s: Star) -> DataFrame:
    return pool.marketplace_stats(s.listings(), s.marketplaces())


QUERIES["join_dim_outer_fact"], ORACLE_SQL["join_dim_outer_fact"] = QUERIES["agg_marketplace_stats"], ORACLE_SQL["agg_marketplace_stats"]


@query("SELECT (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM listings) AS listings, (SELECT count(*) FROM listings WHERE is_active) AS active, (SELECT count(*) FROM marketplaces WHERE is_active) AS marketplaces, (SELECT max(last_checked_at) FROM listings) AS last_update")
def agg_pool_stats(s: Star) -> DataFrame:
    listings = s.listings().agg(F.count("*").alias("listings"), F.count_if("is_active").alias("active"), F.max("last_checked_at").alias("last_update"))
    one = s.products().agg(F.count("*").alias("products")).join(F.broadcast(listings)).join(F.broadcast(s.marketplaces().agg(F.count_if("is_active").alias("marketplaces"))))
    return one.select("products", "listings", "active", "marketplaces", "last_update")


@query(f"SELECT count(*) FILTER (WHERE last_checked_at >= now - INTERVAL 24 HOURS) AS updated_24h, count(*) FILTER (WHERE abs(coalesce(price_change_pct, 0)) > 5) AS moved, {_round('coalesce(avg(abs(coalesce(price_change_pct, 0))), 0)', 4)} AS mean_change, max(last_checked_at) AS last_update FROM pool, as_of")
def agg_client_kpis(s: Star) -> DataFrame:
    return pool.kpis(pool.pool(s), s.now())


# --- summaries ---------------------------------------------------------------------------------------------------------

_DISCOUNT = _round("CAST(original_price - price AS DOUBLE) / CAST(original_price AS DOUBLE) * 100", 2)


@query(f"SELECT date_id, product_id, marketplace_id, category_id, brand_id, country_code, count(DISTINCT listing_id) AS listings, min(price) AS min_price, max(price) AS max_price, {_round('avg(CAST(price AS DOUBLE))', 2)} AS avg_price, median(CAST(price AS DOUBLE)) AS median_price, count(*) FILTER (WHERE in_stock) AS in_stock_listings, count(*) FILTER (WHERE NOT in_stock) AS out_of_stock_listings, count(*) FILTER (WHERE is_promoted) AS promoted_listings, {_round(f'avg({_DISCOUNT}) FILTER (WHERE original_price > price)', 2)} AS avg_discount FROM prices JOIN products USING (product_id) JOIN marketplaces USING (marketplace_id) GROUP BY ALL")
def agg_daily_price_summary(s: Star) -> DataFrame:
    return summaries.daily_price_summary(s.prices(), s.products(), s.marketplaces())


@query("SELECT country_code, sum(price) AS total, count(*) AS n FROM prices JOIN listings USING (listing_id) JOIN products ON products.product_id = listings.product_id JOIN marketplaces ON marketplaces.marketplace_id = listings.marketplace_id GROUP BY 1")
def join_mv_inner(s: Star) -> DataFrame:
    joined = s.prices().select("listing_id", "price").join(s.listings().select("listing_id", "product_id", "marketplace_id"), "listing_id").join(s.products().select("product_id"), "product_id").join(F.broadcast(s.marketplaces()), "marketplace_id")
    return joined.groupBy("country_code").agg(F.sum("price").cast("decimal(38,2)").alias("total"), F.count("*").alias("n"))


_HEALTH = f"SELECT m.marketplace_id, marketplace_name, count(DISTINCT l.listing_id) AS active_listings, count(DISTINCT g.id) AS scrapes_24h, count(DISTINCT g.id) FILTER (WHERE g.status = 'success') AS successes_24h, count(DISTINCT g.id) FILTER (WHERE g.status <> 'success') AS errors_24h, {_round('coalesce(CAST(count(DISTINCT g.id) FILTER (WHERE g.status = ' + chr(39) + 'success' + chr(39) + ') AS DOUBLE) / nullif(count(DISTINCT g.id), 0), 0)', 4)} AS success_ratio, {_round('avg(g.duration_ms)', 2)} AS avg_duration_ms FROM marketplaces m LEFT JOIN listings l ON l.marketplace_id = m.marketplace_id AND l.is_active LEFT JOIN (SELECT logs.* FROM logs, as_of WHERE created_at >= now - INTERVAL 24 HOURS) g ON g.marketplace_id = m.marketplace_id GROUP BY ALL"


@query(_HEALTH)
def agg_marketplace_health(s: Star) -> DataFrame:
    return summaries.marketplace_health(s.marketplaces(), s.listings(), s.logs(), s.now())


QUERIES["join_mv_fanout"], ORACLE_SQL["join_mv_fanout"] = QUERIES["agg_marketplace_health"], ORACLE_SQL["agg_marketplace_health"]
_STATS = "SELECT marketplace_id, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes, max(created_at) AS last_run, max(created_at) FILTER (WHERE status = 'success') AS last_success FROM logs GROUP BY 1"
_RATED = f"SELECT marketplace_id, runs, successes, {_round('CAST(successes AS DOUBLE) / runs * 100', 2)} AS success_rate FROM ({_STATS})"
_HEALTHY = "CASE WHEN success_rate >= 80 THEN 'healthy' WHEN success_rate >= 50 THEN 'degraded' ELSE 'failing' END"


@query(_STATS)
def agg_log_stats(s: Star) -> DataFrame:
    return summaries.log_stats(s.logs())


@query(f"SELECT marketplace_id, runs, success_rate, {_HEALTHY} AS health FROM ({_RATED})")
def agg_success_rate(s: Star) -> DataFrame:
    return summaries.success_rates(summaries.log_stats(s.logs())).select("marketplace_id", "runs", "success_rate", "health")


QUERIES["map_health"], ORACLE_SQL["map_health"] = QUERIES["agg_success_rate"], ORACLE_SQL["agg_success_rate"]


@query(f"SELECT m.marketplace_id, marketplace_name, coalesce(runs, 0) AS runs, coalesce(success_rate, 0) AS success_rate, CASE WHEN runs IS NOT NULL THEN {_HEALTHY} END AS health, coalesce(active, 0) AS active, error FROM marketplaces m LEFT JOIN ({_RATED}) r USING (marketplace_id) LEFT JOIN (SELECT marketplace_id, count(*) AS active FROM listings WHERE is_active GROUP BY 1) a USING (marketplace_id) LEFT JOIN (SELECT marketplace_id, status AS error, row_number() OVER (PARTITION BY marketplace_id ORDER BY created_at DESC, id DESC) AS k FROM logs WHERE status <> 'success') e ON e.marketplace_id = m.marketplace_id AND k = 1")
def join_three_left_aggs(s: Star) -> DataFrame:
    return summaries.marketplace_rows(s.marketplaces(), s.logs(), s.listings())


@query("SELECT m.marketplace_id, runs, last_success, j.status AS job_status FROM marketplaces m LEFT JOIN (" + _STATS + ") r USING (marketplace_id) LEFT JOIN (SELECT marketplace_id, status, row_number() OVER (PARTITION BY marketplace_id ORDER BY started_at DESC, id DESC) AS k FROM jobs) j ON j.marketplace_id = m.marketplace_id AND k = 1")
def join_two_left_aggs(s: Star) -> DataFrame:
    joined = s.marketplaces().join(summaries.log_stats(s.logs()), "marketplace_id", "left").join(summaries.latest_jobs(s.jobs()).select("marketplace_id", F.col("status").alias("job_status")), "marketplace_id", "left")
    return joined.select("marketplace_id", "runs", "last_success", "job_status")


@query("SELECT l.id, m.domain FROM logs l LEFT JOIN marketplaces m ON m.marketplace_id = l.marketplace_id WHERE l.status = 'error'")
def join_log_domain(s: Star) -> DataFrame:
    return s.logs().where("status = 'error'").join(F.broadcast(s.marketplaces()), "marketplace_id", "left").select("id", "domain")


@query("SELECT marketplace_id, id AS job_id, status, job_type, started_at FROM (SELECT *, row_number() OVER (PARTITION BY marketplace_id ORDER BY started_at DESC, id DESC) AS k FROM jobs) WHERE k = 1")
def win_latest_job(s: Star) -> DataFrame:
    return summaries.latest_jobs(s.jobs())


@query("SELECT marketplace_id, id AS log_id, status AS error, created_at AS failed_at FROM (SELECT *, row_number() OVER (PARTITION BY marketplace_id ORDER BY created_at DESC, id DESC) AS k FROM logs WHERE status <> 'success') WHERE k = 1")
def win_latest_error(s: Star) -> DataFrame:
    return summaries.latest_errors(s.logs())


@query("SELECT marketplace_id, status, count(*) AS n FROM logs GROUP BY ALL")
def agg_status_counts(s: Star) -> DataFrame:
    return s.logs().groupBy("marketplace_id", "status").agg(F.count("*").alias("n"))


@query("SELECT CAST(strftime(created_at, '%Y%m%d') AS BIGINT) AS parent_job_id, marketplace_id, count(*) FILTER (WHERE status = 'success') AS prices_saved, count(*) FILTER (WHERE status <> 'success') AS errors FROM logs GROUP BY ALL")
def agg_job_rollup(s: Star) -> DataFrame:
    return summaries.job_rollup(s.logs())


@query("SELECT parent_job_id, CAST(sum(successful) AS BIGINT) AS successful, CAST(sum(failed) AS BIGINT) AS failed, count(*) AS children FROM jobs GROUP BY 1")
def agg_job_summary(s: Star) -> DataFrame:
    return s.jobs().groupBy("parent_job_id").agg(F.sum("successful").alias("successful"), F.sum("failed").alias("failed"), F.count("*").alias("children"))


@query("SELECT parent_job_id, count(*) AS children, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (WHERE status = 'completed') = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status FROM jobs GROUP BY 1")
def agg_parent_status(s: Star) -> DataFrame:
    return summaries.parent_statuses(s.jobs())


@query("SELECT id, CASE WHEN failed = 0 THEN 'completed' WHEN successful = 0 THEN 'failed' ELSE 'partial' END AS child_status FROM jobs")
def agg_child_status(s: Star) -> DataFrame:
    return s.jobs().select("id", summaries.child_status(F.col("successful"), F.col("failed")).alias("child_status"))


@query("SELECT m.marketplace_id, coalesce(n, 0) AS products_in_pool FROM marketplaces m LEFT JOIN (SELECT marketplace_id, count(*) AS n FROM listings GROUP BY 1) USING (marketplace_id)")
def agg_active_counts(s: Star) -> DataFrame:
    counts = s.listings().groupBy("marketplace_id").agg(F.count("*").alias("n"))
    return s.marketplaces().join(counts, "marketplace_id", "left").select("marketplace_id", F.coalesce("n", F.lit(0).cast("long")).alias("products_in_pool"))


@query("SELECT marketplace_id, CASE WHEN is_active THEN CAST(floor(50000 / (SELECT count(*) FROM marketplaces WHERE is_active)) AS BIGINT) END AS quota FROM marketplaces")
def agg_quota(s: Star) -> DataFrame:
    return lifecycle.quota_share(50_000, s.marketplaces()).select("marketplace_id", "quota")


@query("SELECT max(date_id) AS newest FROM prices")
def agg_max_scalar(s: Star) -> DataFrame:
    return s.prices().agg(F.max("date_id").alias("newest"))


@query("SELECT status, max(created_at) AS newest FROM logs GROUP BY 1")
def agg_max_fetched(s: Star) -> DataFrame:
    return s.logs().groupBy("status").agg(F.max("created_at").alias("newest"))


@query("SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM marketplaces WHERE is_active) AS marketplaces, (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM listings) AS listings")
def agg_counts_admin(s: Star) -> DataFrame:
    one = s.users().agg(F.count("*").alias("users"))
    for name, df in (("marketplaces", s.marketplaces().where("is_active")), ("products", s.products()), ("listings", s.listings())):
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return one


@query("SELECT 'fact_price' AS table_name, count(*) AS n FROM prices UNION ALL SELECT 'fact_listing', count(*) FROM listings UNION ALL SELECT 'dim_product', count(*) FROM products UNION ALL SELECT 'dim_marketplace', count(*) FROM marketplaces")
def agg_table_counts(s: Star) -> DataFrame:
    frames = {"fact_price": s.prices(), "fact_listing": s.listings(), "dim_product": s.products(), "dim_marketplace": s.marketplaces()}
    counts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in frames.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


_TIER = "CASE WHEN plan = 'trial' THEN 'trial' WHEN plan IN ('business', 'pro', 'enterprise') THEN 'paid_full' ELSE 'free' END"


@query(f"SELECT user_id, n AS tracked, CASE WHEN tier = 'free' THEN 50 ELSE 999 END AS product_limit, n > CASE WHEN tier = 'free' THEN 50 ELSE 999 END AS over_limit FROM (SELECT u.user_id, {_TIER} AS tier, count(p.product_id) AS n FROM users u LEFT JOIN user_products p USING (user_id) GROUP BY ALL)")
def agg_usage(s: Star) -> DataFrame:
    counts = s.user_products().groupBy("user_id").agg(F.count("*").alias("n"))
    limit = status.product_limit(status.service_tier(F.col("plan")))
    return s.users().join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0).cast("long")).alias("tracked"), limit.alias("product_limit"), (F.coalesce("n", F.lit(0)) > limit).alias("over_limit"))


@query("SELECT u.user_id, u.name, count(p.product_id) AS tracked FROM users u LEFT JOIN user_products p USING (user_id) GROUP BY ALL")
def agg_users_tracked(s: Star) -> DataFrame:
    counts = s.user_products().groupBy("user_id").agg(F.count("*").alias("n"))
    return s.users().join(counts, "user_id", "left").select("user_id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("tracked"))


QUERIES["join_users_products"], ORACLE_SQL["join_users_products"] = QUERIES["agg_users_tracked"], ORACLE_SQL["agg_users_tracked"]


@query("SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_superuser) AS superusers, count(*) FILTER (WHERE plan = 'trial') AS trial FROM users")
def agg_users_summary(s: Star) -> DataFrame:
    return s.users().agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("is_superuser").alias("superusers"), F.count_if(F.col("plan") == "trial").alias("trial"))


@query(f"SELECT user_id, {_TIER} AS tier, CASE WHEN {_TIER} = 'free' THEN 15 ELSE 999 END AS competitor_limit, {_TIER} = 'paid_full' AS ai_analyst FROM users")
def map_plan(s: Star) -> DataFrame:
    tier = status.service_tier(F.col("plan"))
    return s.users().select("user_id", tier.alias("tier"), status.competitor_limit(tier).alias("competitor_limit"), (tier == "paid_full").alias("ai_analyst"))


@query(f"SELECT proxy, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded, {_round('CAST(count(*) FILTER (WHERE status = ' + chr(39) + 'success' + chr(39) + ') AS DOUBLE) / count(*) * 100', 1)} AS success_rate, count(*) FILTER (WHERE g IS NULL OR (created_at, id) > (g, gid)) AS consecutive_failures FROM (SELECT 'proxy' || listing_id % 20 AS proxy, logs.* FROM logs) l LEFT JOIN (SELECT 'proxy' || listing_id % 20 AS proxy, max(created_at) AS g, arg_max(id, (created_at, id)) AS gid FROM logs WHERE status = 'success' GROUP BY 1) s USING (proxy) GROUP BY 1")
def agg_proxy_stats(s: Star) -> DataFrame:
    return summaries.proxy_stats(s.logs().withColumn("proxy", F.concat(F.lit("proxy"), (F.col("listing_id") % 20).cast("string"))))


@query("SELECT listing_id, count(*) FILTER (WHERE g IS NULL OR (created_at, id) > (g, gid)) AS streak, count(*) FILTER (WHERE g IS NULL OR (created_at, id) > (g, gid)) >= 15 AS deactivated FROM logs LEFT JOIN (SELECT listing_id, max(created_at) AS g, arg_max(id, (created_at, id)) AS gid FROM logs WHERE status IN ('success', 'no_change') GROUP BY 1) USING (listing_id) GROUP BY 1")
def win_failure_streak(s: Star) -> DataFrame:
    return summaries.failure_streaks(s.logs())


_SEED = "SELECT parent_job_id // 2 AS pair, marketplace_id, CAST(successful AS BIGINT) AS created, CAST(failed AS BIGINT) AS errors, status FROM jobs WHERE job_type = "


@query(f"SELECT coalesce(d.pair, s.pair) AS pair, coalesce(d.marketplace_id, s.marketplace_id) AS marketplace_id, coalesce(d.created, s.created) AS created, coalesce(d.errors, 0) + coalesce(s.errors, 0) AS errors, coalesce(s.status, d.status) AS status FROM ({_SEED}'discovery') d FULL JOIN ({_SEED}'scrape') s ON d.marketplace_id = s.marketplace_id AND d.pair = s.pair")
def join_full_seeds(s: Star) -> DataFrame:
    """Each marketplace's discovery and the scrape of the day after it."""
    pair = F.floor(F.col("parent_job_id") / 2).cast("long")
    seed = lambda kind: s.jobs().where(F.col("job_type") == kind).select(pair.alias("pair"), "marketplace_id", F.col("successful").alias("created"), F.col("failed").alias("errors"), "status")
    return summaries.merge_seeds(seed("discovery"), seed("scrape"), ("pair", "marketplace_id"))


@query("SELECT parent_job_id, id, status FROM jobs WHERE parent_job_id IN (SELECT DISTINCT parent_job_id FROM jobs WHERE status = 'failed')")
def join_self_parent(s: Star) -> DataFrame:
    failed = s.jobs().where("status = 'failed'").select("parent_job_id").distinct()
    return s.jobs().join(failed, "parent_job_id", "left_semi").select("parent_job_id", "id", "status")


_DAY_ID = "CAST(strftime(created_at, '%Y%m%d') AS BIGINT)"


@query(f"SELECT {_DAY_ID} AS parent_job_id, marketplace_id, count(*) AS errors FROM logs ANTI JOIN (SELECT parent_job_id AS p, marketplace_id AS m FROM jobs WHERE status = 'completed') ON p = {_DAY_ID} AND m = marketplace_id GROUP BY ALL")
def join_anti_seed(s: Star) -> DataFrame:
    """Attempts of each day's job and marketplace that no completed child accounts for; counted first, then joined."""
    seeds = s.jobs().where("status = 'completed'").select("parent_job_id", "marketplace_id")
    counts = s.logs().groupBy(F.date_format("created_at", "yyyyMMdd").cast("long").alias("parent_job_id"), "marketplace_id").agg(F.count("*").alias("errors"))
    return counts.join(seeds, ["parent_job_id", "marketplace_id"], "left_anti")


@query("SELECT m.marketplace_id, coalesce(r_name, '') AS region FROM marketplaces m LEFT JOIN region ON r_regionkey = m.region_id AND r_regionkey < 3")
def join_region_lookup(s: Star) -> DataFrame:
    regions = s.table("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("region_id"), "r_name")
    return s.marketplaces().join(F.broadcast(regions), "region_id", "left").select("marketplace_id", F.coalesce("r_name", F.lit("")).alias("region"))


@query("SELECT l.listing_id, m.domain, p.image_url FROM listings l JOIN marketplaces m USING (marketplace_id) LEFT JOIN products p USING (product_id) ORDER BY last_checked_at DESC NULLS LAST, listing_id LIMIT 20")
def join_diag_mixed(s: Star) -> DataFrame:
    newest = s.listings().join(F.broadcast(s.marketplaces()), "marketplace_id").join(s.products(), "product_id", "left")
    return newest.orderBy(F.col("last_checked_at").desc_nulls_last(), "listing_id").limit(20).select("listing_id", "domain", "image_url")


@query("SELECT date_id, count(*) AS n FROM prices GROUP BY 1")
def join_price_calendar(s: Star) -> DataFrame:
    """Every price with its day of the calendar from the first to the last shipment, whose days bound what is broadcast."""
    first, last = s.table("lineitem").agg(F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))).first()
    days = numbers.calendar(s.spark, str(first), str(last)).select("date_id")
    return s.prices().join(F.broadcast(days), "date_id").groupBy("date_id").agg(F.count("*").alias("n"))


@query("SELECT session_id, position, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS k FROM messages) WHERE k <= 20")
def win_last_n_messages(s: Star) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("position").desc()))
    return s.messages().withColumn("k", k).where("k <= 20").select("session_id", "position", "role").orderBy("session_id", "position")


@query("SELECT marketplace_id, day, n FROM (SELECT *, max(stop) OVER (PARTITION BY marketplace_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM (SELECT *, CASE WHEN max(n) OVER (PARTITION BY marketplace_id ORDER BY day ROWS 2 PRECEDING) = 0 AND row_number() OVER (PARTITION BY marketplace_id ORDER BY day) >= 3 THEN 1 ELSE 0 END AS stop FROM (SELECT marketplace_id, CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS day, count(*) FILTER (WHERE status = 'success' AND listing_id % 4 = 1) AS n FROM logs GROUP BY ALL))) WHERE coalesce(ended, 0) = 0")
def win_convergence(s: Star) -> DataFrame:
    fresh = F.count_if((F.col("status") == "success") & (F.col("listing_id") % 4 == 1))
    steps = s.logs().groupBy(F.col("marketplace_id").alias("group"), F.date_format("created_at", "yyyyMMdd").cast("int").alias("step")).agg(fresh.alias("new_rows"))
    return summaries.convergence(steps).select(F.col("group").alias("marketplace_id"), F.col("step").alias("day"), F.col("new_rows").alias("n"))


# --- text, urls, numbers, dates, json ----------------------------------------------------------------------------------


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 500) AS name_normalized FROM part")
def txt_name_norm(s: Star) -> DataFrame:
    return s.table("part").select("p_partkey", text.normal_name(F.col("p_name")).alias("name_normalized"))


_CONTAINED = lambda table, column: "CASE " + " ".join(f"WHEN contains(lower({column}), '{t}') THEN '{v}'" for t, v in table) + " END"


@query(f"SELECT doc_id, {_CONTAINED(text.SYMBOLS, 'text')} AS currency FROM documents")
def txt_currency_symbol(s: Star) -> DataFrame:
    return s.table("documents").select("doc_id", text.currency_symbol(F.col("text")).alias("currency"))


@query(f"SELECT doc_id, {_CONTAINED(text.CODES, 'text')} AS currency FROM documents")
def txt_currency_code(s: Star) -> DataFrame:
    return s.table("documents").select("doc_id", text.currency_code(F.col("text")).alias("currency"))


@query(f"SELECT item_id, coalesce({_CONTAINED(text.SYMBOLS, 'text')}, {_CONTAINED(text.CODES, 'text')}) AS currency FROM benchmark")
def txt_currency(s: Star) -> DataFrame:
    return s.table("benchmark").select("item_id", text.currency(F.col("text")).alias("currency"))


def _contains_any(words) -> str:
    return "(" + " OR ".join("contains(near, '" + w.replace("'", "''") + "')" for w in words) + ")"


# the numbers, pattern and words of the rule are spelt out here, so that a slip in the implementation's shows
_SHAPE = r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
_SPEAKS_FOR = ["price", "цена", "стоимость", "total", "итого", "sale"]
_SPEAKS_AGAINST = ["%", "cashback", "кэшбэк", "bonus", "бонус", "скидка", "discount", "save", "эконом"]
_PRICE_SQL = f"""
WITH t AS (SELECT doc_id, translate(text, chr(160) || chr(8239) || chr(8201), '   ') AS s FROM documents),
p AS (SELECT doc_id, s, regexp_extract_all(s, '{_SHAPE}') AS tokens, regexp_split_to_array(s, '{_SHAPE}') AS rest FROM t),
u AS (SELECT doc_id, s, tokens[i] AS token, list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(tokens[1:i - 1], lambda x: length(x))), 0) AS start FROM p, generate_series(1, len(tokens)) AS g(i)),
v AS (SELECT *, replace(token, ' ', '') AS bare, regexp_replace(token, '[0-9 ]', '', 'g') AS marks, length(regexp_extract(token, '([0-9]*)$', 1)) AS tail, lower(substr(s, CAST(greatest(start - 20, 0) + 1 AS BIGINT), CAST(start - greatest(start - 20, 0) + length(token) + 20 AS BIGINT))) AS near FROM u),
w AS (SELECT doc_id, near, regexp_replace(bare, '[.,]', '', 'g') AS digits, tail, CASE
  WHEN contains(marks, '.') AND contains(marks, ',') THEN CASE WHEN length(marks) - length(replace(marks, right(marks, 1), '')) = 1 THEN 'decimal' ELSE 'odd' END
  WHEN marks = '' OR tail > 2 THEN 'whole' WHEN length(marks) = 1 OR right(marks, 1) = ',' THEN 'decimal' ELSE 'odd' END AS kind FROM v),
x AS (SELECT doc_id, near, CASE kind WHEN 'whole' THEN TRY_CAST(digits AS DOUBLE) WHEN 'decimal' THEN TRY_CAST(left(digits, length(digits) - tail) || '.' || right(digits, tail) AS DOUBLE) END AS value FROM w),
y AS (SELECT doc_id, value, {_contains_any([t for t, _ in text.SYMBOLS + text.CODES])} AS money, {_contains_any(_SPEAKS_FOR)} AS speaks_for, {_contains_any(_SPEAKS_AGAINST)} AS speaks_against FROM x WHERE value > 0),
z AS (SELECT doc_id, value, 8 * CAST(money AS INT) + 4 * CAST(speaks_for AS INT) - 6 * CAST(speaks_against AS INT) - 3 * CAST(value < 1 AS INT) - 20 * CAST(value > 5000000 AS INT) AS points FROM y WHERE value <= 5000000 OR money)
SELECT doc_id, CASE WHEN best <= 5000000 THEN best END AS price FROM (SELECT doc_id, (SELECT value FROM z WHERE z.doc_id = documents.doc_id ORDER BY points DESC, value DESC LIMIT 1) AS best FROM documents)"""


@query(_PRICE_SQL)
def txt_price(s: Star) -> DataFrame:
    return s.table("documents").select("doc_id", text.price("text").alias("price"))


@query("SELECT p_partkey, trim(coalesce(p_name, '')) = '' OR lower(trim(p_name)) = 'product' OR regexp_matches(regexp_replace(trim(p_name), '[ _-]', '', 'g'), '^\\d+$') AS placeholder FROM part")
def txt_placeholder(s: Star) -> DataFrame:
    return s.table("part").select("p_partkey", text.is_placeholder(F.col("p_name"), F.lit("http://x.example/")).alias("placeholder"))


@query("SELECT page_id, substr(CASE WHEN t <> '' THEN t ELSE url END, 1, 500) AS title FROM (SELECT page_id, url, translate(list_extract(string_split(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', ''), '/'), -1), '-_', '  ') AS t FROM pages)")
def txt_title_from_url(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", text.title_from_url(F.col("url")).alias("title"))


@query("SELECT doc_id, CASE WHEN length(t) > 480 THEN substr(t, 1, 477) || '...' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def txt_relay_line(s: Star) -> DataFrame:
    return s.table("documents").select("doc_id", text.relay_line(F.col("text")).alias("line"))


@query("SELECT page_id, regexp_replace(replace(url, '://', '://user:pw@'), '://[^/@]*@', '://***@') AS masked FROM pages")
def str_mask(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", text.masked_url(F.replace("url", F.lit("://"), F.lit("://user:pw@"))).alias("masked"))


@query("SELECT page_id, sha256(lower(rtrim(trim(url), '/'))) AS url_hash FROM pages")
def url_hash(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT page_id, 'https://' || regexp_replace(regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), ':\\d*$', ''), '^www\\.', '') AS host FROM pages")
def url_normalise_host(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", urls.normal_host(F.col("url")).alias("host"))


@query("SELECT page_id, CASE WHEN length(c) <= 50 THEN c ELSE substr(c, 1, 39) || '_' || substr(sha256(h), 1, 10) END AS code FROM (SELECT page_id, h, regexp_replace(replace(lower(h), '.', '_'), '[^a-z0-9._-]', '_', 'g') AS c FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) || '.' || repeat('x', page_id % 60) AS h FROM pages))")
def url_marketplace_code(s: Star) -> DataFrame:
    host = F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("."), F.repeat(F.lit("x"), (F.col("page_id") % 60).cast("int")))
    return s.table("pages").select("page_id", urls.marketplace_code(host).alias("code"))


@query("SELECT marketplace_id, coalesce(c.country_code, 'US') AS country FROM marketplaces m LEFT JOIN (SELECT DISTINCT country_code FROM mp_literal) c ON c.country_code = upper(regexp_extract(domain, '[^.]*$'))")
def url_country(s: Star) -> DataFrame:
    known = s.marketplaces().select(F.col("country_code").alias("c")).distinct()
    tld = F.upper(F.regexp_extract("domain", "([^.]*)$", 1))
    return s.marketplaces().join(F.broadcast(known), tld == F.col("c"), "left").select("marketplace_id", F.coalesce("c", F.lit("US")).alias("country"))


_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_SEGMENTS = "list_filter(string_split(lower(p), '/'), lambda x: x <> '')"
_HINTS = " OR ".join(f"contains(lower(p), '{h}')" for h in urls.PRODUCT_HINTS)
_WITH_PATH = f"(SELECT page_id, url, {_PATH} AS p FROM pages)"


@query(f"SELECT page_id, {_HINTS} OR regexp_matches(lower(p), '/(catalog|detail)/\\d{{4,}}|/(product|tovar|sku)/[\\w-]{{4,}}|/p/\\d+|/\\d{{4,}}|\\.html') OR len({_SEGMENTS}) >= 3 AS is_product FROM {_WITH_PATH}")
def url_is_product(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", urls.is_product(urls.path_of(F.col("url"))).alias("is_product"))


@query(f"SELECT page_id, regexp_matches(lower(coalesce({_SEGMENTS}[-1], '')), '\\.html?$|-\\d{{6,}}([-/_.]|$)|^\\d{{6,}}$') AS is_slug FROM {_WITH_PATH}")
def url_is_slug(s: Star) -> DataFrame:
    last = F.coalesce(F.try_element_at(urls.segments(urls.path_of(F.col("url"))), F.lit(-1)), F.lit(""))
    return s.table("pages").select("page_id", urls.is_slug(last).alias("is_slug"))


_SLUG = "regexp_matches(seg[-1], '\\.html?$|-\\d{6,}([-/_.]|$)|^\\d{6,}$')"


@query(f"SELECT page_id, CASE WHEN len(seg) = 0 THEN TRUE WHEN len(seg) = 1 THEN NOT (length(seg[-1]) >= 16 AND regexp_matches(seg[-1], '-|\\d')) WHEN {_SLUG} THEN FALSE WHEN list_has_any(seg, [{', '.join(repr(x) for x in urls.CATEGORY_SEGMENTS)}]) THEN TRUE WHEN contains(lower(p), '.html') OR regexp_matches(lower(p), '\\d{{4,}}') THEN FALSE ELSE len(seg) = 3 AND length(seg[-1]) < 15 END AS is_category FROM (SELECT *, {_SEGMENTS} AS seg FROM {_WITH_PATH})")
def url_is_category(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", urls.is_category(urls.path_of(F.col("url"))).alias("is_category"))


@query(f"SELECT page_id, regexp_matches(lower(url), '{'|'.join(urls.EXCLUDED)}') AS is_excluded FROM pages")
def url_is_excluded(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", urls.is_excluded(F.col("url")).alias("is_excluded"))


_SEEDS_SQL = "SELECT page_id, CASE WHEN host = '' THEN url ELSE array_to_string(list_filter(all_, lambda x, i: list_position(all_, x) = i), ' ') END AS candidates FROM (SELECT page_id, url, host, CASE WHEN bare <> '' THEN [url, host || '/' || bare] ELSE [url] END || [{paths}] AS all_ FROM (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS host, trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS bare FROM pages))".format(paths=", ".join(f"host || '{p}'" for p in urls.SEED_PATHS))


@query(_SEEDS_SQL)
def url_seed_candidates(s: Star) -> DataFrame:
    return s.table("pages").select("page_id", F.array_join(urls.seed_candidates(F.col("url")), " ").alias("candidates"))


@query("SELECT listing_id, date_id, change_pct FROM changes WHERE change_pct IS NOT NULL")
def num_change_pct(s: Star) -> DataFrame:
    return pool.with_changes(s.prices()).where("change_pct is not null").select("listing_id", "date_id", "change_pct")


@query(f"SELECT listing_id, date_id, CASE WHEN original_price > 0 AND price > 0 AND original_price > price THEN {_DISCOUNT} END AS discount_pct FROM prices")
def num_discount_pct(s: Star) -> DataFrame:
    return s.prices().select("listing_id", "date_id", numbers.discount_pct(F.col("original_price"), F.col("price")).alias("discount_pct"))


@query("SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(d AS DATE) AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(weekofyear(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_weekday, dayname(d) AS day_name, monthname(d) AS month_name, isodow(d) >= 6 AS is_weekend, CAST(d AS DATE) = last_day(d) AS is_month_end FROM (SELECT DISTINCT date_trunc('day', l_shipdate) AS d FROM lineitem WHERE l_shipdate IS NOT NULL)")
def date_dim_row(s: Star) -> DataFrame:
    return numbers.date_rows(s.table("lineitem").select(F.to_date("l_shipdate").alias("d")).where("d is not null").distinct(), "d")


@query("SELECT DISTINCT date_id, CAST(strftime(date_trunc('month', d), '%Y%m%d') AS INTEGER) AS month_start, CAST(strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y%m%d') AS INTEGER) AS next_start FROM (SELECT date_id, strptime(CAST(date_id AS VARCHAR), '%Y%m%d') AS d FROM prices)")
def date_month_bounds(s: Star) -> DataFrame:
    start, end = numbers.month_bounds(F.col("date_id"))
    return s.prices().select("date_id").distinct().select("date_id", start.alias("month_start"), end.alias("next_start"))




@query(f"SELECT id, {_round('CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE) / 1e6', 3)} AS seconds FROM jobs")
def date_duration(s: Star) -> DataFrame:
    return s.jobs().select("id", numbers.duration_seconds(F.lit(None), F.col("started_at"), F.col("completed_at")).alias("seconds"))


@query("SELECT id, CASE WHEN a < 60 THEN a || 's ago' WHEN floor(a / 60.0 + 0.5) < 60 THEN CAST(floor(a / 60.0 + 0.5) AS BIGINT) || 'm ago' WHEN floor(a / 3600.0 + 0.5) < 24 THEN CAST(floor(a / 3600.0 + 0.5) AS BIGINT) || 'h ago' WHEN floor(a / 86400.0 + 0.5) < 7 THEN CAST(floor(a / 86400.0 + 0.5) AS BIGINT) || 'd ago' ELSE strftime(created_at, '%Y-%m-%d') END AS ago FROM (SELECT id, created_at, CAST(floor(epoch(now)) AS BIGINT) - CAST(floor(epoch(created_at)) AS BIGINT) AS a FROM logs, as_of)")
def date_ago_bucket(s: Star) -> DataFrame:
    return s.logs().join(F.broadcast(s.now())).select("id", numbers.ago_bucket(F.col("created_at"), F.col("now")).alias("ago"))


@query("SELECT id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM logs")
def json_path(s: Star) -> DataFrame:
    get = lambda p: F.get_json_object("props", p)
    return s.logs().select("id", F.coalesce(get("$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(get("$.missing"), F.lit("none")).alias("missing"))


@query("SELECT marketplace_id, array_to_string(list_filter([trim(x) FOR x IN [' ' || marketplace_code || ' ', '  ', country_code]], lambda y: y <> ''), ',') AS codes FROM marketplaces")
def json_codes(s: Star) -> DataFrame:
    raw = F.to_json(F.array(F.concat(F.lit(" "), "marketplace_code", F.lit(" ")), F.lit("  "), "country_code"))
    codes = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return s.marketplaces().select("marketplace_id", F.array_join(F.when(F.size(codes) > 0, codes), ",").alias("codes"))


@query("SELECT id, CASE WHEN status IN ('running', 'completed', 'failed', 'partial') THEN status WHEN status = 'pending' THEN 'running' ELSE 'failed' END AS normal, CASE WHEN status IN ('running', 'pending') THEN 'running' WHEN status IN ('completed', 'partial') THEN 'completed' ELSE 'failed' END AS shown FROM jobs")
def map_job_status(s: Star) -> DataFrame:
    normal = status.job_status(F.col("status"))
    return s.jobs().select("id", normal.alias("normal"), status.shown_status(normal).alias("shown"))


QUERIES["map_frontend_status"], ORACLE_SQL["map_frontend_status"] = QUERIES["map_job_status"], ORACLE_SQL["map_job_status"]


@query("SELECT l.id, CASE WHEN j.status IN ('running', 'completed', 'failed', 'partial') THEN j.status WHEN j.status = 'pending' THEN 'running' WHEN l.status IN ('success') THEN 'completed' WHEN l.status IN ('error', 'timeout') THEN 'failed' ELSE 'running' END AS status FROM logs l LEFT JOIN jobs j ON j.id = l.id")
def map_marketplace_status(s: Star) -> DataFrame:
    jobs = s.jobs().select("id", F.col("status").alias("job"))
    return s.logs().join(jobs, "id", "left").select("id", status.marketplace_status(F.col("job"), F.col("status")).alias("status"))


@query("SELECT id, CASE WHEN status IN ('success') THEN 'success' WHEN status = 'timeout' THEN 'timeout' ELSE 'error' END AS status FROM logs")
def map_scrape_status(s: Star) -> DataFrame:
    return s.logs().select("id", status.scrape_status(F.concat(F.lit(" "), F.upper("status"))).alias("status"))




@query("SELECT marketplace_id, CASE WHEN marketplace_id % 2 = 0 THEN CASE WHEN is_active THEN 'decodo,playwright,httpx' ELSE 'playwright,httpx' END ELSE CASE WHEN is_active THEN 'httpx,decodo,playwright' ELSE 'httpx,playwright' END END AS layers FROM marketplaces")
def map_layer_order(s: Star) -> DataFrame:
    return s.marketplaces().select("marketplace_id", F.array_join(status.layer_order(F.col("marketplace_id") % 2 == 0, F.col("is_active")), ",").alias("layers"))


@query("SELECT id, CASE WHEN successful > 0 THEN 5 ELSE least(marketplace_id * 5 * 2, 60) END AS delay FROM jobs")
def map_backoff(s: Star) -> DataFrame:
    return s.jobs().select("id", status.backoff(F.col("marketplace_id") * 5, F.col("successful")).alias("delay"))


@query("SELECT listing_id, coalesce(last_checked_at, TIMESTAMP '2020-01-01') AS value, array_to_string(list_filter([CASE WHEN last_checked_at IS NULL THEN 'checked' END, CASE WHEN last_in_stock IS NULL THEN 'stock' END, CASE WHEN is_active IS NULL THEN 'active' END], lambda x: x IS NOT NULL), ',') AS missing FROM listings")
def arr_missing_fields(s: Star) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("last_checked_at", "checked"), ("last_in_stock", "stock"), ("is_active", "active"))]))
    return s.listings().select("listing_id", F.coalesce("last_checked_at", F.lit("2020-01-01").cast("timestamp")).alias("value"), F.array_join(missing, ",").alias("missing"))

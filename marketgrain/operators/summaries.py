"""Daily price summary, marketplace health, log and job figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions import status
from marketgrain.functions.numbers import discount_pct


def half_up(value, digits: int):
    """Round a double half up; the same on every engine."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def daily_price_summary(prices: DataFrame, products: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """One row for each date, product, marketplace, category, brand and country."""
    joined = prices.join(products.select("product_id", "category_id", "brand_id"), "product_id").join(F.broadcast(marketplaces.select("marketplace_id", "country_code")), "marketplace_id")
    discount = discount_pct(F.col("original_price"), F.col("price"))
    return joined.withColumn("discount", discount).groupBy("date_id", "product_id", "marketplace_id", "category_id", "brand_id", "country_code").agg(
        F.count_distinct("listing_id").alias("listings"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        half_up(F.avg(F.col("price").cast("double")), 2).alias("avg_price"),
        F.median(F.col("price").cast("double")).alias("median_price"),
        F.count_if("in_stock").alias("in_stock_listings"),
        F.count_if(~F.col("in_stock")).alias("out_of_stock_listings"),
        F.count_if("is_promoted").alias("promoted_listings"),
        half_up(F.avg("discount"), 2).alias("avg_discount"),
    )


def marketplace_health(marketplaces: DataFrame, listings: DataFrame, logs: DataFrame, now: DataFrame) -> DataFrame:
    """Active listings, and attempts within a day. Each side is aggregated before the join, so nothing fans out."""
    active = listings.where(F.col("is_active").eqNullSafe(True)).groupBy("marketplace_id").agg(F.count_distinct("listing_id").alias("active_listings"))
    recent = logs.join(F.broadcast(now)).where(F.col("created_at") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    runs = recent.groupBy("marketplace_id").agg(F.count("*").alias("scrapes"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") != "success").alias("errors"), F.sum(F.col("duration_ms").cast("long")).alias("ms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = marketplaces.join(active, "marketplace_id", "left").join(runs, "marketplace_id", "left")
    return joined.select(
        "marketplace_id",
        "marketplace_name",
        zero(F.col("active_listings")).alias("active_listings"),
        zero(F.col("scrapes")).alias("scrapes_24h"),
        zero(F.col("successes")).alias("successes_24h"),
        zero(F.col("errors")).alias("errors_24h"),
        half_up(F.coalesce(F.try_divide(F.col("successes").cast("double"), F.col("scrapes")), F.lit(0.0)), 4).alias("success_ratio"),
        half_up(F.try_divide(F.col("ms").cast("double"), F.col("scrapes")), 2).alias("avg_duration_ms"),
    )


def log_stats(logs: DataFrame) -> DataFrame:
    """Runs, successes, last run and last success of each marketplace."""
    good = F.col("status") == "success"
    return logs.groupBy("marketplace_id").agg(F.count("*").alias("runs"), F.count_if(good).alias("successes"), F.max("created_at").alias("last_run"), F.max(F.when(good, F.col("created_at"))).alias("last_success"))


def success_rates(stats: DataFrame) -> DataFrame:
    rate = half_up(F.coalesce(F.try_divide(F.col("successes").cast("double"), F.col("runs")), F.lit(0.0)) * 100, 2)
    return stats.withColumn("success_rate", rate).withColumn("health", status.health(F.col("success_rate"), F.col("runs")))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each marketplace."""
    return jobs.where("marketplace_id is not null").groupBy("marketplace_id").agg(F.max(F.struct("started_at", "id", "status", "job_type")).alias("x")).select("marketplace_id", F.col("x.id").alias("job_id"), "x.status", "x.job_type", "x.started_at")


def latest_errors(logs: DataFrame) -> DataFrame:
    """The newest attempt without success of each marketplace."""
    return logs.where("status <> 'success'").groupBy("marketplace_id").agg(F.max(F.struct("created_at", "id", "status")).alias("x")).select("marketplace_id", F.col("x.id").alias("log_id"), F.col("x.status").alias("error"), F.col("x.created_at").alias("failed_at"))


def marketplace_rows(marketplaces: DataFrame, logs: DataFrame, listings: DataFrame) -> DataFrame:
    """Each marketplace with its runs, active listings and latest error."""
    active = listings.where(F.col("is_active").eqNullSafe(True)).groupBy("marketplace_id").agg(F.count("*").alias("active"))
    rated = success_rates(log_stats(logs)).select("marketplace_id", "runs", "success_rate", "health")
    joined = marketplaces.join(rated, "marketplace_id", "left").join(active, "marketplace_id", "left").join(latest_errors(logs).select("marketplace_id", "error"), "marketplace_id", "left")
    return joined.select("marketplace_id", "marketplace_name", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"), "health", F.coalesce("active", F.lit(0).cast("long")).alias("active"), "error")


def job_rollup(logs: DataFrame) -> DataFrame:
    """Prices saved and failures of each day's job and marketplace."""
    day = F.date_format("created_at", "yyyyMMdd").cast("long")
    return logs.groupBy(day.alias("parent_job_id"), "marketplace_id").agg(F.count_if(F.col("status") == "success").alias("prices_saved"), F.count_if(F.col("status") != "success").alias("errors"))


def parent_statuses(jobs: DataFrame) -> DataFrame:
    """completed if all children are, failed if none is or one failed hard, else partial."""
    done, n = F.count_if(F.col("status") == "completed"), F.count("*")
    hard = F.count_if(F.col("status") == "failed")
    return jobs.groupBy("parent_job_id").agg(n.alias("children"), F.when(hard > 0, "failed").when(done == n, "completed").when(done == 0, "failed").otherwise("partial").alias("status"))


def child_status(succeeded, failed):
    return F.when(failed == 0, "completed").when(succeeded == 0, "failed").otherwise("partial")


def failure_streaks(logs: DataFrame, limit: int = 15) -> DataFrame:
    """Each listing's failures since its last success, and whether they deactivate it. Days are counted first, so that a hot
    listing's attempts are combined before they meet: failures of later days count whole, and those of the last good day
    as they were counted after that day's last success."""
    since = _since_last_good(logs, "listing_id", ("success", "no_change"))
    return since.select("listing_id", F.col("since").alias("streak"), (F.col("since") >= limit).alias("deactivated"))


def _since_last_good(attempts: DataFrame, key: str, statuses: tuple[str, ...]) -> DataFrame:
    """key, since: attempts after the last one with one of the statuses."""
    good = F.col("status").isin(*statuses)
    order = Window.partitionBy(key, "_day").orderBy(F.col("created_at").desc(), F.col("id").desc())
    # within a day, from its end: failures before the first success met
    met = attempts.withColumn("_day", F.to_date("created_at")).withColumn("_met", F.max(good).over(order))
    days = met.groupBy(key, "_day").agg(F.count_if(~F.col("_met")).alias("n"), F.max(good).alias("_good"))
    last = days.groupBy(key).agg(F.max(F.when(F.col("_good"), F.col("_day"))).alias("_last"))
    later = days.join(last, key).where(F.col("_last").isNull() | (F.col("_day") >= F.col("_last")))
    return later.groupBy(key).agg(F.sum("n").alias("since"))


def merge_seeds(discovery: DataFrame, scrape: DataFrame, keys: tuple[str, ...] = ("marketplace_id",)) -> DataFrame:
    """Two child rows with the same keys as one: discovery's figures, the scrape's status, both errors; one alone as it is."""
    d, s = discovery.withColumn("_d", F.lit(True)).alias("d"), scrape.withColumn("_s", F.lit(True)).alias("s")
    same, both = F.lit(True), F.col("d._d").isNotNull() & F.col("s._s").isNotNull()
    for k in keys:
        same = same & (F.col(f"d.{k}") == F.col(f"s.{k}"))
    pick = lambda c: F.coalesce(F.col(f"d.{c}"), F.col(f"s.{c}"))
    return d.join(s, same, "full_outer").select(
        *[pick(k).alias(k) for k in keys],
        pick("created").alias("created"),
        (F.coalesce(F.col("d.errors"), F.lit(0)) + F.coalesce(F.col("s.errors"), F.lit(0))).cast("long").alias("errors"),
        F.when(both, F.col("s.status")).otherwise(pick("status")).alias("status"),
    )


def child_seeds(jobs: DataFrame) -> DataFrame:
    """Each child job as a seed of its parent's result: a discovery brings listings, a scrape none; prices come from logs."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = F.floor((micros("completed_at") - micros("started_at")) / 1000).cast("long")
    created = F.when(F.col("job_type") == "discovery", F.col("successful")).otherwise(0).cast("long")
    return jobs.where(F.col("job_type").isin("discovery", "scrape")).select("parent_job_id", "marketplace_id", "job_type", created.alias("created"), F.lit(0).cast("long").alias("prices_saved"), F.col("failed").cast("long").alias("errors"), ms.alias("duration_ms"), "status")


def completed(seeds: DataFrame, rollup: DataFrame) -> DataFrame:
    """A parent's result: its children's seeds and its logs' figures by marketplace, summed, and its status. A marketplace that
    only logs know failed if it has errors; seeds keep their own status."""
    key = ["parent_job_id", "marketplace_id"]
    found = seeds.select(*key, "created", F.col("errors").alias("seed_errors"), "status").join(rollup.select(*key, "prices_saved", F.col("errors").alias("log_errors")), key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = found.withColumn("status", F.coalesce("status", F.when(F.col("log_errors") > 0, "failed").otherwise("completed")))
    done, n = F.count_if(F.col("status") == "completed"), F.count("*")
    return rows.groupBy("parent_job_id").agg(
        n.alias("marketplaces"),
        F.sum(zero("created")).alias("created"),
        F.sum(zero("prices_saved")).alias("prices_saved"),
        F.sum(zero("seed_errors") + zero("log_errors")).alias("errors"),
        F.when(done == n, "completed").when(done == 0, "failed").otherwise("partial").alias("status"),
    )


def proxy_stats(attempts: DataFrame) -> DataFrame:
    """Totals of each proxy (column ``proxy``), success rate with one decimal, and failures since its last success."""
    good = F.col("status") == "success"
    totals = attempts.groupBy("proxy").agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"))
    rate = half_up(F.col("succeeded").cast("double") / F.col("total") * 100, 1)
    since = _since_last_good(attempts, "proxy", ("success",))
    return totals.join(since, "proxy", "left").select("proxy", "total", "succeeded", rate.alias("success_rate"), F.coalesce("since", F.lit(0).cast("long")).alias("consecutive_failures"))


def job_progress(elapsed, done, estimated):
    """speed (steps a minute, three decimals) and eta (seconds until all estimated steps are done, three decimals), each null unless all it
    needs is positive; no eta where nothing is left."""
    speed = F.when((elapsed > 0) & (done > 0), done.cast("double") / elapsed)
    left = F.when(estimated > done, estimated - done)
    return F.struct(half_up(speed * 60, 3).alias("speed"), half_up(left / speed, 3).alias("eta"))


def convergence(steps: DataFrame, quiet: int = 3) -> DataFrame:
    """The steps (group, step, new_rows) up to the first run of ``quiet`` steps without new rows."""
    w = Window.partitionBy("group").orderBy("step")
    recent = F.max("new_rows").over(w.rowsBetween(-(quiet - 1), 0))
    counted = F.count("*").over(w)
    stop = F.max(F.when((recent == 0) & (counted >= quiet), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_stop", stop).where(F.coalesce("_stop", F.lit(0)) == 0).drop("_stop")

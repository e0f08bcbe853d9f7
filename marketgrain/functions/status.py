"""Status, plan and error vocabularies on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOB_STATUSES = ("running", "completed", "failed", "partial")
#: Every status that a scrape log may have.
SCRAPE_STATUSES = (
    "success", "no_change", "error", "timeout", "blocked", "captcha", "not_found", "price_not_found", "parse_error", "missing_critical_data", "technical_error", "fetch_failed", "parse_failed", "quota_exceeded", "persist_failed",
)


def health(rate: Column, runs: Column) -> Column:
    return F.when(runs <= 0, F.lit(None).cast("string")).when(rate >= 80, "healthy").when(rate >= 50, "degraded").otherwise("failing")


def job_status(raw: Column) -> Column:
    return F.when(raw.isin(*JOB_STATUSES), raw).when(raw == "pending", "running").otherwise("failed")


def marketplace_status(job: Column, scrape: Column) -> Column:
    last = F.lower(F.trim(F.coalesce(scrape, F.lit(""))))
    return (
        F.when(job.isin(*JOB_STATUSES), job)
        .when(job == "pending", "running")
        .when(last.isin("success", "completed", "ok"), "completed")
        .when(last.isin("failed", "error", "timeout", "blocked"), "failed")
        .otherwise("running")
    )


def shown_status(normal: Column) -> Column:
    return F.when(normal == "running", "running").when(normal.isin("completed", "partial"), "completed").otherwise("failed")


def scrape_status(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(s.isin("success", "ok", "completed", "done"), "success")
        .when(s.isin("timeout", "timed_out"), "timeout")
        .when(s.isin("blocked", "forbidden", "403", "429"), "blocked")
        .otherwise("error")
    )


def failure_log_status(error: Column) -> Column:
    """The log status of a failed attempt, from its error text."""
    e, status = F.lower(F.coalesce(error, F.lit(""))), F.lit("error")
    for part in ("timeout", "blocked", "captcha", "not_found", "price_not_found", "parse_error"):  # the last one tried wins
        status = F.when(e.contains(part), part).otherwise(status)
    return F.when(e.startswith("exception:"), "technical_error").otherwise(status)


def log_status(success: Column, error: Column, empty: Column, title: Column, price: Column, currency: Column, partial: Column) -> Column:
    """The log status of an attempt."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return (
        F.when(~success, failure_log_status(error))
        .when(empty, "missing_critical_data")
        .when(price.isNotNull() & blank(currency), "missing_critical_data")
        .when(blank(title), "missing_critical_data")
        .when(price.isNull(), "price_not_found")
        .when(partial, "missing_critical_data")
        .otherwise("success")
    )


def error_category(error: Column) -> Column:
    e = F.lower(error)
    return (
        F.when(error.isNull() | (error == ""), F.lit(None).cast("string"))
        .when(e.contains("fetch") | e.contains("network"), "network")
        .when(e.contains("parse") | e.contains("extract"), "parse")
        .when(e.contains("timeout"), "network")
        .when(e.contains("blocked") | e.contains("captcha"), "auth")
        .when(e.contains("rate"), "rate_limit")
        .otherwise("parse")
    )


def layer_error(code: Column, layer: Column) -> Column:
    """A fetch layer's error as ``kind:layer``."""
    c = F.lower(F.coalesce(code, F.lit("fetch_failed")))
    kind = F.when(c.startswith("timeout"), "timeout").when(c.isin("blocked", "captcha", "not_found", "rate_limit"), c).otherwise("fetch_failed")
    return F.concat(kind, F.lit(":"), layer)


def stage(current: Column, status: Column, has_task: Column, has_log: Column) -> Column:
    """A pipeline's stage for display; only a running job's stage is corrected."""
    waiting = current.isNull() | (current == "queued")
    return (
        F.when(status != "running", current)
        .when((waiting | (current == "dispatching")) & has_task, "discovery")
        .when(waiting & has_log, "scrape")
        .when(current == "dispatching", "discovery")
        .otherwise(current)
    )


def service_tier(plan: Column) -> Column:
    return F.when(plan == "trial", "trial").when(plan.isin("business", "pro", "enterprise"), "paid_full").otherwise("free")


def product_limit(tier: Column) -> Column:
    return F.when(tier == "free", 50).otherwise(999)


def competitor_limit(tier: Column) -> Column:
    return F.when(tier == "free", 15).otherwise(999)


def backoff(seconds: Column, dispatched: Column) -> Column:
    """The next tick's delay: five seconds after progress, else twice as long, sixty at most."""
    return F.when(dispatched > 0, 5).otherwise(F.least(seconds * 2, F.lit(60)))


def layer_order(requires_js: Column, has_service: Column) -> Column:
    """The fetch layers to try, in order: plain pages start with the cheap client, scripted ones leave it for last."""
    service = F.when(has_service, F.array(F.lit("decodo"))).otherwise(F.array().cast("array<string>"))
    scripted = F.concat(service, F.array(F.lit("playwright"), F.lit("httpx")))
    return F.when(requires_js, scripted).otherwise(F.concat(F.array(F.lit("httpx")), service, F.array(F.lit("playwright"))))


def discovery_status(outcome: Column) -> Column:
    """The job status of a discovery run's outcome."""
    return F.when(outcome == "error", "failed").when(outcome.isin("partial_budget", "partial"), "partial").otherwise("completed")

"""Liveness, queues and discovery policies: rules on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.sources.folders import fresh_folder, remove

#: Seconds without a sign of life after which a job is dead.
HEARTBEAT_S, DISCOVERY_S, OTHER_S = 600, 1200, 3600
#: Fixed value: failures in a row that deactivate a listing.
DEACTIVATE_AFTER = 15
#: Seconds after which a parent gives up its children, and repeats a dispatch.
CHILD_DISCOVERY_S, CHILD_SCRAPE_S, PENDING_S = 1020, 1080, 120
#: Days after which a sitemap is read again, hours after which a bad one and one that took too long is; categories
#: of one run, and how many without new rows end it; lines that the relay keeps.
STALE_DAYS, BAD_RETRY_HOURS, TIMEOUT_RETRY_HOURS = 3, 1, 24
WINDOW_CATEGORIES, QUIET_CATEGORIES = 60, 3
RELAY_LINES = 500


def age(since: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(since)


def should_reap(job_type: Column, started: Column, active: Column, now: Column) -> Column:
    return (
        F.when(job_type == "pipeline", age(F.coalesce(active, started), now) > HEARTBEAT_S)
        .when(job_type == "discovery", age(started, now) > DISCOVERY_S)
        .otherwise(age(started, now) > OTHER_S)
    )


def reap(jobs: DataFrame, now: DataFrame) -> DataFrame:
    """Running jobs without a sign of life become failed; whole seconds count as their duration."""
    timed = jobs.join(F.broadcast(now))
    dead = (F.col("status") == "running") & should_reap(F.col("job_type"), F.col("started_at"), F.col("completed_at"), F.col("now"))
    return timed.withColumn("_dead", F.coalesce(dead, F.lit(False))).withColumns(
        {"duration_ms": F.when(F.col("_dead"), age(F.col("started_at"), F.col("now")) * 1000), "status": F.when(F.col("_dead"), "failed").otherwise(F.col("status"))}
    ).drop("_dead", "now")


def stale_children(jobs: DataFrame, now: DataFrame) -> DataFrame:
    limit = F.when(F.col("job_type") == "discovery", CHILD_DISCOVERY_S).otherwise(CHILD_SCRAPE_S)
    return jobs.join(F.broadcast(now)).where((F.col("status") == "running") & (age(F.col("started_at"), F.col("now")) > limit)).drop("now")


def waiting_children(jobs: DataFrame, now: DataFrame) -> DataFrame:
    return jobs.join(F.broadcast(now)).where((F.col("status") == "pending") & (age(F.col("started_at"), F.col("now")) > PENDING_S)).drop("now")


def stale_pipeline(stage: Column, heartbeat: Column, last_log: Column, started: Column, now: Column) -> Column:
    """Whether the freshest sign is older than its stage allows: 5, 10 or 30 minutes."""
    minutes = F.when(stage == "queued", 5).when(stage == "dispatching", 10).otherwise(30)
    return age(F.greatest(heartbeat, last_log, started), now) > minutes * 60


def sitemap_due(resume_offset: Column, last_run: Column, now: Column) -> Column:
    return (resume_offset > 0) | last_run.isNull() | (age(last_run, now) >= 3 * 86400)


def recon_due(cursor: Column, n_categories: Column, last_run: Column, now: Column) -> Column:
    return F.when(n_categories == 0, True).when(cursor > 0, False).otherwise(last_run.isNull() | (age(last_run, now) >= 7 * 86400))


def remaining_quota(quota: Column, current: Column, default: int = 200_000) -> Column:
    return F.when(quota.isNull(), default).otherwise(F.greatest(quota - current, F.lit(0)))


def quota_share(total: int, marketplaces: DataFrame) -> DataFrame:
    """The total split evenly, rounded down, over active marketplaces."""
    n = marketplaces.where("is_active").agg(F.count("*").alias("n"))
    return marketplaces.join(F.broadcast(n)).withColumn("quota", F.when(F.col("is_active"), F.floor(F.lit(total) / F.col("n"))).cast("long")).drop("n")


def sampled_trust(urls: DataFrame, seed: int = 7, small: int = 100, sample: int = 50) -> DataFrame:
    """Per group (columns ``group``, ``url``, ``role``): which URLs are taken. Up to ``small`` all are judged by role; else
    a hash-ordered sample decides: 80 % products or more take all, under 20 % the sample's products only, between the
    two every URL is judged."""
    placed = urls.withColumn("_place", F.struct(F.xxhash64("url", F.lit(seed)).alias("h"), F.col("url").alias("url")))
    product = F.col("role") == "product"
    # only the first rows of each group are ranked: the limit is applied before the shuffle too
    first = placed.withColumn("_k", F.row_number().over(Window.partitionBy("group").orderBy("_place"))).where(F.col("_k") <= sample)
    drawn = first.groupBy("group").agg(F.avg(product.cast("double")).alias("ratio"), F.max("_place").alias("_cut"))
    per = urls.groupBy("group").agg(F.count("*").alias("n")).join(drawn, "group")
    joined = placed.join(per, "group")
    taken = F.when(F.col("n") <= small, product).when(F.col("ratio") >= 0.8, F.lit(True)).when(F.col("ratio") < 0.2, product & (F.col("_place") <= F.col("_cut"))).otherwise(product)
    return joined.withColumn("taken", taken).drop("_place", "_cut", "n", "ratio")


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes within ``depth`` steps of the roots (edges: src, dst; roots: node), each with its least depth. Edges and levels are written,
    so that a level reads the one before and doesn't compute it again."""
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = fresh_folder(spark, name)
        df.write.parquet(path)
        made.append(path)
        return spark.read.schema(df.schema).parquet(path)

    made: list[str] = []
    edges = kept(edges.select("src", "dst"), "edges")
    frontier = seen = kept(roots.select("node", F.lit(0).alias("depth")).distinct(), "level")
    for k in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)), "level")
        seen = seen.unionByName(frontier)
    found = kept(seen, "reachable")
    for path in made[:-1]:
        remove(spark, path)
    return found


def harvested_at(outcome: Column, now: Column) -> Column:
    """When a sitemap counts as read: now if it was useful; else so long ago that it is due again after the retry's hours."""
    ago = lambda hours: now - F.make_interval(hours=F.lit(STALE_DAYS * 24 - hours))
    return F.when(outcome == "useful", now).when(outcome == "timeout", ago(TIMEOUT_RETRY_HOURS)).otherwise(ago(BAD_RETRY_HOURS))


def category_windows(rows: DataFrame, group: str, order: str, cursor: Column, bucket: int = 1024) -> DataFrame:
    """The rows of each group that one run reads: group, n (rows in all), start, and window, an array of up to WINDOW_CATEGORIES rows in the order of
    a numeric column.

    ``cursor``: where a run starts, from the columns ``n`` and ``group``. Rows are counted by ranges of the order first, so that only the
    ranges that a window reaches are ranked, and no group is gathered.
    """
    others = [c for c in rows.columns if c != group]
    placed = rows.withColumn("_range", F.floor(F.col(order) / bucket))
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("n")).withColumn("start", cursor)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).join(sizes, group).where((F.col("_before") < F.col("start") + WINDOW_CATEGORIES) & (F.col("_before") + F.col("_n") > F.col("start")))
    ranked = placed.join(reached, [group, "_range"]).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1)
    inside = ranked.where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("start") + WINDOW_CATEGORIES))
    found = inside.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_at", *others))).alias("window"))
    return sizes.join(found, group, "left").withColumn("window", F.coalesce("window", F.array()))


def harvest_window(window: Column, n: Column, start: Column, deadline_at: Column) -> Column:
    """One run over categories: how many were read, where the next run begins, and whether one is needed.

    ``window``: the new rows of each category from the cursor ``start`` on, WINDOW_CATEGORIES at most, of ``n`` in all; ``deadline_at``:
    the category before which time runs out, or null. A deadline leaves the cursor there; enough quiet categories, or the list's end,
    put it back to 0.
    """
    state = F.struct(F.lit(0).alias("read"), F.lit(0).alias("quiet"), F.lit("").alias("end"))

    def step(s: Column, new: Column) -> Column:
        late = F.coalesce(start + s["read"] >= deadline_at, F.lit(False))
        quiet = F.when(new == 0, s["quiet"] + 1).otherwise(0)
        read = F.struct((s["read"] + 1).alias("read"), quiet.alias("quiet"), F.when(quiet >= QUIET_CATEGORIES, "converged").otherwise("").alias("end"))
        stopped = F.struct(s["read"].alias("read"), s["quiet"].alias("quiet"), F.lit("deadline").alias("end"))
        return F.when(s["end"] != "", s).when(late, stopped).otherwise(read)

    def told(s: Column) -> Column:
        at, more = start + s["read"], F.when(s["end"] == "", start + s["read"] < n).otherwise(s["end"] == "deadline")
        return F.struct(s["read"].alias("read"), F.when(more, at).otherwise(0).alias("next_index"), more.alias("more"))

    return F.aggregate(window, state, step, told)


def relay_tail(lines: DataFrame, after: int, limit: int = 50) -> DataFrame:
    """What a reader gets of a bounded log (seq, line): of the last RELAY_LINES lines those after ``after``, the newest ``limit``."""
    kept = lines.where(F.trim("line") != "").orderBy(F.col("seq").desc()).limit(RELAY_LINES)
    return kept.where(F.col("seq") > after).orderBy(F.col("seq").desc()).limit(limit)


def admin_guards(users: DataFrame, actor: int) -> DataFrame:
    """Why an actor may not deactivate, demote or delete each user (columns user_id, is_active, is_superuser); null where allowed."""
    counts = users.agg(F.count_if("is_superuser").alias("_supers"), F.count_if(F.col("is_superuser") & F.col("is_active")).alias("_active"))
    own = F.col("user_id") == actor
    reason = lambda left: F.when(own, "self").when(F.col("is_superuser") & (F.col(left) <= 1), "last_superuser")
    return users.join(F.broadcast(counts)).select("user_id", reason("_active").alias("deactivate"), reason("_supers").alias("demote"), reason("_supers").alias("delete"))


def attempt_streaks(logs: DataFrame, limit: int = DEACTIVATE_AFTER) -> DataFrame:
    """Each attempt with its listing's state after it: errors and last_error of this attempt alone, as they are cleared before it;
    streak, the failures in a row, which success clears; active, until a streak has reached the limit."""
    order = Window.partitionBy("listing_id").orderBy("created_at", "id")
    good = F.col("status").isin("success", "no_change")
    runs = logs.withColumn("_run", F.count_if(good).over(order))
    so_far = F.count_if(~good).over(Window.partitionBy("listing_id", "_run").orderBy("created_at", "id"))
    counted = runs.withColumns({"streak": so_far, "errors": F.when(good, 0).otherwise(1).cast("long"), "last_error": F.when(~good, F.col("status"))})
    return counted.withColumn("active", F.max("streak").over(order) < limit).drop("_run")

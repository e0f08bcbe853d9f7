"""The star schema of price intelligence, derived from the driver's tables; the oracle repeats the same mapping in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row for each marketplace (id, domain suffix, country, currency).
MARKETPLACES = [
    (0, "md", "MD", "MDL"), (1, "ro", "RO", "RON"), (2, "com.ua", "UA", "UAH"), (3, "kz", "KZ", "KZT"), (4, "pl", "PL", "PLN"),
    (5, "de", "DE", "EUR"), (6, "co.uk", "GB", "GBP"), (7, "com", "RU", "RUB"), (8, "fr", "FR", "EUR"), (9, "xyz", "BY", "BYN"),
]
#: The currencies that have exchange rates.
RATED = ["USD", "MDL", "RON", "UAH", "KZT", "PLN", "GBP", "BYN"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Star:
    """Lazy frames of the star schema over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand_id"),
            F.col("p_type").alias("category_id"),
            F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("http://img.example/"), F.col("p_partkey").cast("string"))).alias("image_url"),
        )

    def marketplaces(self) -> DataFrame:
        literal = self.spark.createDataFrame(MARKETPLACES, "marketplace_id int, tld string, country_code string, currency_code string")
        nations = self.table("nation").select(F.col("n_nationkey").alias("marketplace_id"), F.col("n_name").alias("marketplace_name"), F.col("n_regionkey").alias("region_id"))
        return literal.join(nations, "marketplace_id").select(
            "marketplace_id",
            "marketplace_name",
            F.concat(F.lit("shop"), F.col("marketplace_id").cast("string"), F.lit("."), F.col("tld")).alias("domain"),
            F.concat(F.lit("mp_"), F.col("marketplace_id").cast("string")).alias("marketplace_code"),
            "country_code",
            "currency_code",
            "region_id",
            (F.col("marketplace_id") % 7 != 3).alias("is_active"),
            (F.col("marketplace_id") * 1000).alias("product_quota"),
        )

    def prices(self) -> DataFrame:
        """One row for each listing and day: the last of that day's rows counts."""
        day = F.to_date("l_shipdate")
        rows = self.table("lineitem").select(
            (F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("listing_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_suppkey") % 10).cast("int").alias("marketplace_id"),
            F.date_format(day, "yyyyMMdd").cast("int").alias("date_id"),
            F.struct(
                "l_orderkey",
                "l_linenumber",
                "l_extendedprice",
                F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
                F.when(F.col("l_discount") > 0, F.floor(F.col("l_extendedprice") / (1 - F.col("l_discount")) * 100 + 0.5) / 100).cast("decimal(12,2)").alias("original_price"),
                F.when(F.col("l_linestatus") == "O", True).when(F.col("l_returnflag") != "N", False).alias("in_stock"),
                (F.col("l_returnflag") == "R").alias("is_promoted"),
            ).alias("row"),
        )
        # a maximum by key combines before the shuffle, unlike a window
        last = rows.groupBy("listing_id", "product_id", "marketplace_id", "date_id").agg(F.max("row").alias("row"))
        currency = self.spark.createDataFrame([(m[0], m[3]) for m in MARKETPLACES], "marketplace_id int, currency_code string")
        return last.select("listing_id", "product_id", "marketplace_id", "date_id", "row.price", "row.original_price", "row.in_stock", "row.is_promoted").join(F.broadcast(currency), "marketplace_id")

    def listings(self) -> DataFrame:
        """Each listing with its last known price."""
        last = self.prices().groupBy("listing_id", "product_id", "marketplace_id", "currency_code").agg(F.max(F.struct("date_id", "price", "in_stock")).alias("x"))
        return last.select(
            "listing_id",
            "product_id",
            "marketplace_id",
            F.col("currency_code").alias("last_currency_code"),
            F.col("x.date_id").alias("last_date_id"),
            F.col("x.price").alias("last_price"),
            F.col("x.in_stock").alias("last_in_stock"),
            F.when(F.col("listing_id") % 13 != 0, F.col("listing_id") % 11 != 0).alias("is_active"),
            F.when(F.col("listing_id") % 17 != 0, F.timestamp_seconds(F.lit(1706659200) - (F.col("listing_id") % 72) * 3600)).alias("last_checked_at"),
        )

    def rates(self) -> DataFrame:
        """One row for each year, currency and source of orders: the value of one unit in EUR and USD."""
        code = F.get(F.array(*map(F.lit, RATED)), (F.col("o_custkey") % len(RATED)).cast("int"))
        source = F.when(F.col("o_orderkey") % 3 == 0, "feed_b").otherwise("feed_a")
        least = F.min(F.floor("o_totalprice").cast("long")).cast("decimal(10,0)")
        rows = self.table("orders").groupBy((F.year("o_orderdate") * 10000 + 101).alias("date_id"), code.alias("currency_code"), source.alias("source")).agg(least.alias("least"))
        in_eur, in_usd = (F.col("least") * F.lit(f).cast("decimal(6,5)") for f in ("0.00001", "0.00002"))
        return rows.select("date_id", "currency_code", in_eur.cast("decimal(18,8)").alias("rate_to_eur"), F.when(F.col("currency_code") == "USD", F.lit(1).cast("decimal(18,8)")).otherwise(in_usd.cast("decimal(18,8)")).alias("rate_to_usd"), "source")

    def logs(self) -> DataFrame:
        """Scrape attempts from the event stream."""
        status = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            (F.col("user_id") % 10).cast("int").alias("marketplace_id"),
            F.col("user_id").alias("listing_id"),
            F.when(status == "purchase", "success").when(status == "view", "no_change").when(status == "click", "timeout").when(status == "error", "error").otherwise("parse_error").alias("status"),
            F.floor(F.col("value") * 100).cast("int").alias("duration_ms"),
            F.col("props"),
        )

    def jobs(self) -> DataFrame:
        """One job for each marketplace and day of logs."""
        day = F.date_format("created_at", "yyyyMMdd").cast("int")
        counts = self.logs().groupBy("marketplace_id", day.alias("day_id")).agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"))
        return counts.select(
            (F.col("day_id") * 10 + F.col("marketplace_id")).cast("long").alias("id"),
            F.col("day_id").cast("long").alias("parent_job_id"),
            "marketplace_id",
            F.when(F.col("day_id") % 2 == 0, "discovery").otherwise("scrape").alias("job_type"),
            F.when(F.col("successful") == 0, "failed").when(F.col("marketplace_id") % 4 == 1, "partial").when(F.col("day_id") % 10 == 7, "running").when(F.col("day_id") % 10 == 8, "pending").otherwise("completed").alias("status"),
            "started_at",
            "completed_at",
            "successful",
            "failed",
        )

    def now(self) -> DataFrame:
        """The as-of instant, one row: the last event's hour."""
        return self.table("events").agg(F.date_trunc("hour", F.max("ts")).alias("now"))

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.lower(F.col("c_mktsegment")).alias("segment"),
            F.when(F.col("c_custkey") % 5 == 0, "trial").when(F.col("c_custkey") % 5 == 1, "starter").when(F.col("c_custkey") % 5 == 2, "business").when(F.col("c_custkey") % 5 == 3, "pro").otherwise("unknown_plan").alias("plan"),
            (F.col("c_custkey") % 9 != 0).alias("is_active"),
            (F.col("c_custkey") % 100 == 0).alias("is_superuser"),
        )

    def user_products(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id")).distinct()

    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", "text")


_VALUES = ", ".join(f"({m[0]}, '{m[1]}', '{m[2]}', '{m[3]}')" for m in MARKETPLACES)
_RATED = "CASE o_custkey % 8 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(RATED)) + " END"
#: The same mapping as DuckDB common table expressions, in the order of their use.
CTES = {
    "mp_literal": f"SELECT * FROM (VALUES {_VALUES}) AS t(marketplace_id, tld, country_code, currency_code)",
    "products": "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand_id, p_type AS category_id, CASE WHEN p_partkey % 5 <> 0 THEN 'http://img.example/' || p_partkey END AS image_url FROM part",
    "marketplaces": "SELECT m.marketplace_id, n_name AS marketplace_name, 'shop' || m.marketplace_id || '.' || tld AS domain, 'mp_' || m.marketplace_id AS marketplace_code, country_code, currency_code, n_regionkey AS region_id, m.marketplace_id % 7 <> 3 AS is_active, m.marketplace_id * 1000 AS product_quota FROM mp_literal m JOIN nation ON n_nationkey = m.marketplace_id",
    "price_rows": "SELECT l_partkey * 10 + l_suppkey % 10 AS listing_id, l_partkey AS product_id, CAST(l_suppkey % 10 AS INTEGER) AS marketplace_id, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS date_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CASE WHEN l_discount > 0 THEN CAST(floor(l_extendedprice / (1 - l_discount) * 100 + 0.5) / 100 AS DECIMAL(12,2)) END AS original_price, CASE WHEN l_linestatus = 'O' THEN TRUE WHEN l_returnflag <> 'N' THEN FALSE END AS in_stock, l_returnflag = 'R' AS is_promoted, row_number() OVER (PARTITION BY l_partkey * 10 + l_suppkey % 10, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, 5 DESC) AS rn FROM lineitem",
    "prices": "SELECT p.* EXCLUDE (rn), m.currency_code FROM price_rows p JOIN mp_literal m USING (marketplace_id) WHERE rn = 1",
    "listings": "SELECT listing_id, product_id, marketplace_id, currency_code AS last_currency_code, date_id AS last_date_id, price AS last_price, in_stock AS last_in_stock, CASE WHEN listing_id % 13 <> 0 THEN listing_id % 11 <> 0 END AS is_active, CASE WHEN listing_id % 17 <> 0 THEN CAST(to_timestamp(1706659200 - (listing_id % 72) * 3600) AT TIME ZONE 'UTC' AS TIMESTAMP) END AS last_checked_at FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY date_id DESC) AS k FROM prices) WHERE k = 1",
    "rates": f"SELECT date_id, currency_code, CAST(least * 0.00001 AS DECIMAL(18,8)) AS rate_to_eur, CASE WHEN currency_code = 'USD' THEN CAST(1 AS DECIMAL(18,8)) ELSE CAST(least * 0.00002 AS DECIMAL(18,8)) END AS rate_to_usd, source FROM (SELECT CAST(year(o_orderdate) * 10000 + 101 AS INTEGER) AS date_id, {_RATED} AS currency_code, CASE WHEN o_orderkey % 3 = 0 THEN 'feed_b' ELSE 'feed_a' END AS source, CAST(min(CAST(floor(o_totalprice) AS BIGINT)) AS DECIMAL(10,0)) AS least FROM orders GROUP BY ALL)",
    "logs": "SELECT event_id AS id, ts AS created_at, CAST(user_id % 10 AS INTEGER) AS marketplace_id, user_id AS listing_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'no_change' WHEN 'click' THEN 'timeout' WHEN 'error' THEN 'error' ELSE 'parse_error' END AS status, CAST(floor(value * 100) AS INTEGER) AS duration_ms, props FROM events",
    "job_counts": "SELECT marketplace_id, CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS day_id, min(created_at) AS started_at, max(created_at) AS completed_at, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status <> 'success') AS failed FROM logs GROUP BY ALL",
    "jobs": "SELECT CAST(day_id * 10 + marketplace_id AS BIGINT) AS id, CAST(day_id AS BIGINT) AS parent_job_id, marketplace_id, CASE WHEN day_id % 2 = 0 THEN 'discovery' ELSE 'scrape' END AS job_type, CASE WHEN successful = 0 THEN 'failed' WHEN marketplace_id % 4 = 1 THEN 'partial' WHEN day_id % 10 = 7 THEN 'running' WHEN day_id % 10 = 8 THEN 'pending' ELSE 'completed' END AS status, started_at, completed_at, successful, failed FROM job_counts",
    "as_of": "SELECT date_trunc('hour', max(ts)) AS now FROM events",
    "users": "SELECT c_custkey AS user_id, c_name AS name, lower(c_mktsegment) AS segment, CASE c_custkey % 5 WHEN 0 THEN 'trial' WHEN 1 THEN 'starter' WHEN 2 THEN 'business' WHEN 3 THEN 'pro' ELSE 'unknown_plan' END AS plan, c_custkey % 9 <> 0 AS is_active, c_custkey % 100 = 0 AS is_superuser FROM customer",
    "user_products": "SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "messages": "SELECT conv_id AS session_id, turn AS position, role, text FROM conversations",
    "ordered_prices": "SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY date_id) AS prev FROM prices",
    "changes": "SELECT *, CASE WHEN prev > 0 AND abs(CAST(price - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100) <= 9999.9999 THEN round(CAST(price - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100, 4) END AS change_pct FROM ordered_prices",
    "latest": "SELECT listing_id, date_id, change_pct, price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY date_id DESC) AS k FROM changes) WHERE k = 1",
    "pool": "SELECT l.listing_id AS id, l.product_id, p.name AS product_name, p.category_id, p.brand_id, p.image_url, l.marketplace_id, m.marketplace_name, m.domain, m.marketplace_code, m.country_code, CAST(l.last_price AS DOUBLE) AS price, l.last_currency_code AS currency, l.last_in_stock AS in_stock, l.last_checked_at, x.change_pct AS price_change_pct, CASE WHEN l.is_active THEN 'active' ELSE 'inactive' END AS status FROM listings l JOIN products p USING (product_id) JOIN marketplaces m USING (marketplace_id) LEFT JOIN latest x ON x.listing_id = l.listing_id WHERE l.is_active",
}


def with_ctes(query: str) -> str:
    """``query`` after the CTEs that it uses, directly or through others."""
    import re

    needed, todo = set(), [query]
    while todo:
        for name in re.findall(r"\b[a-z_]+\b", todo.pop()):
            if name in CTES and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + " " + query if needed else query

"""Queries of the document operators: over pages made from parts, which SQL can check, and over the pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions import html
from marketgrain.operators.discovery import Recon
from marketgrain.queries import query
from marketgrain.sources.folders import fresh_folder
from marketgrain.sources.markup import CTE, SITE_CTE, marked_pages, site_pages, spread
from marketgrain.sources.star import Star

_ROLE = "CASE WHEN kind IN (0, 1, 2, 4, 6) THEN 'product' WHEN kind IN (3, 7) THEN 'listing' ELSE 'hub' END"
_STRUCTURE = "CASE WHEN kind = 7 THEN 'listing' WHEN kind IN (0, 1, 6) THEN 'product' ELSE 'hub' END"
_PRICES = "CASE kind WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 7 ELSE 0 END"
_REPEATED = "CASE kind WHEN 6 THEN 1 WHEN 7 THEN 7 ELSE 0 END"
_FIELDS = ("title", "price_text", "original_text", "currency", "image", "description")


def _sql(select: str) -> str:
    return f"WITH {CTE} SELECT page_id, {select} FROM m"


def _fields_sql(kinds: dict[int, tuple[str, ...]]) -> str:
    """Each field of each kind of page as an SQL expression; other kinds have nulls."""
    each = lambda k: "CASE kind " + " ".join(f"WHEN {kind} THEN {values[k]}" for kind, values in kinds.items()) + " END"
    return _sql(", ".join(f"CAST({each(k)} AS VARCHAR) AS {name}" for k, name in enumerate(_FIELDS)))


def _marked(s: Star) -> DataFrame:
    return html.with_nodes(marked_pages(spread(s.table("part"))))


def _pages(s: Star) -> DataFrame:
    return html.with_nodes(s.table("pages"))


def _fields(s: Star, fields: Column) -> DataFrame:
    return _marked(s).select("page_id", fields.alias("f")).select("page_id", *[F.col("f")[n].alias(n) for n in _FIELDS])


@query(_sql("CASE kind WHEN 4 THEN 'product' WHEN 5 THEN 'website' END AS og_type"))
def doc_og_type(s: Star) -> DataFrame:
    return _marked(s).select("page_id", html.og_type(F.col("nodes")).alias("og_type"))


@query(_sql("CASE kind WHEN 0 THEN 'Product' WHEN 1 THEN 'BreadcrumbList,Product,Thing' ELSE '' END AS types"))
def doc_jsonld_types(s: Star) -> DataFrame:
    return _marked(s).select("page_id", F.array_join(html.jsonld_types(F.col("nodes")), ",").alias("types"))


@query(_sql("CASE kind WHEN 2 THEN 'Product' WHEN 3 THEN 'ItemList' ELSE '' END AS types"))
def doc_microdata_types(s: Star) -> DataFrame:
    return _marked(s).select("page_id", F.array_join(html.microdata_types(F.col("nodes")), ",").alias("types"))


@query(_sql(f"{_REPEATED} AS repetition, {_PRICES} AS n_priced, {_STRUCTURE} AS role"))
def doc_role_structural(s: Star) -> DataFrame:
    return html.page_roles(_marked(s)).select("page_id", "repetition", F.col("prices").alias("n_priced"), F.col("structural_role").alias("role"))


@query(_sql(f"{_PRICES} AS n_priced, {_REPEATED} AS repetition"))
def agg_page_prices(s: Star) -> DataFrame:
    return _marked(s).select("page_id", html.page_prices().alias("n_priced"), html.most_repetitions(F.col("nodes")).alias("repetition"))


@query(_sql(f"{_ROLE} AS role"))
def doc_role(s: Star) -> DataFrame:
    return html.page_roles(_marked(s)).select("page_id", "role")


@query(_sql("CASE kind WHEN 6 THEN 1 WHEN 7 THEN 7 END AS n, CASE kind WHEN 6 THEN 'span' WHEN 7 THEN 'div' END AS tag, CASE kind WHEN 6 THEN 'old' WHEN 7 THEN 'b card' END AS classes"))
def doc_signature(s: Star) -> DataFrame:
    return _marked(s).select("page_id", html.most_repeated(F.col("nodes")).alias("r")).select("page_id", "r.n", "r.tag", "r.classes")


@query(_sql("CASE WHEN kind IN (0, 1, 5, 6) THEN name ELSE 'some lamp ' || page_id END AS title"))
def doc_title_fallback(s: Star) -> DataFrame:
    return _marked(s).select("page_id", html.title(F.col("nodes"), F.col("url")).alias("title"))


@query(_fields_sql({0: ("name", "price", "NULL", "'EUR'", "'http://img.example/' || page_id || '.jpg'", "'about ' || name"), 1: ("name", "price", "high", "'USD'", "NULL", "NULL")}))
def doc_extract_jsonld(s: Star) -> DataFrame:
    return _fields(s, html.jsonld_fields(F.col("nodes")))


@query(_fields_sql({2: ("name", "price", "NULL", "'PLN'", "'/i.jpg'", "'about ' || name")}))
def doc_extract_microdata(s: Star) -> DataFrame:
    return _fields(s, html.microdata_fields(F.col("nodes")))


@query(_fields_sql({4: ("name", "price", "NULL", "'GBP'", "'http://img/x.png'", "'about ' || name")}))
def doc_extract_meta(s: Star) -> DataFrame:
    return _fields(s, html.meta_fields(F.col("nodes")))


_AUTO = {1: ("name", "NULL", "NULL", "NULL", "NULL", "NULL"), 2: ("NULL", "price", "NULL", "NULL", "'/i.jpg'", "NULL"), 4: ("NULL", "price", "NULL", "NULL", "NULL", "'about ' || name"), 5: ("name", "NULL", "NULL", "NULL", "NULL", "NULL"), 6: ("name", "price || ' €'", "NULL", "NULL", "'/b.png'", "NULL"), 7: ("NULL", "name || price || ' $'", "NULL", "NULL", "NULL", "NULL")}


@query(_fields_sql(_AUTO))
def doc_extract_auto(s: Star) -> DataFrame:
    return _fields(s, html.auto_fields(F.col("nodes")))


@query(_fields_sql({2: ("name", "NULL", "NULL", "NULL", "NULL", "NULL"), 6: ("NULL", "price || ' €'", "price || ' €'", "NULL", "'/b.png'", "NULL")}))
def doc_extract_selectors(s: Star) -> DataFrame:
    return _fields(s, html.selector_fields(F.col("nodes"), {"title": "h2, div[itemtype$='/Product'] > b:first-child", "price": "img ~ span.none, h1 + span ~ div.price:not(.old)", "image": "img[class^=pro]:nth-child(2n+1)", "original_price": "#main"}))


@query(_fields_sql({0: ("name", "price", "NULL", "'EUR'", "'http://img.example/' || page_id || '.jpg'", "'about ' || name"), 1: ("name", "price", "high", "'USD'", "NULL", "NULL"), 2: ("name", "price", "NULL", "'PLN'", "'/i.jpg'", "'about ' || name"), 4: ("name", "price", "NULL", "'GBP'", "'http://img/x.png'", "'about ' || name"), 5: _AUTO[5], 6: _AUTO[6], 7: _AUTO[7]}))
def arr_first_nonnull(s: Star) -> DataFrame:
    nodes = F.col("nodes")
    return _fields(s, html.merged([html.jsonld_fields(nodes), html.microdata_fields(nodes), html.meta_fields(nodes), html.auto_fields(nodes)]))


_MERGED = f"{_ROLE} AS role, CASE WHEN kind IN (0, 1, 2, 4, 6) THEN name END AS title, CASE WHEN kind IN (0, 1, 2, 4, 6) THEN CAST(price AS DOUBLE) END AS price, CASE WHEN kind = 1 THEN CAST(high AS DOUBLE) END AS original_price, CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'PLN' WHEN 4 THEN 'GBP' WHEN 6 THEN 'EUR' END AS currency, CASE kind WHEN 0 THEN 'http://img.example/' || page_id || '.jpg' WHEN 2 THEN '/i.jpg' WHEN 4 THEN 'http://img/x.png' WHEN 6 THEN '/b.png' END AS image_url, CASE WHEN kind IN (0, 2, 4) THEN 'about ' || name END AS description"


@query(_sql(_MERGED))
def doc_merge(s: Star) -> DataFrame:
    return html.records(html.page_roles(_marked(s)))


@query(_sql("kind IN (0, 1, 2, 4, 6) AS success, FALSE AS is_partial, kind NOT IN (0, 1, 2, 4, 6) AS is_empty, CASE WHEN kind IN (0, 1, 2, 4, 6) THEN '' ELSE 'title,price,currency' END AS missing, CAST(CASE WHEN kind IN (0, 1, 2, 4, 6) THEN 1 ELSE 0 END AS DOUBLE) AS completeness"))
def doc_result_flags(s: Star) -> DataFrame:
    return html.flags(html.records(html.page_roles(_marked(s)))).select("page_id", "success", "is_partial", "is_empty", F.array_join("missing", ",").alias("missing"), "completeness")


@query(_sql("page_id % 3 = 0 AND kind NOT IN (0, 1, 2, 4, 6) AS shell"))
def doc_shell_probe(s: Star) -> DataFrame:
    read = html.records(html.page_roles(_marked(s)))
    tier, layer = F.when(F.col("page_id") % 3 < 2, 1).otherwise(2), F.when(F.col("page_id") % 3 == 0, "httpx").otherwise("browser")
    return read.select("page_id", html.shell_probe(tier, layer, F.col("currency"), F.col("role")).alias("shell"))


_CARDS = "SELECT page_id, '/p/lamp-' || (1000000 + page_id * 10 + j) || '.html' AS path FROM m, generate_series(0, 6) AS g(j) WHERE kind = 7"
_ITEMS = "SELECT page_id, '/p/item-' || (1000000 + page_id * 10) || '.html' AS path FROM m WHERE kind = 8"
_LINKED = "SELECT page_id, 'http://shop.example' || path AS link, path FROM"


@query(f"WITH {CTE} {_LINKED} ({_CARDS})")
def doc_links_grid(s: Star) -> DataFrame:
    return html.grid_links(_marked(s))


@query(f"WITH {CTE} {_LINKED} ({_CARDS} UNION ALL {_ITEMS} UNION ALL SELECT page_id, unnest(['/about', '/cart/1', '/c/x']) AS path FROM m WHERE kind = 8)")
def doc_links_internal(s: Star) -> DataFrame:
    return html.links(_marked(s))


@query(f"WITH {CTE} {_LINKED} ({_CARDS} UNION ALL {_ITEMS})")
def doc_links_product(s: Star) -> DataFrame:
    return html.product_links(html.links(_marked(s)))


@query(_sql("CASE kind WHEN 7 THEN '?page=3' WHEN 8 THEN '/c/x?page=3' END AS next_href"))
def doc_next_page(s: Star) -> DataFrame:
    return html.next_page(_marked(s))


# --- discovery ------------------------------------------------------------------------------------------------------------------

_READ = f"{SITE_CTE}, r AS (SELECT DISTINCT site, CAST(0 AS BIGINT) AS j, 0 AS depth FROM m UNION ALL SELECT r.site, 4 * r.j + k, depth + 1 FROM r JOIN p USING (site, j), generate_series(1, 4) AS t(k) WHERE depth < 3 AND role <> 'product'), f AS (SELECT site, j, depth FROM r JOIN p USING (site, j) WHERE role = 'listing' AND j > 0 AND j < 99)"


@query(f"WITH RECURSIVE {_READ} SELECT site, 'http://shop' || site || '.example/c/' || j AS url, depth FROM f UNION ALL SELECT site, 'http://shop' || site || '.example/catalog', NULL FROM p WHERE j = 99 AND role = 'hub' AND site NOT IN (SELECT site FROM f)")
def disc_bfs(s: Star) -> DataFrame:
    """Category discovery over sites made from parts: stopped after two levels, then taken up and ended."""
    folder = fresh_folder(s.spark, "recon")
    parsed = html.page_roles(html.with_nodes(site_pages(spread(s.table("part")))))
    read, found = f"{folder}/parsed", f"{folder}/parsed-links"
    # pages are parsed once: their anchors are kept beside their roles
    parsed.select("url", "role", F.filter("nodes", lambda n: n["tag"] == "a").alias("nodes")).write.parquet(read)
    pages = s.spark.read.parquet(read)
    html.links(pages, "url").select("url", "link").write.parquet(found)
    site = F.regexp_extract("url", r"^http://shop(\d+)\.example", 1).cast("long")
    roots = pages.select(site.alias("site"), F.regexp_extract("url", "^(http://[^/]+)", 1).alias("url")).distinct()
    crawl = Recon(roots, pages.select("url", "role"), s.spark.read.parquet(found), folder)
    _, stopped = crawl.run(lambda level: level == 2)
    assert stopped
    return crawl.run()[0]


# --- the same operators over the pages table, which shows no product mark-up -------------------------------------------------


@query("SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS anchors FROM pages")
def doc_links_count(s: Star) -> DataFrame:
    return _pages(s).select("page_id", F.size(F.filter("nodes", lambda n: n["tag"] == "a")).cast("long").alias("anchors"))


@query()
def doc_pages_title(s: Star) -> DataFrame:
    return _pages(s).select("page_id", html.title(F.col("nodes"), F.col("url")).alias("title"))


@query()
def doc_pages_role(s: Star) -> DataFrame:
    return html.page_roles(_pages(s)).select("page_id", "og_type", "repetition", "prices", "structural_role", "role")


@query()
def doc_pages_record(s: Star) -> DataFrame:
    return html.flags(html.records(html.page_roles(_pages(s)))).withColumn("missing", F.array_join("missing", ","))


@query()
def doc_pages_links(s: Star) -> DataFrame:
    return html.links(_pages(s))


@query("SELECT page_id, regexp_matches(lower(substr(html, 1, 800)), '<(urlset|sitemapindex)|<\\?xml') AS is_sitemap FROM pages")
def doc_is_sitemap(s: Star) -> DataFrame:
    from marketgrain.sources import feeds

    return s.table("pages").select("page_id", feeds.looks_like_sitemap(F.col("html")).alias("is_sitemap"))

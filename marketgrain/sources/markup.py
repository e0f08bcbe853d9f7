"""Product pages made from the rows of ``part``: each kind shows its data in a way of its own, so that SQL can tell what a page says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CARD = '<div class="card b"><a href="/p/lamp-[[CARD%d]].html?x=1">[[NAME]]</a> [[PRICE]] $</div>'
#: A page of each kind; a part's kind is its key modulo their number.
KINDS = [
    '<html><head><title>[[NAME]] | Shop</title><script type="application/ld+json">{"@type":"Product","name":"[[NAME]]","description":"about [[NAME]]","image":["http://img.example/[[ID]].jpg"],"offers":{"price":"[[PRICE]]","priceCurrency":"eur"}}</script></head><body><p>hello</p></body></html>',
    '<script type="application/ld+json">{"@graph":[{"@type":"BreadcrumbList"},{"@type":["Product","Thing"],"name":"[[NAME]]","offers":{"lowPrice":"[[PRICE]]","highPrice":"[[HIGH]]","priceCurrency":"USD"}}]}</script><h1>[[NAME]]</h1>',
    '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">[[NAME]]</b><img itemprop="image" src="/i.jpg"><p itemprop="description">about [[NAME]]</p><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="[[PRICE]]"><meta itemprop="priceCurrency" content="pln"></div></div>',
    '<ul itemscope itemtype="http://schema.org/ItemList"><li itemscope itemtype="http://schema.org/Product"><i itemprop="name">[[NAME]]</i></li></ul>',
    '<meta property="og:type" content="Product"><meta property="og:title" content="[[NAME]]"><meta property="product:price:amount" content="[[PRICE]]"><meta property="product:price:currency" content="gbp"><meta name="description" content="about [[NAME]]"><meta property="og:image" content="http://img/x.png">',
    '<meta property="og:type" content="website"><h1>[[NAME]]</h1>',
    '<h1>[[NAME]]</h1><span class="old">999999 items</span><div class="price current" id="main">[[PRICE]] €</div><img src="/a.png" width="10" height="10"><img class="product" data-src="/b.png">',
    '<link rel="next" href="?page=3">' + "".join(_CARD % k for k in range(7)),
    '<p>hello</p><a href="/p/item-[[CARD0]].html">a</a><a href="/about">b</a><a href="#top">c</a><a href="http://other.example/z">d</a><a href="/cart/1">e</a><a href="/c/x?page=3">Next</a>',
    '<div id="root"></div>',
]
#: The same rows in SQL, without the pages.
CTE = f"m AS (SELECT p_partkey AS page_id, p_partkey % {len(KINDS)} AS kind, p_name AS name, printf('%.2f', p_retailprice) AS price, printf('%.2f', p_retailprice + 10) AS high, 'http://shop.example/some-lamp_' || p_partkey AS url FROM part)"


#: Pages that a task makes and parses.
PAGES_A_TASK = 4_000


def spread(part: DataFrame, each: int = PAGES_A_TASK) -> DataFrame:
    """The rows dealt out, ``each`` to a partition: a row of few bytes becomes a whole page, so file blocks hold far too many."""
    return part.repartition(max(1, -(-part.count() // each)))


def marked_pages(part: DataFrame) -> DataFrame:
    """page_id, url, html."""
    key = F.col("p_partkey")
    kind = (key % len(KINDS)).cast("int")
    two = lambda c: F.format_string("%.2f", c)
    page = F.get(F.array(*map(F.lit, KINDS)), kind)
    values = {"NAME": F.col("p_name"), "PRICE": two(F.col("p_retailprice")), "HIGH": two(F.col("p_retailprice") + 10), "ID": key.cast("string")}
    values |= {f"CARD{k}": (1_000_000 + key * 10 + k).cast("string") for k in range(7)}
    for name, value in values.items():
        page = F.replace(page, F.lit(f"[[{name}]]"), value)
    return part.select(key.alias("page_id"), F.concat(F.lit("http://shop.example/some-lamp_"), key, F.when(kind == 8, "?page=2").otherwise("")).alias("url"), page.alias("html"))


_SELF = "http://shop%d.example"
#: What a page of each role shows beside its links.
ROLE_MARKS = {
    "listing": '<meta property="og:type" content="article"><p>all of it</p>',
    "product": '<meta property="og:type" content="product"><p>one of it</p>',
    "unknown": "".join(f"<p>{n}.50 $</p>" for n in range(6)),
    "hub": "<p>welcome</p>",
}
#: Pages of a site, and links from each to further ones.
SITE_PAGES, SITE_LINKS = 100, 4
#: Sites of 100 parts each in SQL: a page's number in its site, its role, and the same links.
SITE_CTE = (
    "m AS (SELECT p_partkey // 100 AS site, p_partkey % 100 AS j FROM part), "
    "p AS (SELECT site, j, CASE WHEN j = 99 THEN CASE WHEN site % 2 = 0 THEN 'hub' ELSE 'product' END WHEN j = 0 AND site % 7 <> 3 THEN 'hub' WHEN j = 0 THEN 'listing' "
    "WHEN (site + j) % 5 = 0 THEN CASE WHEN site % 3 = 1 THEN 'hub' ELSE 'listing' END WHEN (site + j) % 5 = 1 THEN 'product' WHEN (site + j) % 5 = 2 THEN 'unknown' ELSE 'hub' END AS role FROM m)"
)


def site_pages(part: DataFrame) -> DataFrame:
    """Pages of sites made from parts, each linking on to four more: page_id, url, html. The last one stands at a usual path that no page links to."""
    site, j = F.floor(F.col("p_partkey") / SITE_PAGES), F.col("p_partkey") % SITE_PAGES
    k = (site + j) % 5
    role = (
        F.when(j == 99, F.when(site % 2 == 0, "hub").otherwise("product")).when(j == 0, F.when(site % 7 == 3, "listing").otherwise("hub"))
        .when(k == 0, F.when(site % 3 == 1, "hub").otherwise("listing")).when(k == 1, "product").when(k == 2, "unknown").otherwise("hub")
    )
    shown = F.create_map(*[F.lit(x) for pair in ROLE_MARKS.items() for x in pair])[role]
    host = F.format_string(_SELF, site)
    onward = F.transform(F.sequence(F.lit(1), F.lit(SITE_LINKS)), lambda n: F.format_string('<a href="/c/%d?from=%d">on</a>', SITE_LINKS * j + n, j))
    other = F.format_string('<a href="/c/%d">here</a><a href="http://other.example/c/1">out</a><a href="#top">up</a>', j)
    path = F.when(j == 0, "").when(j == 99, "/catalog").otherwise(F.concat(F.lit("/c/"), j.cast("string")))
    return part.select(F.col("p_partkey").alias("page_id"), F.concat(host, path).alias("url"), F.concat(shown, F.array_join(onward, ""), other).alias("html"))

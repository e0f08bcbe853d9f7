"""Documents: each page is parsed once into nodes; roles, fields and links are then expressions on them, page by page.

A page's text nodes are kept once, in ``strings``; a node tells which of them it spans, and up to which node its descendants
go. Strings that no element shows (comments, declarations, processing instructions) are kept in ``asides``. Expressions read
the columns ``nodes``, ``strings`` and ``asides`` of ``with_nodes``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions import text, urls
from marketgrain.functions.selectors import selected
from marketgrain.functions.text import let

NODES = "array<struct<id:int,parent:int,scope:int,tag:string,classes:string,attrs:map<string,string>,first:int,last:int,end:int,nth:int>>"
_NODE_TYPE = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("scope", pa.int32()), ("tag", pa.string()), ("classes", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("first", pa.int32()), ("last", pa.int32()), ("end", pa.int32()), ("nth", pa.int32())]))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What Open Graph, JSON-LD and microdata types say of a page's role.
OG_ROLES = {"product": ["product", "product.group", "product.item"], "hub": ["website"], "listing": ["article", "blog", "news"]}
LD_ROLES = {"product": ["Product", "IndividualProduct", "ProductModel"], "listing": ["CollectionPage", "ItemList", "SearchResultsPage", "Article", "NewsArticle", "BlogPosting"], "hub": ["WebPage", "AboutPage", "ContactPage", "FAQPage"]}
MICRODATA_ROLES = {"product": ["Product"], "listing": ["ItemList", "OfferCatalog", "CollectionPage"]}
GRID = 6
#: What is parsed at once at most, in bytes of HTML and in pages: a node takes some hundred times its bytes in Python.
SLICE_CHARS, SLICE_PAGES = 500_000, 500
#: What counts for a price candidate, and paths that no grid's link leads to.
POINTS_PRICE, POINTS_CURRENT, POINTS_SYMBOL = 10, 5, 3
GRID_EXCLUDED = ("/cart", "/checkout", "/login", "/auth", "/account", "/wishlist", "/compare", "/sitemap", "/robots")


class _Nodes(HTMLParser):
    """Elements with their parents and their places among these's children, in document order: a list for each field of a node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.scope, self.tag, self.classes, self.attrs, self.first, self.last, self.end, self.nth = ([] for _ in range(9))
        self.open, self.text, self.strings, self.asides, self.children = [], [], [], [], {}

    def handle_starttag(self, tag, attrs):
        self._end_text()
        attrs = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        n, at, nth = len(self.tag), len(self.strings), self.children.get(parent, 0) + 1
        self.children[parent] = nth
        self.parent.append(parent)
        self.scope.append(-1 if parent < 0 else parent if "itemscope" in self.attrs[parent] else self.scope[parent])
        self.tag.append(tag)
        self.classes.append(" ".join(sorted(set(attrs.get("class", "").split()))))
        self.attrs.append(attrs)
        self.first.append(at)
        self.last.append(at)
        self.end.append(n + 1)
        self.nth.append(nth)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._end_text()
        for k in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[k]] == tag:
                self._shut(k)
                return

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._end_text()
        data = data.strip()
        if data:
            self.asides.append(data)

    handle_pi = handle_comment

    def handle_decl(self, decl):
        self.handle_comment(decl[len("DOCTYPE ") :])

    def unknown_decl(self, data):
        self.handle_comment(data[len("CDATA[") :] if data.upper().startswith("CDATA[") else data)

    def _end_text(self) -> None:
        """One text node of what came since the last tag or aside: a "<" that opens nothing is handed on by itself."""
        if self.text:
            data = "".join(self.text).strip()
            self.text.clear()
            if data:
                self.strings.append(data)

    def _shut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for n in self.open[k:]:
            self.end[n] = len(self.tag)
            if self.tag[n] not in ("html", "body", "head"):
                self.last[n] = len(self.strings)
        del self.open[k:]

    def finish(self) -> None:
        self.close()
        self._end_text()
        self._shut(0)


def _offsets(lengths: Iterable[int]) -> pa.Array:
    return pa.array([0, *accumulate(lengths)], pa.int32())


def _node_lists(pages: list[_Nodes]) -> pa.Array:
    """The pages' nodes, a list a page, built field by field."""
    flat = lambda name: [x for p in pages for x in getattr(p, name)]
    attrs = flat("attrs")
    maps = pa.MapArray.from_arrays(_offsets(map(len, attrs)), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    found = {"id": pa.array([n for p in pages for n in range(len(p.tag))], pa.int32()), "attrs": maps}
    found |= {f.name: pa.array(flat(f.name), f.type) for f in _NODE_TYPE.value_type if f.name not in found}
    fields = list(_NODE_TYPE.value_type)
    return pa.ListArray.from_arrays(_offsets(len(p.tag) for p in pages), pa.StructArray.from_arrays([found[f.name] for f in fields], fields=fields))


def _parsed(page: str | None) -> _Nodes:
    p = _Nodes()
    p.feed(page or "")
    p.finish()
    return p


def _slices(sources: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of pages that have SLICE_CHARS and SLICE_PAGES at most, or one page."""
    start, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(sources), 0).to_pylist()):
        if k > start and (size + n > SLICE_CHARS or k - start == SLICE_PAGES):
            yield start, k - start
            start, size = k, 0
        size += n
    if len(sources) > start:
        yield start, len(sources) - start


def _read(pages: pa.RecordBatch, html: str) -> pa.RecordBatch:
    """The pages with their nodes, text nodes and asides; what was parsed goes with the call, before a next slice is parsed."""
    found = [_parsed(page) for page in pages.column(html).to_pylist()]
    strings, asides = (pa.array([getattr(p, name) for p in found], pa.list_(pa.string())) for name in ("strings", "asides"))
    return pa.RecordBatch.from_arrays([*pages.columns, _node_lists(found), strings, asides], [*pages.schema.names, "nodes", "strings", "asides"])


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add a page's elements (``nodes``), text nodes (``strings``) and ``asides``; broken HTML gives what could be read, null has none.

    A batch is parsed in slices of bounded length, each handed on before the next one is read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in _slices(batch.column(html)):
                yield _read(batch.slice(start, rows), html)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(parse, f"{own}, nodes {NODES}, strings array<string>, asides array<string>")


def node_text(n: Column) -> Column:
    """The text below a node of the row's page."""
    return F.array_join(F.slice(F.col("strings"), n["first"] + 1, n["last"] - n["first"]), "")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_node(nodes: Column, test) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


def meta(nodes: Column, *names: str) -> Column:
    """The content of the first meta tag with one of the names as property or name."""
    def has(want: str):
        return lambda n: F.coalesce((n["attrs"]["property"] == want) | (n["attrs"]["name"] == want), F.lit(False))

    return let(metas(nodes), lambda found: F.coalesce(*[_blank(first_node(found, has(w))["attrs"]["content"]) for w in names]))


def metas(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["tag"] == "meta")


def og_type(nodes: Column) -> Column:
    return F.lower(meta(nodes, "og:type"))


def jsonld(nodes: Column) -> Column:
    """Every JSON-LD object of the page as JSON text: scripts, members of arrays, members of graphs."""
    scripts = F.transform(F.filter(nodes, lambda n: (n["tag"] == "script") & (n["attrs"]["type"] == "application/ld+json")), node_text)
    as_array = lambda s: F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))
    return F.flatten(F.transform(scripts, lambda s: F.when(F.ltrim(s).startswith("["), as_array(s)).otherwise(F.concat(F.array(s), as_array(F.get_json_object(s, "$.@graph"))))))


def _types(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.get_json_object(s, "$.@type"), F.lit("")), F.lit("([A-Za-z]+)"), 1)


def jsonld_types(nodes: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(jsonld(nodes), _types)))


def microdata_types(nodes: Column) -> Column:
    """Types of elements that lie in no other item."""
    top = F.filter(nodes, lambda n: n["attrs"]["itemtype"].isNotNull() & (n["scope"] == -1))
    return F.array_distinct(F.transform(top, lambda n: F.regexp_replace(F.trim(n["attrs"]["itemtype"]), "^https?://schema.org/", "")))


def _role_of(types: Column, roles: dict[str, list[str]]) -> Column:
    role = F.lit(None).cast("string")
    for name, values in reversed(roles.items()):
        role = F.when(F.arrays_overlap(types, F.array(*map(F.lit, values))), name).otherwise(role)
    return role


def structural_role(repetition: Column, prices: Column) -> Column:
    grid = repetition >= GRID
    return F.when(grid, "listing").when(prices == 0, "hub").when(prices <= 5, "product").otherwise("unknown")


def signatures(nodes: Column) -> Column:
    """(tag, classes) of every element that has classes."""
    return F.transform(F.filter(nodes, lambda n: n["classes"] != ""), lambda n: F.struct(n["tag"].alias("tag"), n["classes"].alias("classes")))


def most_repeated(nodes: Column) -> Column:
    """The commonest signature (n, tag, classes), the first one of equally common ones; null without any."""
    count = lambda every, s, i: F.struct(F.size(F.filter(every, lambda x: x == s)).alias("n"), (-i).alias("place"), s["tag"].alias("tag"), s["classes"].alias("classes"))
    return F.get(F.transform(F.array(signatures(nodes)), lambda every: F.array_max(F.transform(F.array_distinct(every), lambda s, i: count(every, s, i)))), F.lit(0))


def priced_strings(strings: Column) -> Column:
    """How many of the strings show a price."""
    return F.size(F.filter(strings, lambda s: (F.length(s) > 1) & F.coalesce(text.price(s) < 9_999_999, F.lit(False))))


def page_prices() -> Column:
    """How many strings of the row's page show a price: every one counts, in scripts, comments and declarations too."""
    return priced_strings(F.concat("strings", "asides"))


def most_repetitions(nodes: Column) -> Column:
    """How often the commonest signature occurs; 0 without any."""
    return F.coalesce(most_repeated(nodes)["n"], F.lit(0))


def layered_role(nodes: Column) -> Column:
    """What Open Graph, else JSON-LD, else microdata says."""
    return F.coalesce(_role_of(F.array(og_type(nodes)), OG_ROLES), _role_of(jsonld_types(nodes), LD_ROLES), _role_of(microdata_types(nodes), MICRODATA_ROLES))


def page_roles(parsed: DataFrame) -> DataFrame:
    """Add og_type, repetition, prices, structural_role and role: what the page's mark-up says, else its structure."""
    nodes = F.col("nodes")
    counted = parsed.withColumns({"og_type": og_type(nodes), "repetition": most_repetitions(nodes), "prices": page_prices()})
    return counted.withColumn("structural_role", structural_role(F.col("repetition"), F.col("prices"))).withColumn("role", F.coalesce(layered_role(nodes), "structural_role"))


def title(nodes: Column, url: Column) -> Column:
    """The page's title up to a separator, else its first heading, else the last part of its URL."""
    first_text = lambda tag: let(first_node(nodes, lambda n: n["tag"] == tag), node_text)
    cut = lambda raw, sep: F.trim(F.substring_index(raw, sep, 1))
    own = let(F.trim(first_text("title")), lambda raw: F.when(raw.contains("|"), cut(raw, "|")).when(raw.contains("—"), cut(raw, "—")).when(raw.contains("-"), cut(raw, "-")).otherwise(raw))
    last = F.trim(F.translate(F.try_element_at(F.filter(F.split(urls.path_of(url), "/"), lambda s: s != ""), F.lit(-1)), "-_", "  "))
    return F.substring(F.coalesce(_blank(own), _blank(first_text("h1")), F.when(F.length(last) > 2, last)), 1, 1000)


_FIELDS = "struct<title:string,price_text:string,original_text:string,currency:string,image:string,description:string>"


def _fields(**columns: Column) -> Column:
    names = ("title", "price_text", "original_text", "currency", "image", "description")
    return F.struct(*[columns.get(n, F.lit(None)).cast("string").alias(n) for n in names])


def jsonld_fields(nodes: Column) -> Column:
    """The first Product's fields."""
    product = F.get(F.filter(jsonld(nodes), lambda s: F.exists(_types(s), lambda t: F.lower(t) == "product")), F.lit(0))
    get = lambda p, path: F.coalesce(F.get_json_object(p, f"$.offers.{path}"), F.get_json_object(p, f"$.offers[0].{path}"))
    image = lambda p: F.coalesce(F.get_json_object(p, "$.image[0]"), F.get_json_object(p, "$.image.url"), F.get_json_object(p, "$.image"))
    low = lambda p: get(p, "price").isNull() & get(p, "lowPrice").isNotNull()
    return let(product, lambda p: _fields(title=F.get_json_object(p, "$.name"), price_text=F.coalesce(get(p, "price"), get(p, "lowPrice"), get(p, "highPrice")), original_text=F.when(low(p), get(p, "highPrice")), currency=F.substring(F.upper(F.trim(get(p, "priceCurrency"))), 1, 3), image=image(p), description=F.substring(F.get_json_object(p, "$.description"), 1, 2000)))


def microdata_fields(nodes: Column) -> Column:
    """The first top-level Product's fields; its Offer's price and currency come first."""
    is_type = lambda n, t: F.coalesce(n["attrs"]["itemtype"].rlike(f"^\\s*https?://schema.org/{t}\\s*$"), F.lit(False))
    product = first_node(nodes, lambda n: is_type(n, "Product") & (n["scope"] == -1))["id"]
    offer = lambda product: F.coalesce(first_node(nodes, lambda n: (n["scope"] == product) & is_type(n, "Offer"))["id"], product)

    def shown(n: Column) -> Column:
        by_tag = F.when(n["tag"] == "meta", n["attrs"]["content"]).when(n["tag"].isin("a", "link", "area"), n["attrs"]["href"]).when(n["tag"].isin("img", "audio", "embed", "iframe", "source", "track", "video"), n["attrs"]["src"]).when(n["tag"] == "object", n["attrs"]["data"]).otherwise(node_text(n))
        return _blank(by_tag)

    def told(scope: Column) -> Column:
        """The item's elements that name properties: (props, node)."""
        own = F.filter(nodes, lambda n: (n["scope"] == scope) & n["attrs"]["itemprop"].isNotNull())
        return F.transform(own, lambda n: F.struct(F.split(n["attrs"]["itemprop"], r"\s+").alias("props"), n.alias("n")))

    def value(found: Column, prop: str) -> Column:
        return let(F.get(F.filter(found, lambda x: F.array_contains(x["props"], prop)), F.lit(0))["n"], shown)

    def fields(product: Column, offer: Column) -> Column:
        price = F.struct(*[value(offer, p).alias(p) for p in ("price", "lowPrice", "highPrice")])
        prices = let(price, lambda x: F.struct(F.coalesce(x["price"], x["lowPrice"], x["highPrice"]).alias("now"), F.when(x["price"].isNull() & x["lowPrice"].isNotNull(), x["highPrice"]).alias("before")))
        return let(prices, lambda x: _fields(title=value(product, "name"), price_text=x["now"], original_text=x["before"], currency=F.substring(F.upper(value(offer, "priceCurrency")), 1, 3), image=value(product, "image"), description=value(product, "description")))

    found = lambda product, offer: let(F.struct(told(product).alias("product"), told(offer).alias("offer")), lambda x: fields(x["product"], x["offer"]))
    return let(product, lambda product: F.when(product.isNotNull(), let(offer(product), lambda offer: found(product, offer))).otherwise(_fields()))


def meta_fields(nodes: Column) -> Column:
    def fields(found: Column) -> Column:
        currency = F.coalesce(meta(found, "og:price:currency"), meta(found, "product:price:currency"))
        return _fields(title=meta(found, "og:title", "twitter:title"), price_text=meta(found, "og:price:amount", "product:price:amount", "twitter:data1"), currency=F.substring(F.upper(currency), 1, 3), image=meta(found, "og:image", "twitter:image"), description=F.substring(meta(found, "description", "og:description"), 1, 2000))

    return let(metas(nodes), fields)


def auto_fields(nodes: Column) -> Column:
    """Heuristics: the heading, the best marked text with a price, the largest image."""
    area = lambda n: F.coalesce(n["attrs"]["width"].try_cast("int") * n["attrs"]["height"].try_cast("int"), F.lit(0)) + F.when(F.lower(F.concat_ws(" ", n["classes"], n["attrs"]["id"], n["attrs"]["alt"])).rlike("product|gallery"), 1_000_000).otherwise(0)
    images = F.filter(nodes, lambda n: (n["tag"] == "img") & F.coalesce(n["attrs"]["src"], n["attrs"]["data-src"]).isNotNull())
    image = F.array_max(F.transform(images, lambda n: F.struct(area(n).alias("a"), (-n["id"]).alias("i"), F.coalesce(n["attrs"]["src"], n["attrs"]["data-src"]).alias("src"))))["src"]
    shown = lambda n: F.when(n["tag"] == "meta", F.trim(n["attrs"]["content"])).otherwise(node_text(n))
    told = lambda n: F.lower(F.concat_ws(" ", n["classes"], n["attrs"]["id"], n["attrs"]["itemprop"]))
    texts = F.transform(F.filter(nodes, lambda n: n["tag"].isin("span", "div", "p", "strong", "meta")), lambda n: F.struct(n["id"].alias("id"), told(n).alias("told"), shown(n).alias("text")))
    candidates = F.filter(texts, lambda x: x["text"].rlike(r"\d") & text.price(x["text"]).isNotNull())
    points = lambda x: F.when(x["told"].contains("price"), POINTS_PRICE).otherwise(0) + F.when(x["told"].rlike("current|final"), POINTS_CURRENT).otherwise(0) + F.when(text.shows_symbol(x["text"]), POINTS_SYMBOL).otherwise(0)
    best = F.array_max(F.transform(candidates, lambda x: F.struct(points(x).alias("points"), (-x["id"]).alias("i"), x["text"].alias("text"))))["text"]
    return _fields(title=_blank(let(first_node(nodes, lambda n: n["tag"] == "h1"), node_text)), price_text=best, image=image, description=F.substring(meta(nodes, "description", "og:description"), 1, 2000))


def selector_fields(nodes: Column, selectors: dict[str, str]) -> Column:
    """Fields by a marketplace's own selectors: any of title, price, image, original_price."""
    found = {}
    for field, name in (("title", "title"), ("price", "price_text"), ("original_price", "original_text")):
        if selectors.get(field):
            found[name] = F.substring(_blank(node_text(selected(nodes, selectors[field]))), 1, 1000)
    if selectors.get("image"):
        attrs = selected(nodes, selectors["image"])["attrs"]
        found["image"] = _blank(F.coalesce(F.nullif(attrs["src"], F.lit("")), attrs["data-src"]))
    return _fields(**found)


def merged(candidates: list[Column]) -> Column:
    """One record of several: each field from the first candidate that has it."""
    names = ("title", "price_text", "original_text", "currency", "image", "description")
    return let(F.array(*candidates), lambda found: F.struct(*[F.coalesce(*[_blank(found[k][n]) for k in range(len(candidates))]).alias(n) for n in names]))


def shell_probe(tier: Column, layer: Column, currency: Column, role: Column) -> Column:
    """Whether a plain fetch looks like a script's empty shell: no currency was found, and the page isn't a product's."""
    return F.coalesce((tier == 1) & (layer == "httpx"), F.lit(False)) & currency.isNull() & ~role.eqNullSafe(F.lit("product"))


def records(roles: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Each product page's record, field by field from the first source that has it; other roles give nulls. ``roles``: page_roles()."""
    nodes = F.col("nodes")
    layers = roles.select(key, "role", merged([jsonld_fields(nodes), microdata_fields(nodes), meta_fields(nodes), auto_fields(nodes)]).alias("found"), title(nodes, F.col(url)).alias("fallback"), F.substring(F.array_join("strings", " "), 1, 4000).alias("probe"))
    texts = layers.select(key, "role", "probe", F.coalesce("found.title", "fallback").alias("title"), "found.price_text", "found.original_text", "found.currency", F.col("found.image").alias("image_url"), "found.description")
    priced = texts.withColumns({"price": text.price("price_text"), "original_price": text.price("original_text")})
    money = F.coalesce("currency", text.currency(F.col("price_text")), F.when(F.col("price").isNotNull(), text.currency(F.col("probe"))))
    shown = ~F.col("role").isin("listing", "hub")
    return priced.select(key, "role", *[F.when(shown, c).alias(n) for n, c in (("title", F.col("title")), ("price", F.col("price")), ("original_price", F.col("original_price")), ("currency", money), ("image_url", F.col("image_url")), ("description", F.col("description")))])


def flags(df: DataFrame) -> DataFrame:
    """Add success, is_partial, is_empty, missing (required fields) and completeness."""
    needed = ("title", "price", "currency")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    n = F.size("missing")
    return df.withColumn("missing", missing).withColumns({"success": F.col("price").isNotNull(), "is_partial": (n > 0) & (n < 3), "is_empty": n == 3, "completeness": F.floor((3 - n) / F.lit(3.0) * 1000 + 0.5) / 1000})


_HOST = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"


def _resolved(parsed: DataFrame, key: str, url: str, wanted) -> DataFrame:
    """The pages' own links among the anchors that ``wanted`` picks, without query and fragment, each once: key, link, path."""
    host = F.regexp_extract(F.col(url), _HOST, 1)
    rows = parsed.select(key, host.alias("host"), F.explode(F.filter("nodes", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull() & wanted(n))).alias("n"))
    href = F.trim(F.col("n")["attrs"]["href"])
    rows = rows.select(key, "host", href.alias("href")).where(~F.col("href").rlike(r"^(#|javascript:|mailto:|tel:)") & (F.col("href") != ""))
    full = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.concat("host", F.lit("/"), "href"))
    clean = rows.withColumn("link", F.regexp_replace(full, r"[?#].*$", "")).where(F.col("link").startswith(F.concat("host", F.lit("/"))))
    return clean.withColumn("path", urls.path_of(F.col("link"))).where(F.col("path") != "/").select(key, "link", "path").distinct()


def links(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Internal links of each page without query and fragment, each once: key, link, path."""
    return _resolved(parsed, key, url, lambda n: F.lit(True))


def grid_links(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Product links inside the most repeated group of GRID or more like elements: key, link, path."""
    grid = parsed.withColumn("grid", most_repeated(F.col("nodes"))).where(F.col("grid.n") >= GRID)
    cards = F.filter("nodes", lambda n: (n["tag"] == F.col("grid.tag")) & (n["classes"] == F.col("grid.classes")))
    spans = grid.withColumn("cards", F.transform(cards, lambda n: F.struct(n["id"].alias("id"), n["end"].alias("end"))))
    found = product_links(_resolved(spans, key, url, lambda a: F.exists("cards", lambda c: (c["id"] < a["id"]) & (a["id"] < c["end"]))))
    path = F.lower("path")
    numbered = path.rlike(r"/\d{4,}")
    shallow = path.endswith("/") & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= 3)
    kept = ~path.rlike("^(" + "|".join(GRID_EXCLUDED) + ")") & ~path.contains("/list/") & ~path.contains("/search") & (numbered | ~(path.contains("/category/") | path.contains("/catalog/"))) & ~shallow
    own = parsed.select(key, F.col(url).alias("own"))
    return found.where(kept).join(own, key).where(F.col("link") != F.col("own")).drop("own")


def product_links(found: DataFrame) -> DataFrame:
    """The links that look like products'."""
    path = F.col("path")
    return found.where(~urls.is_excluded(F.col("link")) & ~urls.is_category(path) & urls.is_product(path) & (F.length("link") <= 2000))


def next_page(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The href that leads on: rel=next, a marked anchor, or page=N+1."""
    nodes = F.col("nodes")
    rel = first_node(nodes, lambda n: (n["tag"] == "link") & (n["attrs"]["rel"] == "next"))["attrs"]["href"]
    current = F.nullif(F.regexp_extract(F.col(url), r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int")
    page = lambda n: F.nullif(F.regexp_extract(n["attrs"]["href"], r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int")
    marked = lambda n: F.lower(F.trim(node_text(n))).isin("next", "далее", "вперед") | node_text(n).rlike("[›→]")
    anchor = first_node(nodes, lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull() & (marked(n) | F.coalesce(page(n) == current + 1, F.lit(False))))["attrs"]["href"]
    return parsed.select(key, F.coalesce(rel, anchor).alias("next_href"))

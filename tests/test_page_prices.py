"""How many strings of a page show a price: every string counts, also those that no element shows."""

import re
from html import unescape

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_functions import plain_price

from marketgrain import queries_documents
from marketgrain.functions import html
from marketgrain.registry import QUERIES

#: Page, strings with a price, most elements of one signature.
PAGES = [
    ("<p>hello</p><!-- was 20 € -->", 1, 0),
    ("<p>20 €<!-- was 30 € -->40 €</p>", 3, 0),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN"><p>hello</p>', 1, 0),
    ("<!DOCTYPE html><!-- --><!----><!--7--><p>hello</p>", 0, 0),
    ('<?xml version="1.0"?><p>hello</p>', 1, 0),
    ("<p><![CDATA[20 €]]></p><!price 30 €></ 40>", 3, 0),
    ("<![if gte IE 9]><p>hello</p><![endif]>", 1, 0),
    ("<p>20 < 30 €</p>", 1, 0),
    ("<p>5 < 6 & 7 €</p><b>1 &lt; 20</b>", 2, 0),
    ("<script>var a = 20;</script><style>p{margin:0}</style>", 1, 0),
    ("<!-- 20 € not ended", 1, 0),
    ('<b class="x y">20 €</b><b class="y x">30 €</b><b class="x">0 €</b><!-- <b class="x">9 €</b> -->', 3, 2),
    ("", 0, 0),
    (None, 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, f"http://a.example/{k}", page) for k, (page, *_) in enumerate(PAGES)], "page_id long, url string, html string")


def test_every_string_counts(spark, sf_dir, odd, monkeypatch):
    monkeypatch.setattr(queries_documents, "marked_pages", lambda part: odd)
    want = {k: (prices, repetition) for k, (_, prices, repetition) in enumerate(PAGES)}
    assert {r.page_id: (r.n_priced, r.repetition) for r in QUERIES["doc_role_structural"](spark, sf_dir).collect()} == want
    assert {r.page_id: (r.n_priced, r.repetition) for r in QUERIES["agg_page_prices"](spark, sf_dir).collect()} == want


def test_asides_are_no_text(spark):
    page = "<title>a < b | c</title><p>one<!-- 5 € -->two</p>"
    got = html.with_nodes(spark.createDataFrame([(page,)], "html string"))
    first = got.select("strings", "asides", html.title(F.col("nodes"), F.lit("")).alias("title"), F.transform(F.filter("nodes", lambda n: n["tag"] == "p"), html.node_text).alias("p")).first()
    assert (first.strings, first.asides, first.title, first.p) == (["a < b | c", "one", "two"], ["5 €"], "a < b", ["onetwo"])


def test_prices_of_the_pages_table(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    want = {}
    for k, source in zip(table["page_id"], table["html"]):
        found = re.findall(r"<!--(.*?)-->|<!DOCTYPE (.*?)>|<script>(.*?)</script>|<style>(.*?)</style>|<[^>]*>|([^<]+)", source or "", re.S)
        strings = [unescape(s).strip() for parts in found for s in parts]
        want[k] = sum(len(s) > 1 and plain_price(s) is not None for s in strings)
    got = {r.page_id: r.prices for r in QUERIES["doc_pages_role"](spark, sf_dir).collect()}
    assert got == want and len(set(want.values())) > 1

"""The document queries over the pages table, which has no SQL, against patterns on the pages' source."""

import collections
import html
import re

import pyarrow.parquet as pq
import pytest

from marketgrain.registry import QUERIES


@pytest.fixture(scope="module")
def pages(sf_dir):
    table = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    return {k: (url, source or "") for k, url, source in zip(table["page_id"], table["url"], table["html"])}


def test_titles(spark, sf_dir, pages):
    got = {r.page_id: r.title for r in QUERIES["doc_pages_title"](spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for k, (url, source) in pages.items():
        raw = re.search(r"<title>(.*?)</title>", source, re.S)
        title = html.unescape(raw[1]).strip() if raw else ""
        for mark in "|—-":
            if mark in title:
                title = title.partition(mark)[0].strip()
                break
        first = re.search(r"<h1>(.*?)</h1>", source, re.S)
        last = [s for s in re.sub(r"[?#].*", "", url).partition("://")[2].split("/")[1:] if s]
        fallback = last[-1].translate(str.maketrans("-_", "  ")).strip() if last and len(last[-1]) > 2 else None
        assert got[k] == (title or (html.unescape(first[1]).strip() if first else "") or fallback)[:1000]


def test_links(spark, sf_dir, pages):
    got = collections.defaultdict(set)
    for r in QUERIES["doc_pages_links"](spark, sf_dir).collect():
        assert r.link not in got[r.page_id] and r.link.endswith(r.path)
        got[r.page_id].add(r.link)
    want = collections.defaultdict(set)
    for k, (url, source) in pages.items():
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", url)
        for href in re.findall(r"<a [^>]*?href=\"([^\"]*)\"", source):
            href = html.unescape(href).strip()
            if host and href and not re.match(r"#|javascript:|mailto:|tel:", href):
                full = href if "://" in href else host[0] + (href if href.startswith("/") else "/" + href)
                full = re.sub(r"[?#].*", "", full)
                if full.startswith(host[0] + "/") and full != host[0] + "/":
                    want[k].add(full)
    assert {k: v for k, v in got.items() if v} == want and sum(map(len, want.values())) > len(pages)


def test_roles_and_records(spark, sf_dir, pages):
    roles = {r.page_id: r for r in QUERIES["doc_pages_role"](spark, sf_dir).collect()}
    assert roles.keys() == pages.keys()
    for k, r in roles.items():
        marked = collections.Counter((tag, " ".join(sorted(set(c.split())))) for tag, c in re.findall(r"<(\w+) [^>]*?class=\"([^\"]+)\"", pages[k][1]))
        assert r.repetition == max(marked.values(), default=0) and r.og_type is None
        grid, n = r.repetition >= 6, r.prices
        assert r.role == r.structural_role == ("listing" if grid else "hub" if n == 0 else "product" if n <= 5 else "unknown")
    for r in QUERIES["doc_pages_record"](spark, sf_dir).collect():
        fields = {"title": r.title, "price": r.price, "currency": r.currency}
        assert r.role == roles[r.page_id].role and r.missing == ",".join(f for f, v in fields.items() if v is None)
        if r.role in ("listing", "hub"):
            assert set(fields.values()) == {None} and r.is_empty and not r.success
        else:
            assert r.success == (r.price is not None) and r.is_partial == (0 < r.missing.count(",") + bool(r.missing) < 3)

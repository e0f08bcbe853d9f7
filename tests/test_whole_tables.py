"""Queries over whole tables against plain programs."""

import pytest

from marketgrain.registry import QUERIES
from marketgrain.sources import feeds


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_bfs_uses_every_edge(spark, sf_dir, sf):
    sf_dir = sf_dir.replace("sf0.001", sf)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    out = {}
    for part, supplier in rows:
        out.setdefault(part % 500, set()).add(supplier * 7 % 500)
    want, frontier = {0: 0}, {0}
    for depth in (1, 2, 3):
        frontier = {d for n in frontier for d in out.get(n, ())} - want.keys()
        want |= dict.fromkeys(frontier, depth)
    got = [tuple(r) for r in QUERIES["disc_bfs_all"](spark, sf_dir).select("node", "depth").collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sitemap_walk_reaches_every_page(spark, sf_dir, sf):
    sf_dir = sf_dir.replace("sf0.001", sf)
    want = {r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()} - {None}
    got = [r.url for r in QUERIES["src_sitemap_walk_all"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_sitemap_walk_counts_files_of_all_levels(spark):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"

    leaf = {f"f{i:02}": f"<urlset><url><loc>u{i:02}</loc></url></urlset>" for i in range(20)}
    files = spark.createDataFrame(list(({"root": index("absent", "sub", *list(leaf)[:5]), "sub": index(*leaf)} | leaf).items()), "url string, body string")
    walk = lambda **limits: sorted(r.url for r in feeds.sitemap_walk(files, spark.createDataFrame([("site", "root", 0)], "site string, url string, place int"), **limits).collect())
    assert walk() == [f"u{i:02}" for i in range(12)]  # root, absent, f00 to f04 and sub, then f05 to f11
    assert walk(most_files=4) == ["u00"]  # first come, first served: root, absent, sub, f00
    assert walk(most_files=None) == [f"u{i:02}" for i in range(20)]
    assert walk(most_files=None, most_urls=3) == ["u00", "u01", "u02"]

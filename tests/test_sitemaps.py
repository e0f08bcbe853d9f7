"""Sitemaps: robots.txt as it comes, and walks against a queue that is worked off file by file."""

import random
from collections import deque

import pytest

from marketgrain.sources import feeds

USUAL = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml"]


@pytest.mark.parametrize(
    "body, named",
    [
        (None, []),
        ("", []),
        ("User-agent: *\nDisallow: /", []),
        ("sitemap: http://a.example/x.xml", ["http://a.example/x.xml"]),
        ("  SITEMAP:http://a.example/x.xml  \r\nSitemap:\nSitemap:   \nsitemap : http://no\n#Sitemap: http://no", ["http://a.example/x.xml"]),
        ("Sitemap: http://a.example/sitemap.xml\nSitemap: rel/path.xml\rSitemap: http://a.example/sitemap.xml", ["http://a.example/sitemap.xml", "rel/path.xml", "http://a.example/sitemap.xml"]),
    ],
)
def test_robots(spark, body, named):
    rows = feeds.robots_roots(spark.createDataFrame([("http://a.example/shop/", body)], "site string, body string"))
    got = [r.url for r in rows.orderBy("place").collect()]
    assert got == named + [u for u in (f"http://a.example{p}" for p in USUAL) if u not in named]


def by_hand(files, roots, most_files, most_urls):
    found = set()
    for site, first in roots.items():
        queue, visited, urls = deque(first), set(), []
        while queue and (most_files is None or len(visited) < most_files):
            name = queue.popleft()
            if name in visited:
                continue
            visited.add(name)
            own, nested = files.get(name, ([], []))
            queue += nested
            urls += own
        found |= {(site, u) for u in (urls if most_urls is None else urls[:most_urls])}
    return sorted(found)


@pytest.mark.parametrize("seed, most_files, most_urls", [(1, 15, 50_000), (2, 6, 9), (3, None, None)])
def test_walk(spark, seed, most_files, most_urls):
    rng = random.Random(seed)
    files, roots, stored = {}, {}, []
    for k in range(8):
        names = [f"http://s{k}/{i}" for i in range(30)]
        roots[f"s{k}"] = rng.sample(names, 3) + [names[0]]
        for name in names:
            own = [f"http://s{k}/p/{rng.randrange(40)}" for _ in range(rng.randrange(4))]
            nested = rng.sample(names, rng.randrange(4))
            kind = rng.random()
            if kind < 0.7:
                files[name] = (own, nested)
                body = "".join(f"<url><loc> {u} </loc></url>" for u in own) + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in nested)
                stored.append((name, f'<?xml version="1.0"?><sitemapindex xmlns="http://x">{body}</sitemapindex>'))
            elif kind < 0.8:
                stored.append((name, "<html>not found</html>"))
            elif kind < 0.9:
                stored.append((name, "<urlset><url><loc>http://broken</loc>"))
    rows = feeds.sitemap_walk(
        spark.createDataFrame(stored, "url string, body string"),
        spark.createDataFrame([(s, u, i) for s, first in roots.items() for i, u in enumerate(first)], "site string, url string, place int"),
        most_files,
        most_urls,
    )
    assert sorted(map(tuple, rows.select("site", "url").collect())) == by_hand(files, roots, most_files, most_urls)


def test_nothing_to_walk(spark):
    files = spark.createDataFrame([], "url string, body string")
    assert feeds.sitemap_walk(files, spark.createDataFrame([], "site string, url string, place int")).count() == 0
    assert feeds.sitemap_walk(files, spark.createDataFrame([("s", "u", 0)], "site string, url string, place int")).count() == 0

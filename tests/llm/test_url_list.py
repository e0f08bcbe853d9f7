"""The URL list of op8_url_list: pages that reach the Bloom filter, the exact join, and both outcomes of it."""

import re

from pyspark.sql import functions as F

from marketgrain.llm import queries, urls


def test_list_blocks_pages(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op8_url_list"](spark, sf_dir).collect()}
    names = re.compile(r"(^|\.)(adult-x|casino-win|free-bets|cheap-pills|spam-farm|ads-track)\.")
    listed = {i for i, u in pages.items() if u and names.search(re.sub(r"^.*?://([^/?#]*).*", r"\1", u, flags=re.S).lower())}
    assert got.keys() == pages.keys() and listed
    assert all(got[i].verdict == "block" for i in listed if got[i].rule is None)
    assert any(got[i].rule is None for i in listed)
    assert any(r.rule is None and r.verdict == "allow" for r in got.values())


def test_bloom_hits_exact_hits_and_false_positives(spark):
    pages = spark.range(20_000).select(F.format_string("http://site.test/%d", "id").alias("url"))
    listed = pages.where("cast(substring(url, 18) as int) % 40 = 0")
    n_blocks = -(-500 * urls.BITS_PER_URL // 64)
    canonical = urls.canonical_url(F.col("url"))
    probed = pages.select("url", canonical.alias("canonical"), urls._block(canonical, n_blocks).alias("block"), urls._bits(canonical).alias("mask"))
    hits = {r.url for r in probed.join(urls.filter_blocks(listed.select(canonical.alias("canonical")), n_blocks), "block").where("bits & mask = mask").collect()}
    exact = {r.url for r in listed.collect()}
    assert len(exact) == 500 and exact < hits and len(hits) < 2_000
    assert {r.url for r in urls.url_filter(pages, listed, []).where("verdict = 'block'").collect()} == exact


def test_list_in_other_spellings_blocks_the_same_pages(spark, sf_dir):
    for name in ("op8_url_filter", "op8_url_list"):
        got = {r.page_id: r.verdict for r in queries.QUERIES[name](spark, sf_dir).where("rule is null").collect()}
        assert "block" in got.values() and "allow" in got.values()
        if name == "op8_url_filter":
            first = got
    assert got == first
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = queries.listed_urls(pages)
    spelt = {r.url for r in pages.collect()}
    assert listed.count() > 0 and not [r.url for r in listed.collect() if r.url in spelt]


def test_own_columns_are_kept_on_both_paths(spark):
    rows = [(i, None if i % 3 == 0 else f"http://www.site.test/{i % 50}/?ref=a", i, "b", [i], "c", "d", True) for i in range(300)] + [(1, "http://A.test/" + "x" * 50_000, 0, "b", [0], "c", "d", False)] * 2
    names = "page_id long, url string, block long, bits string, canonical array<long>, part string, found string, page boolean"
    pages = spark.createDataFrame(rows, names)
    listed = spark.createDataFrame([(f"https://site.test/{i}",) for i in range(0, 50, 2)] + [("http://a.test/" + "x" * 50_000 + "/",), (None,), ("no scheme",)], "url string")
    want = sorted((*(str(v) for v in r), "block" if r[1] and ("x" in r[1] or int(r[1].split("/")[3]) % 2 == 0) else "allow") for r in rows)
    for most in (200_000, 0):
        got = urls.url_filter(pages, listed, [], broadcast_urls=most)
        assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]
        assert sorted((*(str(v) for v in r[:8]), r.verdict) for r in got.collect()) == want


def test_ties_between_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.test/p/q")], "page_id long, url string")
    verdict = lambda rules: urls.url_filter(pages, pages.limit(0), rules).first().verdict
    assert verdict([("b.test/", "block"), ("test/p/", "allow")]) == "allow" and verdict([("test/p/", "block"), ("b.test/p/", "allow")]) == "allow"

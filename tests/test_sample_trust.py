"""disc_sample_trust and its rule against a plain program; only the order of the sample is taken from the engine."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from marketgrain.operators.lifecycle import sampled_trust
from marketgrain.registry import QUERIES


def plain(rows):
    """rows: group, url, role, hash."""
    groups, taken = defaultdict(list), []
    for group, url, role, hash_ in rows:
        groups[group].append((hash_, url, role == "product"))
    for group, found in groups.items():
        found.sort()
        ratio = sum(product for _, _, product in found[:50]) / len(found[:50])
        for k, (_, url, product) in enumerate(found):
            if len(found) > 100 and ratio >= 0.8:
                product = True
            elif len(found) > 100 and ratio < 0.2:
                product = product and k < 50
            taken.append((group, url, product))
    return sorted(taken)


def test_query_on_groups_over_a_hundred(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.xxhash64("url", F.lit(7)).alias("h")).collect()
    rows = [(re.search(r"://([^/]*)", r.url)[1], r.url, "product" if len(r.url) % 3 == 0 else "hub", r.h) for r in pages]
    assert sorted(tuple(r) for r in QUERIES["disc_sample_trust"](spark, sf_dir).collect()) == plain(rows)


def test_every_outcome(spark):
    sizes = {"small": (100, 10), "all": (150, 10), "few": (150, 1), "some": (150, 5), "none": (101, 0)}  # pages, tenths that are products
    urls = spark.createDataFrame([(g, f"{g}/{i}", "product" if i % 10 < tenths else "hub") for g, (n, tenths) in sizes.items() for i in range(n)], '`group` string, url string, role string')
    got = sorted(tuple(r) for r in sampled_trust(urls).select("group", "url", "taken").collect())
    assert got == plain([tuple(r) for r in urls.withColumn("h", F.xxhash64("url", F.lit(7))).collect()])
    n = {g: sum(t for name, _, t in got if name == g) for g in sizes}
    assert n["small"] == 100 and n["all"] == 150 and n["none"] == 0 and 0 < n["few"] < 15 and n["some"] == 75

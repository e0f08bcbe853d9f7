"""What keeps the work of a page bounded: pages dealt over tasks, slices of a batch, and parts of expressions found once."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketgrain.functions import html, text
from marketgrain.sources import markup


@pytest.fixture(scope="module")
def part(spark):
    return spark.range(3 * markup.PAGES_A_TASK).selectExpr("id AS p_partkey", "'lamp' AS p_name", "1.5D AS p_retailprice").coalesce(1)


def test_parts_are_dealt_over_tasks(spark, part, tmp_path):
    from marketgrain.registry import QUERIES

    part.write.parquet(f"{tmp_path}/part.parquet")
    tasks = QUERIES["doc_og_type"](spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) == 3 and max(r["count"] for r in tasks) < 2 * markup.PAGES_A_TASK


def test_batches_are_parsed_in_slices(spark):
    sources = pa.array(["x" * 10] * (2 * html.SLICE_PAGES + 1) + [None, "x" * (html.SLICE_CHARS + 1), "x"])
    found = list(html._slices(sources))
    assert [start for start, _ in found] == [sum(rows for _, rows in found[:k]) for k in range(len(found))]
    assert sum(rows for _, rows in found) == len(sources) and max(rows for _, rows in found) == html.SLICE_PAGES
    assert list(html._slices(pa.array([], pa.string()))) == []
    pages = spark.range(3000, numPartitions=1).selectExpr("id", "concat('<b class=\"x y\">', id, '</b>') AS html")
    got = html.with_nodes(pages).select("id", F.element_at("strings", 1).alias("s"), F.element_at("nodes", 1)["classes"].alias("c")).collect()
    assert [(r.id, r.s, r.c) for r in got] == [(k, str(k), "x y") for k in range(3000)]


def test_a_slice_is_gone_before_the_next_is_parsed():
    parse = html.with_nodes(SimpleNamespace(schema=[], mapInArrow=lambda parse, schema: parse))

    def peak(slices: int) -> int:
        batch = pa.record_batch({"html": ["<p class='a b'>x</p>" * 20] * (slices * html.SLICE_PAGES)})
        tracemalloc.start()
        assert sum(done.num_rows for done in parse(iter([batch]))) == len(batch)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(1)
    assert peak(6) < 1.3 * peak(1)


@pytest.mark.parametrize("name", ["doc_pages_title", "doc_pages_role"])
def test_a_page_query_holds_one_slice(spark, sf_dir, monkeypatch, name):
    from marketgrain.registry import QUERIES

    frame, steps = type(spark.range(0)), []
    kept = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, step, *more: steps.append(step) or kept(self, step, *more))
    QUERIES[name](spark, sf_dir)
    (parse,) = steps

    def peak(pages: int) -> int:
        batch = pa.record_batch({"page_id": list(range(pages)), "url": ["http://a.example/b"] * pages, "html": ["<p class='a b'>x</p>" * 20] * pages})
        tracemalloc.start()
        assert sum(done.num_rows for done in parse(iter([batch]))) == pages
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(500)
    assert peak(3000) < 1.5 * peak(500)


def test_parts_of_expressions_are_found_once():
    nodes = F.col("nodes")
    assert str(text.currency(F.col("t"))).count("lower(") == 2
    assert str(html.auto_fields(nodes)).count("array_join(") == 2
    assert str(html.microdata_fields(nodes)).count("array_join(") <= 7


def test_an_only_amount_and_rivals(spark):
    rows = [("12.50 €", 12.5), ("1,5", 1.5), ("1.234.567,89", 1234567.89), ("0", None), ("9000000 €", None), ("9000000", None), ("7 items, 8 €", 8.0), ("sale 9000000 items, 12", 12.0), ("a", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want double").select("t", "want", text.price("t").alias("got")).collect()
    assert [(r.t, r.got) for r in got] == rows


def test_a_crawls_pages_are_parsed_once(spark, sf_dir, monkeypatch):
    from marketgrain.registry import QUERIES

    asked, links = [], html.links
    monkeypatch.setattr(html, "links", lambda pages, *more: asked.append(pages._jdf.queryExecution().toString()) or links(pages, *more))
    QUERIES["disc_bfs"](spark, sf_dir)
    assert asked and not any("MapInArrow" in plan for plan in asked)

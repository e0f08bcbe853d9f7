"""What queries leave in the shared folder: their results only; and archives that are added to keep what they had."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketgrain.llm import shared, warc
from marketgrain.llm.queries import QUERIES

#: Folders that hold a query's result.
LEFT = {"op5_token_shards": {"shards", "manifest"}, "op9_warc": {"warc"}, "op6_quality_rules": set(), "op7_toxicity": set(), "op12_whitening": set()}


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    os.makedirs(f"{tmp_path}/shared")
    return f"{tmp_path}/shared"


def left(folder):
    return sorted(os.listdir(folder))


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_only_the_result_is_left(spark, sf_dir, folder, name):
    rows = (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, sf_dir)
    found = {n.rpartition("-")[0] for n in left(folder)}
    assert found == LEFT[name] if name in LEFT else len(left(folder)) == 1
    assert rows.count() > 0


def test_a_failure_leaves_nothing(spark, folder):
    def broken():
        kept = shared.written(spark.range(3), "part")
        return kept.select(F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        shared.settled(spark, broken, "result")
    assert left(folder) == []


def test_a_second_write_keeps_the_first_archives(spark, folder):
    pages = spark.createDataFrame([(k, f"http://a/{k}", "x" * 1500) for k in range(1, 4)], "page_id long, url string, html string")
    path = warc.write_pages(pages.where("page_id < 3"), f"file://{folder}/archive")
    warc.write_pages(pages.where("page_id = 3"), path)
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    assert ids() == ["urn:x-page:1", "urn:x-page:2", "urn:x-page:3"]
    warc.write_pages(pages.limit(0), path)
    assert len(ids()) == 3
    warc.page_records(pages.where("page_id = 2")).write.format("warc").mode("overwrite").option("path", path).save()
    assert ids() == ["urn:x-page:2"]
    assert len([n for n in os.listdir(f"{folder}/archive") if n.endswith(".warc.gz") or n.startswith("_files")]) == 2


def test_a_write_that_broke_off_is_not_read(spark, folder):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string")
    path = warc.write_pages(pages.where("page_id = 1"), f"file://{folder}/archive")
    other = warc.write_pages(pages.where("page_id = 2"), f"file://{folder}/other")
    for name in os.listdir(f"{folder}/other"):
        if name.endswith(".warc.gz"):  # an archive of an attempt that no list names
            os.rename(f"{folder}/other/{name}", f"{folder}/archive/{name}")
    assert [r.record_id for r in warc.read_warc(spark, path).collect()] == ["urn:x-page:1"] and other

"""Ways that small tables don't take by themselves: joins instead of broadcasts, shared and hot identifiers, odd headers and files."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from marketgrain.llm import encode, licenses, neardups, quality, shared, sstable, substrings, warc

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_a_pushed_null_matches_nothing(spark):
    pages = spark.createDataFrame([(1, "u", "small"), (2, None, "small"), (3, "v", "small")], "page_id long, url string, html string")
    read = warc.read_warc(spark, warc.write_pages(pages))
    assert read.where("target_uri IN ('u', NULL)").count() == 1
    assert read.where("target_uri = 'v' AND record_type IN ('response', NULL)").count() == 1
    assert read.where("refers_to = 'x'").count() == 0


def test_revisits_by_a_join_and_large_payloads(spark):
    big = "é" * 3_000_000
    rows = [(i, f"http://a/{i}", "x" * 2000 if i % 3 else f"own {i}", "clash") for i in range(300)] + [(1000, "w", big, "c"), (1001, "w", big, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for most in (500_000, 0):
        got = {r.record_id: r for r in warc.page_records(pages, broadcast_digests=most).select("record_id", "record_type", "refers_to").collect()}
        assert sum(r.record_type == "revisit" for r in got.values()) == 200 and got["urn:x-page:1"].refers_to == "urn:x-page:299" and got["urn:x-page:1000"].refers_to == "urn:x-page:1001"
    read = warc.read_warc(spark, warc.write_pages(pages)).where("record_id = 'urn:x-page:1001'").first()
    assert read.payload.decode() == big


def test_an_id_too_large_for_its_bytes_raises(tmp_path):
    import numpy as np

    writer = sstable.ShardWriter(open(tmp_path / "x.sst", "wb"), 2)
    writer.add(1, 0, np.array([65_535], np.uint32))
    with pytest.raises(ValueError, match="70000"):
        writer.add(2, 0, np.array([70_000], np.uint32))


def test_shared_and_null_identifiers_over_many_shards(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") * 10).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("clash").alias("path"))
    manifest = sstable.write_shards(docs, WORD, shard_bytes=4000)
    assert manifest.count() > 5 and manifest.where("first_id = 7 and last_id = 7").count() > 1
    read = sstable.read_shards(manifest).collect()
    ends = sorted((r.start, r.start + len(r.ids) // 4) for r in read)
    assert len(read) == 3000 and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    ordered = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    asked = [10, 20, 70, 7, 5, 29_980, 99_999, None, -3]
    got = {r.doc_id: r.ids for r in sstable.lookup(manifest, spark.createDataFrame([(i,) for i in asked], "doc_id long")).collect()}
    known = {r.doc_id for r in read}
    assert {i for i, ids in got.items() if ids is not None} == {i for i in asked if i in known} and len(got) == len(asked)


def test_tokenizers_of_other_kinds_are_encoded_whole(tmp_path):
    spec = json.load(open(WORD, encoding="utf-8"))
    assert encode.in_pieces(spec)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+ ?[\p{L}]*|[^\s\p{L}]+"
    assert not encode.in_pieces(spec)
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    texts = ["Two words, and more", None, "", "naïve café  x"]
    ids, offsets = encode.encode(pa.array(texts), path)
    library = encode.piece_encoder(path).tokenizer
    assert [library.encode(t or "", add_special_tokens=False).ids for t in texts] == [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_licenses_by_joins_with_clashing_columns(spark, monkeypatch):
    rows = [(i, "Some text.\nReleased under the MIT License.\n" * (i % 3) + "x " * (20_000 if i == 5 else 1), i, "n", "l", "r") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, normal string, license string, page string")
    known = licenses.known_licenses(spark)
    want = sorted((i, i, i % 3, ["MIT-notice"] if i % 3 else []) for i in range(40))
    for most, few in ((100_000, 200_000), (0, 0)):
        monkeypatch.setattr(licenses, "BROADCAST_ROWS", few)
        got = licenses.license_scan(docs, known, broadcast_texts=most)
        assert got.columns == ["doc_id", "text", "row", "normal", "page", "text_sha256", "license", "n_license_lines", "line_licenses"]
        assert sorted((r.doc_id, r.row, r.n_license_lines, r.line_licenses) for r in got.collect()) == want


def test_quality_keeps_clashing_columns_and_counts_long_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(140_000))
    docs = spark.createDataFrame([(1, long, 9, "a", [1], 5), (2, "a b c a b c", 9, "a", [1], 5)], "doc_id long, text string, words int, lines string, row array<int>, kept int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, with_text=False).collect()}
    assert got[1].n_repeat_words == 140_000 and got[2].n_repeat_words == 6 and got[2].words == 9 and got[2].lines == "a" and got[2].row == [1]


def test_spread_join_of_hot_and_null_keys(spark, monkeypatch):
    big = shared.written(spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("key"), F.col("id").alias("by")), "big")
    small = spark.range(0, 4000, 2).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value")).unionByName(spark.createDataFrame([(5, 1), (5, 2)], "key long, value long"))
    monkeypatch.setattr(shared, "LEAST_HOT_ROWS", 10)
    for how in ("inner", "left"):
        got, want = (sorted(map(str, df.select("key", "by", "value").collect())) for df in (shared.spread_join(big, small, "key", "by", how), big.join(small, "key", how)))
        assert got == want


def test_settled_deletes_what_was_written_on_the_way(spark):
    made = []

    def make():
        first = shared.written(spark.range(10), "first")
        made.extend(first.inputFiles())
        return first.where("id > 3")

    assert shared.settled(spark, make, "settled").count() == 6
    import os

    assert made and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in made)


def test_documents_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base[1:]])), (2, "quite another text of seven words here"), (9, "quite another text of seven words here"), (None, " ".join(base)), (None, "alone in the world, without a name at all"), (7, "") , (7, "")]
    docs = spark.createDataFrame([(*r, "row of its own") for r in rows], "doc_id long, text string, row string")
    got = neardups.near_duplicates(docs, carry=("text",)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (9, 1), (None, None), (7, 7)}
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.first) == [(False, 1, rows[0][1]), (False, 7, ""), (False, 7, ""), (True, None, rows[5][1])]
    window = " ".join(base)
    shared_ids = spark.createDataFrame([(3, window + " a"), (3, window + " b"), (3, window + " b"), (4, window)], "doc_id long, text string")
    removed = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(shared_ids).collect())
    assert removed in ([(3, 0), (3, 60), (3, 60), (4, 60)], [(3, 0), (3, 0), (3, 60), (4, 60)])


def test_identifiers_joined_instead_of_broadcast(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{i}", *base[1:]] if i % 2 else [f"y{i * 7 + k}" for k in range(40)] + base[:25])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for most in (500_000, 0):
        monkeypatch.setattr(neardups, "BROADCAST_IDS", most)
        monkeypatch.setattr(substrings, "BROADCAST_IDS", most)
        results.append((sorted(map(tuple, neardups.near_duplicates(docs).collect())), sorted(map(tuple, substrings.remove_repeats(docs).collect())), sorted(map(tuple, substrings.remove_repeats(docs, with_text=False).collect()))))
    assert results[0] == results[1] and any(r[2] for r in results[0][1])


def test_very_long_texts(spark):
    from marketgrain.llm import decontaminate, packing

    long = " ".join(f"word{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 500_000)], "doc_id long, text string")
    byte = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(docs, byte, 1024, 2).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids, offsets = encode.encode(pa.array([long, long + " end", "x" * 500_000]), byte)
    assert {r.doc_id: r.n for r in pieces} == {k + 1: int(offsets[k + 1] - offsets[k]) + 1 for k in range(3)}
    assert {r.doc_id: r.component_id for r in neardups.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 195_000, 2: 200_000, 3: 0}
    items = spark.createDataFrame([(7, " ".join(f"word{i}" for i in range(100, 140)))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()} == {1: 1600, 2: 1600, 3: 0}

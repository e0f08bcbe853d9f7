"""Nulls, empty tables, repeated rows and clashing columns have defined results; helpers hold their invariants."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marketgrain.llm import decontaminate, encode, licenses, neardups, packing, quality, sstable, substrings, textarrays, toxicity, urls, warc
from marketgrain.llm.components import connected_components

TEXT = " ".join(f"w{i}" for i in range(21)) + " "
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB \n\t9é.-\x0b") for _ in range(rng.randrange(40))) for _ in range(500)] + [None, ""]
    hashes, offsets = textarrays.word_hashes(*textarrays.text_buffers(pa.array(texts)), textarrays.SPACES)
    seen = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        assert offsets[i + 1] - offsets[i] == len(words)
        for word, h in zip(words, hashes[offsets[i] : offsets[i + 1]]):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_encoding_equals_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBé  \n\t'sll 9.-́ Σ<|>") for _ in range(rng.randrange(40))) for _ in range(800)] + [None, "", "<|endoftext|> a"]
    for path in (BYTE, WORD):
        ids, offsets = encode.encode(pa.array(texts), path)
        library = encode.piece_encoder(path).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [e.ids for e in library] == [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_fits_and_keeps_all(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 64))


def test_local_search_empties_a_bin():
    # 6+3 and 5+4 leave one free place each; 1+1 fits only there
    bins = packing.local_search([[0, 1], [2, 3], [4, 5]], [6, 3, 5, 4, 1, 1], 10)
    assert len(bins) == 2


def test_packing_rows(spark, odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, BYTE, 64, with_ids=True)
    assert sum(1 for r in got.collect() if r.doc_id == 5 and r.piece == 0) == 2
    assert [r.length for r in got.where("doc_id in (2, 3)").collect()] == [1, 1]
    assert all(len(r.ids) == r.length for r in got.collect())
    assert packing.pack_documents(no_docs, BYTE).count() == 0
    small = packing.pack(spark.range(500).selectExpr("id AS doc_id", "1 + id % 60 AS length"), 64, task_pieces=50)
    assert small.count() == 500 and small.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 64").count() == 0


def test_near_duplicates(odd_docs, no_docs):
    got = [(r.doc_id, r.component_id, r.kept) for r in neardups.near_duplicates(odd_docs).collect()]
    assert (6, 1, False) in got and got.count((5, 1, False)) == 2  # case aside, and twice the same row
    assert (2, 2, True) in got and (3, 3, True) in got and (None, None, True) in got
    assert (8, 7, False) in got  # white space aside
    assert neardups.near_duplicates(no_docs).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardups, "BLOCK", 4)
    rng = random.Random(2)
    base, texts = [f"w{i}" for i in range(80)], []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert {r.doc_id: r.component_id for r in neardups.near_duplicates(frame).collect()} == dict(enumerate(root))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[103] == got[101] == got[100] == 100


def test_decontaminate(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, None), (2, "two three four")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(odd_docs, items).where("doc_id is not null").collect()}
    assert got[1].n_hit == 3 and got[1].items == ["2"] and got[2].n_words == 0 and not got[2].contaminated
    assert decontaminate.decontaminate(no_docs, items).count() == 0
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).where("contaminated").count() == 0


def test_shards(odd_docs, no_docs, spark):
    manifest = sstable.write_shards(odd_docs, WORD)
    read = sstable.read_shards(manifest).collect()
    assert len(read) == odd_docs.count() and read[0].doc_id is None or any(r.doc_id is None for r in read)
    ends = sorted((r.start, r.start + len(r.ids) // 4) for r in read)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    found = {r.doc_id: r.ids for r in sstable.lookup(manifest, spark.createDataFrame([(1,), (77,)], "doc_id long")).collect()}
    assert found[77] is None and len(found[1]) > 4
    assert sstable.read_shards(sstable.write_shards(no_docs, WORD)).count() == 0


def test_quality(odd_docs, no_docs):
    got = {r.doc_id: r for r in quality.quality_rules(odd_docs).collect() if r.doc_id not in (5, 7, None)}
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[12].n_repeat_words == 200 and got[12].base_failed
    assert got[9].n_words == 30_000 and got[9].lang == "en"
    assert quality.quality_rules(no_docs).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.NET/en/1?q#f", "x"), (4, "http://b.example.com/de/", "x"), (5, "http://www.bad.example.com/p/?utm_source=1", "x"), (5, "http://www.bad.example.com/p/?utm_source=1", "x")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://m.bad.example.com/p",), (None,)], "url string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(pages, listed, rules).collect()]
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got
    assert (3, "a.example.net", "/en/1", "example.net/en/", "allow") in got and (4, "b.example.com", "/de/", "example.com/de/", "block") in got
    assert got.count((5, "www.bad.example.com", "/p/", None, "block")) == 2
    assert urls.url_filter(pages.limit(0), listed, rules).count() == 0
    assert urls.url_filter(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 1


def test_warc_pushdown_and_edges(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/\r\nEvil: 1", big), (2, None, big), (3, "u", None), (None, "v", "small"), (4, "w", big), (4, "w", big)], "page_id long, url string, html string")
    path = warc.write_pages(pages)
    read = warc.read_warc(spark, path)
    got = sorted((r.record_id, r.record_type, r.refers_to) for r in read.collect())
    assert got.count(("urn:x-page:4", "response", None)) == 2 and ("urn:x-page:1", "revisit", "urn:x-page:4") in got
    assert ("urn:x-page:null", "response", None) in got
    heads = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    assert heads.count() == 2 and heads.where("payload is not null").count() == 0
    assert warc.read_warc(spark, warc.write_pages(pages.limit(0))).count() == 0


def test_licenses(spark, odd_docs):
    known = licenses.known_licenses(spark)
    mit = "Copyright (c) 2024 Someone\n\n" + licenses.KNOWN["MIT"].replace("Software", "SOFTWARE").replace(",", " ;")
    docs = spark.createDataFrame([(1, mit), (2, "Text.\nReleased under the MIT Licence!\nMore."), (3, None), (4, " \n")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs, known).collect()}
    assert got[1].license == "MIT" and got[2].license is None and got[2].line_licenses == ["MIT-notice"] and got[2].n_license_lines == 1
    assert got[3].text_sha256 is None and got[4].text_sha256 is None
    assert licenses.license_scan(odd_docs, known.limit(0)).where("license is not null").count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "nice words here " + ("vile nasty" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    model = toxicity.fit(docs, labels)
    assert {r.doc_id % 2: r.toxic for r in toxicity.score(docs, model).collect()} == {0: False, 1: True}
    assert toxicity.score(odd_docs, model).where("toxic").count() == 0 and toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("toxic or expected_severity > 0").count() == 0


def test_substrings(odd_docs, no_docs, spark):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd_docs).collect()]
    assert (1, 21, 0) in got and got.count((5, 21, 21)) == 2 and (10, 42, 42) in got and (2, 0, 0) in got and (None, 21, 0) in got
    assert (6, 21, 0) in got  # words count as they are
    assert substrings.remove_repeats(no_docs).count() == 0
    shared = spark.createDataFrame([(1, TEXT, "a"), (2, TEXT + "x", "b"), (2, "other words", "c"), (None, TEXT, "d")], "doc_id long, text string, source string")
    kept = sorted((r.source, r.n_removed, r.kept_text) for r in substrings.remove_repeats(shared, carry=("source",)).collect())
    assert kept == [("a", 0, TEXT), ("b", 21, "x"), ("c", 0, "other words"), ("d", 0, TEXT)]
    twins = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(twins).collect()] == [0, 0]


def test_suffix_automaton(spark):
    rng = random.Random(1)
    for _ in range(30):
        reference, words = [[rng.choice("abc") for _ in range(30)] for _ in range(2)], [rng.choice("abcd") for _ in range(40)]
        inside = lambda run: any(r[i : i + len(run)] == run for r in reference for i in range(30))  # noqa: E731, B023
        want = [max((k for k in range(i + 2) if inside(words[i + 1 - k : i + 1])), default=0) for i in range(40)]
        assert substrings.SuffixAutomaton(reference).matching_statistics(words) == want
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_reference(docs, spark.createDataFrame([("z a b c d",)], "text string"), least=3).collect()}
    assert got[1].n_removed == 4 and got[1].kept_text == "x y" and got[2].n_words == 0


def test_window_minima():
    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 5, 9, 13, 50):
        assert decontaminate.window_minima(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]

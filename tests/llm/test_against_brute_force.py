"""Each query that SQL cannot express, against a plain program over the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from marketgrain.llm.queries import QUERIES

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_packing(spark, sf_dir, texts):
    tokenizer, found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.defaultdict(list)
    sequences, total = collections.defaultdict(list), 0
    for r in rows(spark, sf_dir, "op1_packing"):
        found[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        total += len(ids)
        for k, r in enumerate(sorted(found[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * total / 1024 + 1


def test_near_dedup(spark, sf_dir, texts):
    sets = {}
    for doc, text in texts.items():
        w = SPACED.findall(low(text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in rows(spark, sf_dir, "op2_near_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination(spark, sf_dir, texts, bound):
    from marketgrain.llm.decontaminate import decontaminate

    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    pairs = [*zip(items["item_id"], items["text"]), (9001, "Of the"), (9002, None), (9003, "?!")]
    windows = collections.defaultdict(set)
    for item, text in pairs:
        w = ALNUM.findall(low(text))
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    frame = spark.createDataFrame(pairs, "item_id long, text string")
    for r in decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), frame, broadcast_windows=bound).collect():
        w = ALNUM.findall(low(texts[r.doc_id]))
        hit, names = [0] * len(w), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    names |= got
                    hit[i : i + k] = [1] * k
        n = sum(hit)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), n, len(names), n > 0 and 20 * n >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_token_shards(spark, sf_dir, texts):
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    found = sorted(rows(spark, sf_dir, "op5_token_shards"), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == sorted(texts)
    for r in found:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_toxicity_on_held_out_labels(spark, sf_dir):
    from marketgrain.llm.toxicity import fit, score

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    truth = labels.where("doc_id % 3 = 0").selectExpr("doc_id", "toxic = 1 AS truth")
    held = score(docs, model).join(truth, "doc_id").collect()
    assert np.mean([r.toxic == r.truth for r in held]) > 0.95


def test_warc(spark, sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    found = {r.page_id: r for r in rows(spark, sf_dir, "op9_warc")}
    largest = {}
    for page, html in zip(pages["page_id"], pages["html"]):
        raw = (html or "").encode()
        if len(raw) >= 1000:
            largest[raw] = max(page, largest.get(raw, page))
    for page, html in zip(pages["page_id"], pages["html"]):
        raw, r = (html or "").encode(), found[page]
        first = largest.get(raw, page)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))


def test_substring_dedup(spark, sf_dir, texts):
    seen = set()
    found = {r.doc_id: r for r in rows(spark, sf_dir, "op10_substring_dedup")}
    for doc in sorted(texts):
        w = SPACED.findall(texts[doc] or "")
        gone = [0] * len(w)
        for i in range(len(w) - 19):
            if (g := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [1] * 20
            seen.add(g)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = found[doc]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())

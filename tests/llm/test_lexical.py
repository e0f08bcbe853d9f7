"""Operator 13 against scoring every document."""

import collections
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketgrain.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n int, terms string, item string, score int"
ITEMS = "item_id string, text string, item int, hash string, doc_id int"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k):
    counted = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        found += [(item, n + 1, doc, -score) for n, (score, _, doc) in enumerate(scored[:k])]
    return sorted(found, key=repr)


def found(spark, docs, items, k):
    docs = spark.createDataFrame([(d, t, 1, "x", "y", 2) for d, t in docs], DOCS).repartition(3)
    items = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEMS)
    return sorted(map(tuple, lexical.rank_documents(docs, items, k).collect()), key=repr)


def corpus(rng, n, words):
    return [(i, " ".join(rng.choices([f"w{j}" for j in range(words)], [1 / (j + 1) for j in range(words)], k=rng.randrange(1, 60)))) for i in range(n)]


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 256)  # several segments, with blocks and a rest
    monkeypatch.setattr(lexical, "FIRST_RANGES", 2)
    rng = random.Random(5)
    docs = corpus(rng, 1500, 200)
    docs += [(5000 + i, "w3 w9 common") for i in range(40)]  # ties
    items = [(f"i{i}", " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 30)))) for i in range(20)] + [("tie", "common w9 common"), ("none", "absent")]
    assert found(spark, docs, items, 12) == by_hand(docs, items, 12)


def test_several_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_TERMS", 8)
    rng = random.Random(6)
    docs, items = corpus(rng, 120, 40), [(f"i{i}", f"w{i} w{i + 1} w{2 * i}") for i in range(12)]
    assert found(spark, docs, items, 5) == by_hand(docs, items, 5)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 700}" for i in range(30_000))
    docs = [(1, "Ünï CAFÉ naïve"), (2, None), (3, ""), (4, " ,.;"), (None, "café one"), (5, "café one"), (5, "café one"), (6, "ONE one 1"), (7, long), (8, "x_y-z")]
    items = [("a", "CAFé one"), ("a", "one"), (None, "ünï z"), ("b", None), ("c", "..."), ("d", "v3 v3 v699 y"), ("e", "CAFÉ")]
    for k in (3, 9):
        assert found(spark, docs, items, k) == by_hand(docs, items, k)


def test_empty_tables(spark):
    docs, items = [(1, "one two")], [("a", "one")]
    assert found(spark, [], items, 3) == [] and found(spark, docs, [], 3) == [] and found(spark, [(1, "")], items, 3) == []
    assert found(spark, docs, items, 3) == by_hand(docs, items, 3)


def segment_of(docs, size):
    """A segment over documents given as dicts of term and count."""
    doc, term, count = (np.array(c, np.int64) for c in zip(*[(i, t, n) for i, d in enumerate(docs) for t, n in d.items()]))
    m = lexical.length_terms(np.array([sum(d.values()) for d in docs]), len(docs), sum(sum(d.values()) for d in docs))
    return lexical.Segment(lexical._segment(np.arange(size), np.zeros(size, bool), m, doc, term.astype(np.int32), count.astype(np.int32))), m


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 5), st.sampled_from([1, 2, 255, 256, 70_000]), min_size=1), min_size=1, max_size=400))
def test_blocks_round_trip(docs):
    segment, m = segment_of(docs, len(docs))
    for k, t in enumerate(segment.terms.tolist()):
        blocks = np.arange(segment.begins[k], segment.begins[k + 1])
        places = segment.postings(blocks)
        want = [i for i, d in enumerate(docs) if t in d]
        assert segment.docs[places].tolist() == want
        assert segment.parts[places].tolist() == [(10**9 * docs[i][t]) // (1000 * docs[i][t] + 12 * int(m[i])) for i in want]
        for b in blocks.tolist():
            assert segment.maxima[b] == max(segment.parts[segment.postings(np.array([b]))])


def test_blocks_below_the_threshold_stay_compressed():
    # one document in each thousand holds the term many times: only their blocks can reach the threshold
    docs = [{0: 50 if i % 1000 == 7 else 1, 1: 1} for i in range(20_000)]
    segment, m = segment_of(docs, len(docs))
    best = lexical.Best(10)
    lexical.search_segment(segment, np.array([0, 1]), np.array([900, 1]), best)
    scores = [900 * ((10**9 * d[0]) // (1000 * d[0] + 12 * int(k))) + (10**9) // (1000 + 12 * int(k)) for d, k in zip(docs, m)]
    assert best.scores.tolist() == sorted(scores, reverse=True)[:10]
    assert best.ids.tolist() == sorted(range(len(docs)), key=lambda i: (-scores[i], i))[:10]
    assert segment.decoded < 0.5 * len(segment.sizes)
    known = segment.decoded
    lexical.search_segment(segment, np.array([1]), np.array([1]), lexical.Best(3, least=10**12))
    assert segment.decoded == known


def test_vocabulary_tells_lanes_apart():
    words = lexical.Vocabulary(np.array([5, 5, 5, 9], np.uint64), np.array([1, 4, 8, 2], np.uint64))
    asked = np.array([[5, 5, 5, 5, 9, 9, 1, 10], [1, 8, 4, 3, 2, 3, 1, 1]], np.uint64)
    assert words.numbers(asked).tolist() == [0, 2, 1, -1, 3, -1, -1, -1]

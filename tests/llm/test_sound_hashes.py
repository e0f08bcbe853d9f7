"""Words that defeat polynomial hashes (Thue-Morse words and their complements) are told apart by every operator on hashes."""

import numpy as np
import pyarrow as pa

from marketgrain.llm import decontaminate, neardups, substrings, textarrays


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


ONE, OTHER = thue_morse(4096), thue_morse(4096, "b", "a")


def test_word_hashes():
    words = [thue_morse(n, *p) for n in (8, 9, 16, 63, 64, 65, 128, 1024, 4096) for p in ("ab", "ba")] + ["a" * n for n in range(1, 130)]
    for wide in (False, True):
        hashes, offsets = textarrays.word_hashes(*textarrays.text_buffers(pa.array(words)), wide=wide)
        found = hashes if wide else hashes[None]
        assert all(len(set(lane.tolist())) == len(words) for lane in found) and offsets.tolist() == list(range(len(words) + 1))
    heads, sizes = textarrays.word_heads(*textarrays.text_buffers(pa.array(["Abc", "abcdefghij é"])), textarrays.SPACES, True)
    assert [h.tobytes()[: min(8, n)] for h, n in zip(heads, sizes)] == [b"abc", b"abcdefgh", "é".encode()]
    assert len(set(textarrays.head_hash(np.array([0x61, 0x6161], np.uint64), 1).tolist())) == 1


def texts(spark):
    same = " ".join(f"w{i}" for i in range(19))
    return spark.createDataFrame([(1, f"{same} {ONE}"), (2, f"{same} {OTHER}"), (3, f"{same} {ONE} tail")], "doc_id long, text string")


def test_substrings_keep_what_is_not_repeated(spark):
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(texts(spark)).collect()} == {1: 0, 2: 0, 3: 20}


def test_near_duplicates_of_five_words(spark):
    docs = spark.createDataFrame([(1, f"a b c d {ONE}"), (2, f"a b c d {OTHER}"), (3, ONE), (4, OTHER), (5, ONE)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardups.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_windows_of_the_benchmark(spark):
    same = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"{same} {ONE}"), (2, OTHER + " x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"y {same} {ONE} z"), (2, f"y {same} {OTHER} z"), (3, f"{ONE} x"), (4, f"{OTHER} x")], "doc_id long, text string")
    for most in (1_000_000, 0):
        got = decontaminate.decontaminate(docs, items, broadcast_windows=most).collect()
        assert {r.doc_id: (r.n_hit, r["items"]) for r in got} == {1: (13, ["1"]), 2: (0, []), 3: (0, []), 4: (2, ["2"])}

"""The pipeline, stage by stage, against plain programs over the smallest tables and over a fixture with planted rows."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marketgrain.llm import toxicity

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_toxic(spark, sf_dir, docs, model):
    """Rows that aren't toxic, each scored by loops over its words."""
    import pyarrow as pa

    from marketgrain.llm.textarrays import head_hash, text_buffers, word_hashes, word_heads

    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    kept = []
    for row in docs:
        words = sorted(set(ALNUM.findall(low(row[1]))))
        column = text_buffers(pa.array([" ".join(words)]))
        hashes, (heads, sizes), counts = word_hashes(*column)[0].tolist(), word_heads(*column), collections.Counter()
        counts.update(hashes)
        for n in toxicity.HEADS:
            counts.update(head_hash(heads[sizes > n], n).tolist())
        score = sum(weight.get(f, 0.0) * np.log2(1 + n) for f, n in counts.items())
        if score < model.thresholds[0]:
            kept.append(row)
    return kept


def plain_near_dedup(docs):
    sets = []
    for row in docs:
        w = SPACED.findall(low(row[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, first = collections.defaultdict(list), {}
    for i, row in enumerate(docs):
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for s in sets[i]:
            holders[s].append(i)
        if row[0] is not None and sets[i]:
            j = first.setdefault(row[0], i)
            root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_substrings(docs):
    """For tables whose doc_ids are unique or null."""
    seen, kept = set(), []
    for row in sorted((r for r in docs if r[0] is not None), key=lambda r: r[0]):
        places = [m.start() for m in SPACED.finditer(row[1] or "")] + [len(row[1] or "")]
        w, gone = SPACED.findall(row[1] or ""), set()
        for i in range(len(w) - 19):
            if (g := tuple(w[i : i + 20])) in seen:
                gone.update(range(i, i + 20))
            seen.add(g)
        text = (row[1] or "")[: places[0]] + "".join(row[1][places[i] : places[i + 1]] for i in range(len(w)) if i not in gone) if gone else row[1]
        kept.append((row[0], text or "", row[2], row[3], len(text or "")))
    return kept + [(r[0], r[1] or "", r[2], r[3], len(r[1] or "")) for r in docs if r[0] is None]


def plain_decontamination(docs, items):
    windows = set()
    for text in items:
        w = ALNUM.findall(low(text))
        k = min(13, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    kept = []
    for row in docs:
        w = ALNUM.findall(low(row[1]))
        hit = set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
        if not hit or 20 * len(hit) < len(w):
            kept.append(row)
    return kept


def check_packing(docs, pieces):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, sequences = collections.Counter(), collections.defaultdict(list)
    for row in docs:
        ids, at = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [2], 0
        stop = (len(ids) - 1) % 1024 + 1
        while at < len(ids):
            want[row[0], at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())] += 1
            at, stop = stop, stop + 1024
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces) == want
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def check_stages(spark, sf_dir, docs):
    """Runs each stage on what the one before returned and compares its rows with a plain program's."""
    rows = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]
    same = lambda got, want: sorted(got, key=repr) == sorted(want, key=repr)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, kept = rows(docs), {}
    for name, plain in (("toxicity", lambda d: plain_toxic(spark, sf_dir, d, model)), ("near_dedup", plain_near_dedup), ("substring_dedup", plain_substrings), ("decontamination", lambda d: plain_decontamination(d, items))):
        docs = corpus_pipeline.settled(spark, lambda name=name, docs=docs: stages[name](spark, docs, sf_dir), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        got = rows(docs)
        assert same(got, plain(before)), name
        before = kept[name] = got
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    check_packing(before, pieces)
    return kept, pieces


def test_stages_on_the_smallest_tables(spark, sf_dir):
    kept, pieces = check_stages(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


@pytest.fixture
def planted(spark, tmp_path):
    """Toxic rows, near and exact copies, a repeated passage, benchmark text, nulls, shared doc_ids, and columns of other names."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    passage, item, base = words(60), words(40), words(200)
    texts = [(i, words(80)) for i in range(40)]
    texts += [(100 + i, words(30) + " vile nasty " + words(30)) for i in range(12)] + [(None, "vile nasty " + words(20)), (3, "vile nasty " + words(20))]
    texts += [(200, base), (201, base.replace("w", "W", 3)), (202, base + " more"), (None, base), (203, base)]
    texts += [(300, words(50) + " " + passage), (301, words(50) + " " + passage + " " + words(10)), (302, passage), (303, passage + " " + words(90))]
    texts += [(400, words(30) + " " + item), (401, words(900) + " " + item), (None, item)]
    texts += [(500, None), (501, ""), (502, " \n"), (None, None)]
    texts += [(600, words(60_000)), (601, "x" * 300_000)]  # very long ones, one of them a single word
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, row string, toxic int")
    documents.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i in [*range(30), *range(100, 110)] if i != 3], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_planted_rows(spark, planted):
    kept, pieces = check_stages(spark, planted, spark.read.parquet(f"{planted}/documents.parquet"))
    ids = {name: [r[0] for r in rows] for name, rows in kept.items()}
    assert not [r for r in kept["toxicity"] if "vile" in (r[1] or "")] and ids["toxicity"].count(3) == 1  # the clean row under the id stays
    assert {200} == {i for i in ids["near_dedup"] if i in (200, 201, 202, 203)} and ids["near_dedup"].count(None) == 2  # a text of the benchmark, and null
    assert 400 not in ids["decontamination"] and 401 in ids["decontamination"] and ids["decontamination"].count(None) == 1
    # the long ones are judged whole, as check_stages tells, and lose nothing after the toxicity stage
    assert [[len(r[1]) for r in kept[name] if r[0] in (600, 601)] for name in kept] == [[len(r[1]) for r in kept["toxicity"] if r[0] in (600, 601)]] * 4
    assert {500, 501, 502} <= set(ids["decontamination"]) and {r.doc_id for r in pieces} >= {500, 501, 502, 300}


def test_empty_tables(spark, planted, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

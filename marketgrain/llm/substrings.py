"""Exact substring removal: words in a window of twenty that occurs earlier in the corpus.

The corpus is its own reference here, so reference automata would grow with it and every document would have to pass
every one of them; the README says why this operator joins windows instead. A document's anchors are the least hashes
of eight words within each window of twenty, so equal windows have equal anchors. Anchors that occur once rule out all
their windows; only windows of recurring anchors are compared, by 128-bit hashes of their twenty words, and all but the
earliest start of each are removed. For a reference of bounded size, see ``SuffixAutomaton`` and ``remove_reference``.

Hot passages: each batch sends an anchor, and a window, once, whatever number of its documents hold it, and settles
its own later starts itself. So one passage makes at most one row of each batch's hundred thousands, and no key is hot.
Copies of whole documents, which may be many, are joined with their first one over several tasks.

Nulls and edges: a null text has no words; texts shorter than a window keep all; a text whose words equal an earlier
document's loses all of them if it has a window; rows that share doc_id and text are the same document (neither is
earlier); rows that share a doc_id but not the text are ordered by a hash of it; rows without a doc_id neither lose
words nor count as earlier; long texts are read whole; an empty table gives no rows; further columns are ignored unless
named in ``carry``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.decontaminate import window_minima
from marketgrain.llm.shared import spread_join, written
from marketgrain.llm.textarrays import SPACES, bounded, grams, slices, text_buffers, word_hashes

WINDOW = 20
ANCHOR = 8
#: Anchors are least hashes among so many neighbours: together they span WINDOW words.
SPREAD = WINDOW - ANCHOR + 1
#: Up to so many identifiers are broadcast to select texts; beyond it they are joined.
BROADCAST_IDS = 500_000
_BATCH_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def numbered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, and tie: 0 if no doc_id is shared, else a hash of the text. doc_id and tie tell documents apart, and order them."""
    doc_id = F.col(id_column).cast("long").alias("doc_id")
    shared = not docs.select(doc_id).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.withColumns({"__id": doc_id, "__text": F.col(text_column), "__tie": F.xxhash64(text_column) if shared else F.lit(0).cast("long")})


def word_facts(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n_words, sha256 (of the words joined by one space)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, lambda b: b.column(2)):
            data, offsets = text_buffers(batch.column(2))
            raw, counts, digests = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = raw[a:b].split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "tie", "n_words", "sha256"])

    return docs.select("doc_id", "tie", "text").mapInArrow(read, "doc_id long, tie long, n_words long, sha256 binary")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    data, offsets = text_buffers(batch.column("text"))
    for i, j in slices(batch.num_rows, offsets, _BATCH_BYTES):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j


def _window_anchors(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of one text: its start, its text's number, its anchor."""
    eights, _ = grams(hashes, offsets, ANCHOR)
    n = max(0, len(hashes) - WINDOW + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(WINDOW, len(hashes) + 1) <= ends[:n])
    return starts, np.searchsorted(offsets, starts, "right") - 1, window_minima(eights, SPREAD)[starts]


def _anchor_places(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place whose eight words are the anchor of a window there: its text's number, its hash."""
    eights, _ = grams(hashes, offsets, ANCHOR)
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), eights[:0]
    minima = np.zeros(len(eights) + SPREAD - 1, np.uint64)
    starts, _, found = _window_anchors(hashes, offsets)
    minima[starts + SPREAD - 1] = found
    # windows over a place have its hash as their least, or a lesser one
    places = np.flatnonzero(window_minima(minima[: len(eights) + SPREAD - 1], SPREAD, np.maximum) == eights)
    places = places[eights[places] > 0]
    return np.searchsorted(offsets, places, "right") - 1, eights[places]


def _ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Each row's document by number, in their order; rows of one document share it."""
    order = np.lexsort((ties, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc_id, tie, role (0: sent for its batch; 1: sent and known to recur; 2: known to recur, not sent)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
            for data, offsets, i, j in _parts(batch):
                hashes, at = word_hashes(data, offsets, SPACES)
                text, anchor = _anchor_places(hashes, at)
                if not len(anchor):
                    continue
                own = _ranks(ids[i:j], ties[i:j])[text]
                order = np.lexsort((own, anchor))
                anchor, own, text = anchor[order], own[order], text[order]
                same = anchor[1:] == anchor[:-1]
                again = same & (own[1:] == own[:-1])
                first = np.concatenate([[True], ~same])
                group = np.cumsum(first) - 1
                many = np.bincount(group) > 1
                role = np.where(first, many[group].astype(np.int8), 2)
                keep = np.concatenate([[True], ~again])
                columns = [pa.array(anchor[keep].view(np.int64)), pa.array(ids[i:j][text[keep]]), pa.array(ties[i:j][text[keep]]), pa.array(role[keep].astype(np.int8))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "tie", "role"])

    return docs.select("doc_id", "tie", "text").mapInArrow(read, "anchor long, doc_id long, tie long, role byte")


def recurring(found: DataFrame) -> DataFrame:
    """Each document's recurring anchors: doc_id, tie, anchors."""
    sent = found.where("role < 2").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    known = sent.where("role = 1 or n > 1").drop("n").unionByName(found.where("role = 2"))
    return known.groupBy("doc_id", "tie").agg(F.collect_set("anchor").alias("anchors"))


_WINDOW_ROWS = "hash long, hash2 long, doc_id long, tie long, at int, n int"


def windows(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, tie, text, anchors. Rows of two kinds: a batch's earliest start of each window (its hashes, doc_id,
    tie, at: the word's number, n = 0), and spans that are copies within the batch (null hashes, n words)."""
    names = [c.split()[0] for c in _WINDOW_ROWS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_ties, recur = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy(), batch.column("anchors")
            for data, offsets, i, j in _parts(batch):
                hashes, at = word_hashes(data, offsets, SPACES, wide=True)
                starts, text, anchor = _window_anchors(hashes[0], at)
                edges = np.searchsorted(text, np.arange(j - i + 1))
                picked = [np.zeros(0, np.int64)]
                for k in range(j - i):
                    a, b = edges[k], edges[k + 1]
                    if a < b:
                        wanted = np.sort(recur[i + k].values.to_numpy().view(np.uint64))
                        place = np.minimum(np.searchsorted(wanted, anchor[a:b]), len(wanted) - 1)
                        picked.append(a + np.flatnonzero(wanted[place] == anchor[a:b]))
                picked = np.concatenate(picked)
                if not len(picked):
                    continue
                ids, ties = all_ids[i:j], all_ties[i:j]
                begin, text = starts[picked], text[picked]
                one, two = grams(hashes[0], at, WINDOW)[0][begin], grams(hashes[1], at, WINDOW, 1)[0][begin]
                own, place = _ranks(ids, ties)[text], begin - at[text]
                order = np.lexsort((place, own, two, one))
                one, two, own, place, text = one[order], two[order], own[order], place[order], text[order]
                first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                later = (own != own[head]) | (place != place[head])
                columns = [one[first].view(np.int64), two[first].view(np.int64), ids[text[first]], ties[text[first]], place[first].astype(np.int32), np.zeros(first.sum(), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                own, place, text = own[later], place[later], text[later]
                order = np.lexsort((place, own))
                own, place, text = own[order], place[order], text[order]
                cut = np.flatnonzero((own[1:] != own[:-1]) | (place[1:] - place[:-1] > WINDOW)) + 1
                if len(own):
                    a, b = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(own) - 1]])
                    columns = [ids[text[a]], ties[text[a]], place[a].astype(np.int32), (place[b] - place[a] + WINDOW).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), *map(pa.array, columns)], names)

    return docs.select("doc_id", "tie", "text", "anchors").mapInArrow(read, _WINDOW_ROWS)


def copied_spans(found: DataFrame) -> DataFrame:
    """Every document's spans that start earlier elsewhere: doc_id, tie, spans (array of at, n)."""
    here = F.struct("doc_id", "tie", "at")
    ranked = found.where("hash is not null").withColumn("first", F.min(here).over(Window.partitionBy("hash", "hash2")))
    later = ranked.where(F.col("first") != here).select("doc_id", "tie", "at", F.lit(WINDOW).alias("n"))
    marks = later.unionByName(found.where("hash is null").select("doc_id", "tie", "at", "n"))
    return marks.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _removed(spans: pa.Scalar, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    if spans.is_valid:
        at, length = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
        np.add.at(steps, at, 1)
        np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:n]) > 0


def _rest(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked; what stands between kept words stays."""
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    keep, at = [raw[: places[0]]] if len(gone) else [raw], 0
    for k in np.flatnonzero(~gone):
        keep.append(raw[places[k] : places[k + 1]])
    return b"".join(keep)


_RESULT = "doc_id long, tie long, n_words long, n_removed long, kept_sha256 string"


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of doc_id, tie, text, spans and more with their spans taken out."""
        for batch in bounded(batches, lambda b: b.column("text")):
            data, offsets = text_buffers(batch.column("text"))
            raw, counts, removed, digests, texts = data.tobytes(), [], [], [], []
            for i, spans in enumerate(batch.column("spans")):
                own = raw[offsets[i] : offsets[i + 1]]
                words = own.split()
                gone = _removed(spans, len(words))
                n = int(gone.sum())
                counts.append(len(words))
                removed.append(n)
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n else b" ".join(words)).hexdigest())
                if with_text:
                    texts.append((_rest(own, gone) if n else own).decode())
            columns = {"doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns |= {"kept_text": pa.array(texts, pa.string()), "carry": batch.column("carry")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut


def _holding(texts: DataFrame, info: DataFrame) -> DataFrame:
    """``texts`` joined with what is known of them; texts without are left where they are if their number allows it."""
    key = ["doc_id", "tie"]
    if info.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(info.select(*key)), key, "left_semi")
    return texts.join(info, key)


def remove_repeats(docs: DataFrame, with_text: bool = True, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and kept_text if asked for.

    A document that loses nothing keeps its text as it is; others keep what stands between their kept words. With texts,
    the columns named in ``carry`` come along; name none of the result's own.
    """
    key = ["doc_id", "tie"]
    marked = numbered(docs, id_column, text_column)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = marked.select(F.col("__id").alias("doc_id"), F.col("__tie").alias("tie"), F.col("__text").alias("text"), carried.alias("carry"))
    named = rows.where("doc_id is not null").select("doc_id", "tie", "text")
    facts = written(word_facts(rows), "facts")
    some = facts.where(f"n_words >= {WINDOW} and doc_id is not null").select(*key, "sha256").distinct()
    first = written(some.groupBy("sha256").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    dealt = spread_join(some, first.select("sha256", "first"), "sha256", "doc_id", counts=first, total=facts.count())
    copies = written(dealt.where(F.struct(*key) != F.col("first")).select(*key), "copies")
    # copies of whole documents are settled; their windows all start earlier
    info = written(recurring(written(anchors(named), "anchors")).join(copies, key, "left_anti"), "recurring")
    spans = written(copied_spans(written(windows(_holding(named, info)), "windows")), "spans")

    gone, copied = F.lit(hashlib.sha256(b"").hexdigest()), copies.withColumn("copy", F.lit(True))
    if not with_text:
        judged = facts.join(copied, key, "left").join(spans.select(*key, F.lit(True).alias("cut")), key, "left")
        whole = judged.where("cut is null").select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), gone).otherwise(F.lower(F.hex("sha256"))).alias("kept_sha256"))
        changed = _holding(named, spans).mapInArrow(_cut(False), _RESULT)
        return whole.unionByName(changed.select("doc_id", "n_words", "n_removed", "kept_sha256"))
    kind = rows.schema["carry"].dataType.simpleString()
    joined = rows.join(spans, key, "left").select(*key, "text", "spans", "carry").mapInArrow(_cut(True), f"{_RESULT}, kept_text string, carry {kind}")
    joined = joined.join(copied, key, "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("copy"), gone).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        *[F.col("carry")[c].alias(c) for c in carry],
    )


class SuffixAutomaton:
    """All substrings of sequences of words; ``None`` between sequences keeps them apart."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, q, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def matching_statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest run ending there that is a substring of a sequence."""
        state, length, found = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            found.append(length)
        return found


#: Words of a reference whose automata are broadcast; a larger one must be passed shard by shard.
REFERENCE_WORDS = 200_000


def remove_reference(docs: DataFrame, reference: DataFrame, least: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", reference_column: str = "text") -> DataFrame:
    """Remove from ``docs`` every span of ``least`` words or more that occurs in a reference of bounded size.

    The reference's words are counted first; one automaton is broadcast for each shard of REFERENCE_WORDS words, all
    of them together at most ten shards (otherwise a ValueError names the size). Returns doc_id, n_words, n_removed,
    kept_sha256, kept_text.
    """
    texts = reference.select(F.col(reference_column).alias("text")).where("text is not null")
    n = texts.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if n > 10 * REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words; automata are broadcast for {10 * REFERENCE_WORDS} at most")
    shards, size = [[]], 0
    for row in texts.toLocalIterator():
        words = row["text"].encode().split()
        if size and size + len(words) > REFERENCE_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    built: list[SuffixAutomaton] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.extend(SuffixAutomaton(s) for s in sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                words = raw.split()
                steps = np.zeros(len(words) + 1, np.int64)
                for automaton in built:
                    for i, length in enumerate(automaton.matching_statistics(words)):
                        if length >= least:
                            steps[i - length + 1] += 1
                            steps[i + 1] -= 1
                cut = np.cumsum(steps[: len(words)]) > 0
                kept = b" ".join(w for w, g in zip(words, cut.tolist()) if not g)
                rows.append((doc_id, len(words), int(cut.sum()), hashlib.sha256(kept).hexdigest(), (_rest(raw, cut) if cut.any() else raw).decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(read, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")

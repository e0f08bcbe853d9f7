"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Statistics come first: N, L and each term's df over all documents, from one reading of the texts, which leaves for every
document its length and its counts of the items' terms (``forward``). Then weights and the documents' length terms are known.

Index. Documents are dealt into segments of bounded documents and postings, a row of a table each. A segment's postings of
a term stand in blocks of BLOCK: gaps between documents and counts, in one, two or four bytes each as the block needs,
and uncompressed the block's first and last document and its maximum impact (the score's part that doesn't depend on the
term's weight). A term in every document so has postings in every segment, none of them long.

Search. Every task goes through its segments with all items and holds each item's best so far; their least score is the
item's threshold. A segment whose terms' maxima can't reach it is passed over. In others the blocks' ends cut the documents into ranges;
shallow moves find the block that each term has for each range, without decompressing, and the sum of their maxima
bounds the range. Ranges below the threshold are skipped; the others are taken best bound first, a few and then more at once, only
their blocks are decompressed, and what they give raises the threshold for the rest. Ranges equal to the threshold
are kept, for ties. Tasks return their best for each item, and the best of these are the result.

Items are broadcast in groups of bounded terms; more items take more passes. Terms are told apart by 128-bit hashes (see
``textarrays``). Scores are 64-bit integers.

Nulls and edges: a null text, or one without a term, is no document and ranks for nothing; rows that share a doc_id are documents of
their own; a null doc_id ranks after others of its score; each item row has its own ranking, also where item_ids are
shared or null; ties go to the smaller doc_id; fewer documents above 0 than k are all returned; texts of any length
are read whole; empty tables give no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.llm.shared import settled, written
from marketgrain.llm.textarrays import NOT_ALNUM, bounded, text_buffers, word_hashes

#: Postings in a block.
BLOCK = 128
#: A segment ends with so many documents, or postings.
SEGMENT_DOCS = 32_768
SEGMENT_POSTINGS = 2_000_000
#: Items are searched together while they have about so many different terms each counted once an item (32 bytes each).
GROUP_TERMS = 500_000
#: Segments that a task searches.
TASK_SEGMENTS = 2
#: Ranges taken at first; each further step takes four times as many.
FIRST_RANGES = 16
_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_buffers(column), NOT_ALNUM, lower=True, wide=True)


def item_terms(items: DataFrame) -> DataFrame:
    """``items``: item (its row), text. Returns item, hash, hash2, times: each item's different terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, lambda b: b.column(1)):
            (one, two), offsets = _terms(batch.column(1))
            item = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            order = np.lexsort((two, one, item))
            one, two, item = one[order], two[order], item[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(new)))
            yield pa.RecordBatch.from_arrays([pa.array(item[new]), pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(times.astype(np.int64))], ["item", "hash", "hash2", "times"])

    return items.select("item", "text").mapInArrow(cut, "item long, hash long, hash2 long, times long")


@dataclass
class Vocabulary:
    """The items' terms, numbered in the order of their hashes."""

    one: np.ndarray
    two: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for a word that no item has."""
        if not len(self.one):
            return np.full(hashes.shape[1], -1)
        at = np.minimum(np.searchsorted(self.one, hashes[0]), len(self.one) - 1)
        while True:  # past terms that share the first lane
            wrong = (self.one[at] == hashes[0]) & (self.two[at] < hashes[1]) & (at < len(self.one) - 1)
            wrong[wrong] = self.one[at[wrong] + 1] == hashes[0][wrong]
            if not wrong.any():
                break
            at = at + wrong
        return np.where((self.one[at] == hashes[0]) & (self.two[at] == hashes[1]), at, -1)


def forward(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs``: doc_id, text. Returns for each document with a term doc_id, n (terms), terms (int32 numbers of the vocabulary's that it
    has, ascending) and counts (int32)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in bounded(batches, lambda b: b.column(1)):
            hashes, offsets = _terms(batch.column(1))
            n, numbers = np.diff(offsets), known.numbers(hashes)
            text = np.repeat(np.arange(len(n)), n)
            hit = numbers >= 0
            pairs, counts = np.unique(text[hit] * max(len(known.one), 1) + numbers[hit], return_counts=True)
            text, terms = np.divmod(pairs, max(len(known.one), 1))
            ends = np.searchsorted(text, np.arange(len(n) + 1))
            terms, counts = terms.astype(np.int32), counts.astype(np.int32)
            some = np.flatnonzero(n > 0)
            cells = [pa.array([a[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()], pa.binary()) for a in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int64)), *cells], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents of ``forward`` hold each of ``size`` terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def length_terms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms each."""
    return 100 - 25 + (25 * n * n_docs) // n_terms


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + 12 * m)


def _narrowed(values: np.ndarray, block: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Values in the fewest bytes that each block needs: per block the width (0, 1, 2) and the place in its width's pool, and the pools."""
    most = np.zeros(n_blocks, np.int64)
    np.maximum.at(most, block, values)
    width = np.digitize(most, [1 << 8, 1 << 16]).astype(np.uint8)
    sizes = np.bincount(block, minlength=n_blocks)
    place, pools = np.zeros(n_blocks, np.int32), []
    for w, kind in enumerate(_WIDTHS):
        own = width == w
        place[own] = np.cumsum(sizes[own]) - sizes[own]
        pools.append(values[own[block]].astype(kind).tobytes())
    return width, place, pools


_ARRAYS = {
    "doc_ids": np.int64, "unnamed": np.bool_, "m": np.int64, "terms": np.int32, "begins": np.int32, "firsts": np.int32, "lasts": np.int32, "maxima": np.int64, "sizes": np.uint8,
    "gap_width": np.uint8, "gap_place": np.int32, "count_width": np.uint8, "count_place": np.int32, **{f"gaps{w}": k for w, k in enumerate(_WIDTHS)}, **{f"counts{w}": k for w, k in enumerate(_WIDTHS)},
}
SEGMENT_SCHEMA = ", ".join(f"{c} binary" for c in _ARRAYS)


def _segment(doc_ids: np.ndarray, unnamed: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> dict[str, bytes]:
    """Postings (doc: a number into doc_ids) as one segment."""
    order = np.lexsort((doc, term))
    doc, term, count = doc[order].astype(np.int64), term[order], count[order]
    terms, starts = np.unique(term, return_index=True)
    lengths = np.diff(np.append(starts, len(term)))
    within = np.arange(len(term)) - np.repeat(starts, lengths)
    opens = within % BLOCK == 0
    block = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    n_blocks = len(first)
    sizes = np.diff(np.append(first, len(term)))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = 0
    maxima = np.maximum.reduceat(impacts(count, m[doc]), first) if n_blocks else np.zeros(0, np.int64)
    begins = np.append(0, np.cumsum(-(-lengths // BLOCK)))
    gap_width, gap_place, gap_pools = _narrowed(gaps, block, n_blocks)
    count_width, count_place, count_pools = _narrowed(count.astype(np.int64), block, n_blocks)
    last = doc[first + sizes - 1] if n_blocks else doc
    found = {
        "doc_ids": doc_ids, "unnamed": unnamed, "m": m, "terms": terms, "begins": begins, "firsts": doc[first], "lasts": last, "maxima": maxima, "sizes": sizes,
        "gap_width": gap_width, "gap_place": gap_place, "count_width": count_width, "count_place": count_place,
    }
    cells = {c: np.asarray(v).astype(_ARRAYS[c]).tobytes() for c, v in found.items()}
    return cells | {f"gaps{w}": b for w, b in enumerate(gap_pools)} | {f"counts{w}": b for w, b in enumerate(count_pools)}


def segments(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The rows of ``forward`` as segments."""
    most_docs, most_postings = SEGMENT_DOCS, SEGMENT_POSTINGS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs = postings = 0

        def flush() -> pa.RecordBatch:
            ids, unnamed, n, terms, counts = (np.concatenate(c) for c in list(zip(*held))[:5])
            doc = np.repeat(np.arange(len(ids)), np.concatenate([h[5] for h in held]))
            made = _segment(ids, unnamed, length_terms(n, n_docs, n_terms), doc, terms, counts)
            return pa.RecordBatch.from_arrays([pa.array([made[c]], pa.binary()) for c in _ARRAYS], list(_ARRAYS))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0)
                cells = part.column(2).to_pylist()
                terms, counts = (np.frombuffer(b"".join(c), np.int32) for c in (cells, part.column(3).to_pylist()))
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), terms, counts, np.array([len(c) // 4 for c in cells])))
                docs, postings = docs + part.num_rows, postings + len(terms)
                if docs >= most_docs or postings >= most_postings:
                    yield flush()
                    held, docs, postings = [], 0, 0
        if held:
            yield flush()

    return rows.where(F.octet_length("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(build, SEGMENT_SCHEMA)


class Segment:
    """A segment's row, its blocks decompressed as they are asked for. ``decoded`` counts these."""

    def __init__(self, cells: dict[str, bytes]):
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(cells[name], kind))
        self.decoded = 0
        self.begun = np.cumsum(self.sizes.astype(np.int64)) - self.sizes
        total = int(self.sizes.sum(dtype=np.int64))
        self.docs, self.parts = np.zeros(total, np.int32), np.zeros(total, np.int64)
        self.ready = np.zeros(len(self.sizes), bool)
        self.greatest = np.maximum.reduceat(self.maxima, self.begins[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def _pooled(self, kind: str, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        width, place = getattr(self, f"{kind}_width")[blocks], getattr(self, f"{kind}_place")[blocks]
        each = np.repeat(np.arange(len(blocks)), lengths)
        at = place[each] + np.arange(len(each)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found, wide = np.zeros(len(each), np.int64), width[each]
        for w in range(len(_WIDTHS)):
            own = wide == w
            if own.any():
                found[own] = getattr(self, f"{kind}s{w}")[at[own]]
        return found

    def decode(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        self.decoded += len(blocks)
        self.ready[blocks] = True
        lengths = self.sizes[blocks].astype(np.int64)
        run = np.cumsum(self._pooled("gap", blocks, lengths))
        begin = np.cumsum(lengths) - lengths
        docs = run - np.repeat(run[begin], lengths) + np.repeat(self.firsts[blocks], lengths)
        to = np.repeat(self.begun[blocks] - begin, lengths) + np.arange(len(docs))
        self.docs[to] = docs
        self.parts[to] = impacts(self._pooled("count", blocks, lengths), self.m[docs])

    def postings(self, blocks: np.ndarray) -> np.ndarray:
        """Places of the blocks' postings in ``docs`` and ``parts``."""
        self.decode(blocks)
        lengths = self.sizes[blocks].astype(np.int64)
        return np.repeat(self.begun[blocks] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


@dataclass
class Best:
    """An item's k best documents so far; a document must score ``least`` to come among them."""

    k: int
    least: int = 1
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    unnamed: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def search_segment(segment: Segment, terms: np.ndarray, factors: np.ndarray, best: Best) -> None:
    """``terms``: an item's, ascending; ``factors``: their weights, times their occurrences in it."""
    at = np.minimum(np.searchsorted(segment.terms, terms), max(len(segment.terms) - 1, 0))
    here = (segment.terms[at] == terms) & (factors > 0) if len(segment.terms) else np.zeros(len(terms), bool)
    at, factors = at[here], factors[here]
    if not len(at) or int((segment.greatest[at] * factors).sum()) < best.least:
        return
    spans = [(int(segment.begins[t]), int(segment.begins[t + 1])) for t in at.tolist()]
    ends = np.unique(np.concatenate([segment.lasts[a:b] for a, b in spans]))
    bounds, moved = np.zeros(len(ends), np.int64), []
    for (a, b), factor in zip(spans, factors.tolist()):
        # a shallow move: the block that a range's end lies in, or -1
        block = a + np.searchsorted(segment.lasts[a:b], ends)
        inside = block < b
        inside[inside] = segment.firsts[block[inside]] <= ends[inside]
        block = np.where(inside, block, -1)
        bounds += np.where(inside, segment.maxima[block] * factor, 0)
        moved.append(block)
    order = np.argsort(-bounds, kind="stable")
    totals, take, done = np.zeros(len(segment.doc_ids), np.int64), FIRST_RANGES, 0
    taken = np.zeros(len(ends), bool)
    while done < len(order) and bounds[order[done]] >= best.least:
        ranges = order[done : done + take]
        ranges = ranges[bounds[ranges] >= best.least]
        taken[:] = False
        taken[ranges] = True
        for block, factor in zip(moved, factors.tolist()):
            wanted = block[ranges]
            places = segment.postings(np.unique(wanted[wanted >= 0]))
            docs = segment.docs[places]
            inside = taken[np.searchsorted(ends, docs)]
            totals[docs[inside]] += factor * segment.parts[places[inside]]
        docs = np.flatnonzero(totals >= best.least)
        best.add(totals[docs], segment.doc_ids[docs], segment.unnamed[docs])
        totals[docs] = 0
        done, take = done + len(ranges) if len(ranges) == take else len(order), take * 4


@dataclass
class Queries:
    """Items' terms: item i has those from begins[i] to begins[i + 1]."""

    items: np.ndarray
    begins: np.ndarray
    terms: np.ndarray
    factors: np.ndarray


def search(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """``index``: written segments. Returns item, rank, doc_id, score."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [Best(k) for _ in asked.items]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment({c: batch.column(i)[row].as_py() for i, c in enumerate(_ARRAYS)})
                for i, (a, b) in enumerate(zip(asked.begins[:-1].tolist(), asked.begins[1:].tolist())):
                    search_segment(segment, asked.terms[a:b], asked.factors[a:b], best[i])
        for at in range(0, len(best), 1024):
            part = best[at : at + 1024]
            ids, unnamed = np.concatenate([x.ids for x in part]), np.concatenate([x.unnamed for x in part])
            item = np.repeat(asked.items[at : at + 1024], [len(x.ids) for x in part])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=unnamed), pa.array(np.concatenate([x.scores for x in part]))], ["item", "doc_id", "score"])

    # segments are few compressed bytes, so files would put many of them, and so much work, into one task
    spread = index.select(*_ARRAYS).repartition(max(1, -(-index.count() // TASK_SEGMENTS)))
    found = spread.mapInArrow(run, "item long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _searched(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """One group of items, whose ``terms`` (see ``item_terms``) are few enough to broadcast."""
    asked = terms.orderBy("item").toArrow()
    one, two = (asked[c].to_numpy().view(np.uint64) for c in ("hash", "hash2"))
    distinct = np.unique(np.stack([one, two], axis=1), axis=0)
    vocabulary = Vocabulary(np.ascontiguousarray(distinct[:, 0]), np.ascontiguousarray(distinct[:, 1]))
    rows = written(forward(docs, vocabulary), "forward")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not len(distinct):
        return None
    weight = weights(document_frequencies(rows, len(distinct)), n_docs)
    numbers = vocabulary.numbers(np.stack([one, two]))
    item = asked["item"].to_numpy()
    order = np.lexsort((numbers, item))
    items, begins = np.unique(item, return_index=True)
    queries = Queries(items, np.append(begins, len(item)), numbers[order].astype(np.int32), (weight[numbers] * asked["times"].to_numpy())[order])
    return search(written(segments(rows, n_docs, n_terms), "segments"), queries, k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""

    def found() -> DataFrame:
        spark = docs.sparkSession
        chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text")), "items")
        terms = written(item_terms(numbered), "item-terms")
        groups = max(1, -(-terms.count() // GROUP_TERMS))
        parts = [_searched(chosen, terms.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) if groups > 1 else terms, k) for g in range(groups)]
        result = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
        for part in parts:
            result = result if part is None else result.unionByName(part)
        return result.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

    return settled(docs.sparkSession, found, "ranked")

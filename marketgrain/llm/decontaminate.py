"""Benchmark decontamination by winnowing.

Every text of thirteen words or more gives, for each window of nine consecutive five-word grams, the least gram hash
(the winnowing fingerprint). Two texts that share thirteen words in a row share nine grams in a row, so they share
that window's fingerprint: no shared span of a window's length is missed. A document's fingerprints are joined with
the benchmark's, and hits are extended: the thirteen-word windows around a hit are compared with the items' windows.
Items with fewer than thirteen words are one window of their own length and are compared at every place.

Windows are compared by 128 bits (see ``textarrays``), fingerprints, which only choose windows to compare, by 64.

The benchmark's windows are broadcast while their number and the bytes of their item ids are small (both are counted
first). A larger benchmark is joined by shuffles: each batch of documents sends a fingerprint, and then a window, once with
the rows that have it, so what meets under a common one is bounded by the number of batches.

Nulls and edges: a null text has no words; an item without words has no window and matches nothing; a document
without words has no hits and isn't contaminated; items that share an item_id count as one item, whose windows are those
of all of them, and so do items with a null id, which items_sha256 leaves out; repeated documents each count; texts of any length are read whole; further columns are ignored; without
items nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.shared import with_carry, written
from marketgrain.llm.textarrays import NOT_ALNUM, bounded, grams, text_buffers, text_of, word_hashes

WINDOW = 13
GRAM = 5
#: Fingerprint windows hold so many grams: together they span WINDOW words.
GRAMS = WINDOW - GRAM + 1
#: Benchmarks of up to so many windows are broadcast (at 24 bytes each) if their item ids have no more bytes than this.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_ID_BYTES = 32 << 20
#: A document is contaminated if its hit words times this number are its words at least.
SHARE = 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of two lanes, and offsets."""
    return word_hashes(*text_buffers(column), NOT_ALNUM, lower=True, wide=True)


def _pairs(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of every window's hash, and whether it lies in one text."""
    values, whole = grams(hashes[0], offsets, width)
    return values, grams(hashes[1], offsets, width, 1)[0], whole


def window_minima(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least of ``width`` consecutive values, for each place where there are so many; with np.maximum, the greatest."""
    if len(values) < width:
        return values[:0]
    best, span = values, 1
    while span * 2 <= width:  # doubling: over 2, 4, 8 ... values
        best, span = least(best[: len(best) - span], best[span:]), span * 2
    n = len(values) - width + 1
    return least(best[:n], best[width - span : width - span + n])


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The distinct winnowing fingerprints of one text's words."""
    return np.unique(window_minima(grams(hashes, np.array([0, len(hashes)]), GRAM)[0], GRAMS))


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of parallel arrays, sorted by the first, then the second ..."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in ordered], axis=0)
    return [c[new] for c in ordered]


def benchmark_windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Each item's distinct windows: item_id (string), width, hash, hash2."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = _words(batch.column(1))
            for i in range(batch.num_rows):
                own = hashes[:, offsets[i] : offsets[i + 1]]
                n = own.shape[1]
                if n == 0:
                    continue
                width = min(WINDOW, n)
                first, second, _ = _pairs(own, np.array([0, n]), width)
                first, second = _distinct(first, second)
                columns = [batch.column(0).take(pa.array(np.full(len(first), i))), pa.array(np.full(len(first), width, np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "width", "hash", "hash2"])

    return items.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).alias("text")).mapInArrow(cut, "item_id string, width int, hash long, hash2 long")


def benchmark_fingerprints(items: DataFrame, text_column: str = "text") -> DataFrame:
    """The distinct fingerprints of all items of WINDOW words or more: fingerprint."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = _words(batch.column(0))
            found = [fingerprints(hashes[0, offsets[i] : offsets[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["fingerprint"])

    return items.select(F.col(text_column).alias("text")).mapInArrow(cut, "fingerprint long").distinct()


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _window_prints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all WINDOW-word windows that lie in one text, and each one's fingerprint."""
    values, _ = grams(hashes[0], offsets, GRAM)
    n = hashes.shape[1]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(WINDOW, n + 1) <= ends[: max(0, n - WINDOW + 1)])
    return at, window_minima(values, GRAMS)[at]


def _covered(starts: np.ndarray, widths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the windows."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + widths, -1)
    return np.cumsum(steps[:n]) > 0


def _digest(items: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_starts array<int>, hit_ends array<int>"


def _rows(ids: pa.Array, n_words: np.ndarray, hit: np.ndarray, offsets: np.ndarray, items: dict[int, set[str | None]], carry: pa.Array) -> pa.RecordBatch:
    """One row a document from the hit flags of all words."""
    ends = np.concatenate([[0], np.cumsum(hit)])
    n_hit = ends[offsets[1:]] - ends[offsets[:-1]]
    empty = _digest(set())
    names, spans, stops = [], [], []
    for i in range(len(ids)):
        names.append(sorted(items.get(i, ()), key=lambda x: (x is None, x or "")))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[offsets[i] : offsets[i + 1]].view(np.int8), [0]]))) if n_hit[i] else np.zeros(0, np.int64)
        spans.append(edge[::2].astype(np.int32))
        stops.append(edge[1::2].astype(np.int32))
    columns = [
        ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
        pa.array([_digest(set(x)) if x else empty for x in names], pa.string()), pa.array((n_hit > 0) & (SHARE * n_hit >= n_words)),
        pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), carry,
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_starts", "hit_ends", "carry"])


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and hit spans in words.

    ``carry`` names columns of ``docs`` that come along with their own row, ``text`` among them if wanted; name none of the results.
    """
    windows = benchmark_windows(items, item_column, item_text_column)
    prints = benchmark_fingerprints(items, item_text_column)
    rows, texts = with_carry(docs, id_column, text_column, carry), lambda batch: text_of(batch, text_column, carry)
    n, id_bytes = windows.agg(F.count("*"), F.sum(F.octet_length("item_id"))).first()
    small = n <= broadcast_windows and (id_bytes or 0) <= BROADCAST_ID_BYTES
    found = _by_broadcast(rows, texts, windows, prints) if small else _by_shuffle(rows, texts, windows, prints)
    return found.select("*", *[F.col("carry")[c].alias(c) for c in carry]).drop("carry")


@dataclass
class _Windows:
    """Windows of one width, sorted: both hashes, and where each one's items stand in ``codes``."""

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    same: int

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray, codes: np.ndarray) -> _Windows:
        order = np.lexsort((second, first))
        first, second, codes = first[order], second[order], codes[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return cls(first[new], second[new], np.append(np.flatnonzero(new), len(order)), codes, int(np.unique(first[new], return_counts=True)[1].max()))

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Each pair's place, or -1."""
        at, found = np.searchsorted(self.first, first), np.full(len(first), -1)
        for k in range(self.same):
            place = np.minimum(at + k, len(self.first) - 1)
            found = np.where((self.first[place] == first) & (self.second[place] == second), place, found)
        return found


def _by_broadcast(rows: DataFrame, texts, windows: DataFrame, prints: DataFrame) -> DataFrame:
    """``windows`` has been counted: it and the fingerprints, no more than it, are small."""
    table = np.sort(prints.toArrow().column(0).to_numpy().view(np.uint64))
    every = windows.toArrow()
    coded = every.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    names, codes, width_of = coded.dictionary.to_pylist(), coded.indices.to_numpy(), every.column("width").to_numpy()
    lanes = [every.column(c).to_numpy().view(np.uint64) for c in ("hash", "hash2")]
    by_width = {int(w): _Windows.of(lanes[0][width_of == w], lanes[1][width_of == w], codes[width_of == w]) for w in np.unique(width_of)}
    sent = rows.sparkSession.sparkContext.broadcast((table, names, by_width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names, by_width = sent.value
        for batch in bounded(batches, texts):
            hashes, offsets = _words(texts(batch))
            starts, widths, items = [], [], {}
            for width, known in by_width.items():
                if width == WINDOW:
                    at, prints_at = _window_prints(hashes, offsets)
                    at = at[_is_in(prints_at, table)]
                else:
                    values, whole = grams(hashes[0], offsets, width)
                    at = np.flatnonzero(whole & _is_in(values, known.first))
                if not len(at):
                    continue
                first, second, _ = _pairs(hashes, offsets, width)
                place = known.find(first[at], second[at])
                at, place = at[place >= 0], place[place >= 0]
                starts.append(at)
                widths.append(np.full(len(at), width))
                doc = np.searchsorted(offsets, at, "right") - 1
                for d, k in zip(*(x.tolist() for x in _distinct(doc, place))):
                    items.setdefault(d, set()).update(names[c] for c in known.codes[known.starts[k] : known.starts[k + 1]])
            hit = _covered(np.concatenate([[], *starts]).astype(np.int64), np.concatenate([[], *widths]).astype(np.int64), hashes.shape[1])
            yield _rows(batch.column(0), np.diff(offsets), hit, offsets, items, batch.column(2))

    return rows.mapInArrow(mark, f"{SCHEMA}, carry {rows.schema['carry'].dataType.simpleString()}")


def _sent_once(rows: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """A batch's distinct keys, and for each the list of rows that have it."""
    *keys, rows = _distinct(*keys, rows)
    new = np.ones(len(rows), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    offsets = np.append(np.flatnonzero(new), len(rows)).astype(np.int32)
    return [k[new] for k in keys], pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows))


def _by_shuffle(rows: DataFrame, texts, windows: DataFrame, prints: DataFrame) -> DataFrame:
    """For a benchmark of any size: fingerprints, then the windows around hits, meet the benchmark's in shuffle joins."""
    short = sorted(r[0] for r in windows.where(F.col("width") < WINDOW).select("width").distinct().collect())  # twelve at most
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "documents")

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, texts):
            hashes, offsets = _words(texts(batch))
            at, values = _window_prints(hashes, offsets)
            own = batch.column(0).to_numpy()[np.searchsorted(offsets, at, "right") - 1]
            (values,), lists = _sent_once(own, values)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), lists], ["fingerprint", "rows"])

    # a window whose least gram is one of the benchmark's fingerprints may be an item's
    sent = rows.select("row", "text", "carry").mapInArrow(fingerprinted, "fingerprint long, rows array<long>")
    near = sent.join(prints, "fingerprint", "left_semi").select(F.explode("rows").alias("row"), "fingerprint")
    marked = near.groupBy("row").agg(F.collect_set("fingerprint").alias("fingerprints"))

    def keyed(short_ones: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, texts):
                hashes, offsets = _words(texts(batch))
                for width in short if short_ones else [WINDOW]:
                    first, second, whole = _pairs(hashes, offsets, width)
                    if short_ones:
                        at = np.flatnonzero(whole)
                    else:
                        at, values = _window_prints(hashes, offsets)
                        wanted = np.unique(batch.column("fingerprints").flatten().to_numpy().view(np.uint64))
                        at = at[_is_in(values, wanted)]
                    own = batch.column(0).to_numpy()[np.searchsorted(offsets, at, "right") - 1]
                    (first, second), lists = _sent_once(own, first[at], second[at])
                    columns = [pa.array(np.full(len(first), width, np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["width", "hash", "hash2", "rows"])

        return cut

    schema = "width int, hash long, hash2 long, rows array<long>"
    tried = rows.join(marked, "row").select("row", "text", "fingerprints", "carry").mapInArrow(keyed(False), schema)
    if short:
        tried = tried.unionByName(rows.select("row", "text", "carry").mapInArrow(keyed(True), schema))
    key = ["width", "hash", "hash2"]
    named = windows.groupBy(*key).agg(F.collect_set(F.struct("item_id")).alias("names"))
    hits = tried.join(named, key).select(F.explode("rows").alias("row"), F.struct(*key).alias("window"), "names")
    found = hits.groupBy("row").agg(F.collect_set("window").alias("windows"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, texts):
            hashes, offsets = _words(texts(batch))
            starts, widths, items = [], [], {}
            for i, (own, names) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if not own:
                    continue
                items[i] = {x["item_id"] for x in names}
                text = hashes[:, offsets[i] : offsets[i + 1]]
                wanted: dict[int, list[tuple[int, int]]] = {}
                for w in own:
                    wanted.setdefault(w["width"], []).append((w["hash"], w["hash2"]))
                for width, pairs in wanted.items():
                    first, second, _ = _pairs(text, np.array([0, text.shape[1]]), width)
                    lanes = np.array(pairs, np.int64).view(np.uint64)
                    known = _Windows.of(lanes[:, 0], lanes[:, 1], np.zeros(len(lanes), np.int64))
                    at = np.flatnonzero(known.find(first, second) >= 0)
                    starts.append(at + offsets[i])
                    widths.append(np.full(len(at), width))
            hit = _covered(np.concatenate([[], *starts]).astype(np.int64), np.concatenate([[], *widths]).astype(np.int64), hashes.shape[1])
            yield _rows(batch.column(0), np.diff(offsets), hit, offsets, items, batch.column(4))

    joined = rows.join(found, "row", "left").select("doc_id", "text", "windows", "names", "carry")
    return joined.mapInArrow(mark, f"{SCHEMA}, carry {rows.schema['carry'].dataType.simpleString()}")

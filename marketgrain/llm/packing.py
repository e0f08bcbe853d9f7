"""Best-fit packing of tokenised documents into sequences, mended by a swap-based local search.

Documents are tokenised once; only lengths travel afterwards. Pieces are dealt evenly to tasks of bounded size, each
packs its own best-fit decreasing and then searches: items of its emptiest bins ("donors") are moved into other
underfull bins, exchanged one-for-one or two-for-one with smaller items there. Every step takes tokens from a less
filled bin to a fuller one, so the sum of squared fills grows until donors are empty. Bins that stay underfull
meet those of other tasks in further rounds, until one task holds what is left.

Nulls and edges: a null text is empty and yields its end token alone; a null doc_id is an id like any other; repeated rows
are packed as often as they occur; texts of any length are tokenised whole and cut; which of pieces of one length goes
into a sequence isn't defined, sequences and places are whole and gapless all the same; an empty table yields no rows;
columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.encode import encode
from marketgrain.llm.shared import written

#: Pieces that one task packs.
TASK_PIECES = 50_000
#: A bin this full (a share of the capacity) isn't opened again in a later round.
FULL_ENOUGH = 0.998
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids and its end token, cut into pieces of ``capacity`` ids of which the first may be shorter.

    Returns doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), and ids if asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = encode(batch.column(1), tokenizer_path)
            keys = batch.column(0)
            which, out = [], defaultdict(list)
            for i in range(batch.num_rows):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                at, stop = 0, (len(own) - 1) % capacity + 1
                while at < len(own):
                    which.append(i)
                    out["piece"].append((at + capacity - 1) // capacity)
                    out["start"].append(at)
                    out["length"].append(stop - at)
                    out["ids_crc32"].append(zlib.crc32(own[at:stop].tobytes()))
                    if with_ids:
                        out["ids"].append(own[at:stop].astype(np.int32))
                    at, stop = stop, stop + capacity
            columns = [keys.take(pa.array(which, pa.int64())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


class _Pool:
    """Items of the donor bins by length; masks tell which lengths, and which pairs of lengths, are there."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.mask, self.mirror = capacity, defaultdict(list), 0, 0

    def add(self, length: int, item: int) -> None:
        self.by_length[length].append(item)
        self.mask |= 1 << length
        self.mirror |= 1 << (self.capacity - length)

    def take(self, length: int) -> int:
        items = self.by_length[length]
        item = items.pop()
        if not items:
            self.mask &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))
        return item

    def longest(self, most: int) -> int:
        """The greatest length of at most ``most``; 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths that add up to ``total``."""
        both = self.mask & (self.mirror >> (self.capacity - total))
        while both:
            a = (both & -both).bit_length() - 1
            b = total - a
            if a != b or len(self.by_length[a]) > 1:
                return a, b
            both &= both - 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                mask &= ~(1 << gap)
            bins[b].append(item)
        else:
            gap, b = capacity, len(bins)
            bins.append([item])
        if gap > n:
            by_gap[gap - n].append(b)
            mask |= 1 << (gap - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int = 8) -> list[list[int]]:
    """Empty the least filled bins by moves and by one-for-one and two-for-one exchanges with other underfull bins."""
    for _ in range(rounds):
        fill = [sum(lengths[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
        spare = sum(capacity - fill[b] for b in under)
        n_donors = min(len(under) - 1, spare // capacity + 1)
        if spare < capacity or n_donors < 1:
            break
        donors, changed = under[:n_donors], False
        pool = _Pool(capacity)
        for d in donors:
            for i in bins[d]:
                pool.add(lengths[i], i)
        for b in reversed(under[n_donors:]):
            while (gap := capacity - fill[b]) > 0:
                best: tuple[int, int, tuple[int, ...]] | None = None
                for place, y in enumerate([0, *(lengths[i] for i in bins[b])]):
                    total = y + gap
                    if pool.mask >> total & 1:
                        got = (total,)
                    elif (two := pool.pair(total)) is not None:
                        got = two
                    else:
                        got = (pool.longest(total),)
                    if sum(got) > y and (best is None or sum(got) - y > best[0]):
                        best = (sum(got) - y, place, got)
                    if best and best[0] == gap:
                        break
                if best is None:
                    break
                gain, place, got = best
                if place:
                    back = bins[b].pop(place - 1)
                    pool.add(lengths[back], back)
                bins[b] += [pool.take(n) for n in got]
                fill[b] += gain
                changed = True
        left = [i for items in pool.by_length.values() for i in items]
        repacked = best_fit([lengths[i] for i in left], capacity)
        dropped = set(donors)
        before = len(bins)
        bins = [b for k, b in enumerate(bins) if k not in dropped] + [[left[i] for i in b] for b in repacked]
        if not changed or len(bins) >= before:
            break
    return bins


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; none holds more than ``capacity``."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_task(capacity: int, round_no: int, last: bool):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        lengths = rows["length"].tolist()
        sequence, offset, final = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        base = (round_no << 54) | (TaskContext.get().partitionId() << 28)
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
            final[items] = last or at >= FULL_ENOUGH * capacity
        yield rows.assign(sequence_id=sequence, offset=offset, final=final)

    return pack


def pack(pieces: DataFrame, capacity: int = 1024, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens (column ``length``), in as few sequences as found."""
    pieces = pieces.drop("sequence_id", "offset", "final")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, final boolean"
    done: list[DataFrame] = []
    open_pieces, n, round_no = pieces, pieces.count(), 0
    while True:
        n_tasks = max(1, -(-n // task_pieces))
        packed = written(open_pieces.repartition(n_tasks).mapInPandas(_pack_task(capacity, round_no, n_tasks == 1), schema), "packed")
        done.append(packed.where("final"))
        if n_tasks == 1:
            break
        open_pieces, before = packed.where("not final").drop("sequence_id", "offset", "final"), n
        n, round_no = open_pieces.count(), round_no + 1
        if n == 0:
            break
        if n > 0.9 * before:  # no better by meeting others: take the bins as they are
            done.append(packed.where("not final"))
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("final")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents; with ``with_ids`` each row also carries its piece's token ids."""
    return pack(written(tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_column, text_column), "pieces"), capacity)

"""Words and word hashes of whole Arrow text columns, by array arithmetic.

A word hash has one or two lanes of 64 bits. Words of up to 64 bytes are read eight bytes at a time, and each eight go
through a bijective, non-linear mixing of the lane's state, so words of one length that differ in eight bytes only never
share a hash, and no pattern of bytes cancels; longer words are hashed by XXH3. Two other words share a lane with a
probability near 2**-64, and both lanes with one near 2**-128. A window's hash is a sum of its words' hashes times odd
seeds, lane by lane: the same holds for windows, with 2**-62 and 2**-124.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes between words: the white space of ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes between words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, once A-Z are lower case.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Bytes of text hashed at once: what a processor's cache holds.
_BLOCK = 1 << 18
#: Words of more bytes are hashed one by one.
_LONG = 64
U = np.uint64


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the texts' offsets (one more than texts, from 0); null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_of(batch: pa.RecordBatch, text_column: str, carry: tuple[str, ...]) -> pa.Array:
    """The texts of rows whose ``text`` is left empty where the column comes along in ``carry``, so that it travels once."""
    return batch.column("carry").field(text_column) if text_column in carry else batch.column("text")


def bounded(batches: Iterator[pa.RecordBatch], texts, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``most`` bytes of text (one row at least), so that arrays over their words stay small.
    ``texts`` gives a batch's text column."""
    for batch in batches:
        _, offsets = text_buffers(texts(batch))
        for i, j in slices(batch.num_rows, offsets, most):
            yield batch.slice(i, j - i)


@lru_cache(8)
def _tables(separators: bytes, lower: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """For each byte what it counts as (None: itself), and whether it separates."""
    counts_as = np.arange(256, dtype=np.uint8)
    if lower:
        counts_as[65:91] = counts_as[97:123]
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    return counts_as if lower else None, apart[counts_as]


#: Masks of the first 0..8 bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LANES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over all 64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int) -> np.ndarray:
    """The hash of every word in ``data``, in rows of 64 bits."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    found = np.empty((lanes, len(starts)), np.uint64)
    for k in range(lanes):
        found[k] = mix(lengths.astype(np.uint64) * _LANES[k])
    some = slice(None)
    for at in range(0, _LONG, 8):
        if at:
            some = np.flatnonzero((lengths > at) & (lengths <= _LONG))
            if not len(some):
                break
        value = eights[starts[some] + at] & _FIRST[np.minimum(lengths[some] - at, 8)]
        for k in range(lanes):
            found[k, some] = mix((found[k, some] ^ value) * _LANES[k])
    for i in np.flatnonzero(lengths > _LONG):
        found[:, i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : starts[i] + lengths[i]].tobytes()), np.uint64)[:lanes]
    return found


def _words(data: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts as bytes, with their words' starts and lengths; fills in how many words each text has."""
    counts_as, apart = _tables(separators, lower)
    for i, j in slices(len(offsets) - 1, offsets, _BLOCK):
        block = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        if not len(block):
            continue
        inside = ~apart[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = at[:-1][at[:-1] < len(block)]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        counts[i + 1 : j + 1] = np.diff(np.searchsorted(starts, at))
        if len(starts):
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            edges = at[1:][at[1:] > 0] - 1
            last[edges] = inside[edges]
            yield block if counts_as is None else counts_as[block], starts, np.flatnonzero(last) + 1 - starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, lower: bool = False, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the offsets of each text's words in that array; with ``wide`` two rows of 64 bits each."""
    counts = np.zeros(len(offsets), np.int64)
    found = np.concatenate([np.zeros((1 + wide, 0), np.uint64), *(_hashed(*w, 1 + wide) for w in _words(data, offsets, separators, lower, counts))], axis=1)
    return found if wide else found[0], np.cumsum(counts)


def word_heads(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of every word as a number (zeros after its end), and its length in bytes."""
    heads, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block, starts, lengths in _words(data, offsets, separators, lower, np.zeros(len(offsets), np.int64)):
        eights = np.ndarray(len(block) + 1, "<u8", np.concatenate([block, np.zeros(8, np.uint8)]), strides=(1,))
        heads.append(eights[starts] & _FIRST[np.minimum(lengths, 8)])
        sizes.append(lengths)
    return np.concatenate(heads), np.concatenate(sizes)


def head_hash(heads: np.ndarray, n: int) -> np.ndarray:
    """A hash of words' first n bytes, eight at most, no word's own."""
    return mix(((heads & _FIRST[n]) ^ U(n)) * _LANES[1])


@lru_cache(128)
def _seeds(k: int, lane: int) -> np.ndarray:
    return np.random.default_rng(1000 + k + (lane << 20)).integers(1, 2**64 - 1, k, dtype=np.uint64) | U(1)


def grams(hashes: np.ndarray, offsets: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of k words from each word on, and whether those k words lie in one text. ``hashes``: one row; further
    rows of wide hashes take a ``lane`` of their own."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    seeds = _seeds(k, lane)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * seeds[j]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return mix(total), np.arange(k, n + 1) <= ends[: n - k + 1]


def sequence_hash(hashes: np.ndarray) -> int:
    """The hash of a whole sequence of any length; one of k words equals what grams() gives for k."""
    return int(mix(np.array([(hashes * _seeds(len(hashes), 0)).sum(dtype=np.uint64)], np.uint64))[0])


def slices(n: int, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes together, one text at least."""
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j

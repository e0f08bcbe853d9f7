"""Token ids of whole text columns through the tokenizers library, each distinct piece of text encoded once.

Both tokenizers used here never form a token across the step from a non-space character to a space, nor from an
ASCII letter to ASCII punctuation, so a text's ids are those of its pieces in a row. A batch's distinct pieces go
through the library; a worker process keeps the ids of the pieces it met last, in a cache of bounded size. Texts of a
tokenizer whose file isn't of one of these two kinds are encoded whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marketgrain.llm.textarrays import SPACES, slices, text_buffers

#: Pieces in each of the cache's two halves; when the newer is full it becomes the older, whose rest is dropped.
CACHE_PIECES = 400_000
#: Bytes of text encoded at once.
BATCH_BYTES = 8 << 20
#: Texts with these are encoded whole: white space beyond ASCII joins a piece's spaces, and special tokens may be spelt out.
_WHOLE = "[\u0085   -     　\x1c-\x1f]|<\\|"
#: Letters below this code point are precomposed and stable, so a piece of them is one word for the model.
_LATIN = "ɐ"


#: Normalizer and pre-tokenizer of the two kinds whose pieces may be encoded apart.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SAFE = [
    (None, _BYTE_LEVEL),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _LETTER_RUNS}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
    ),
]


def in_pieces(spec: dict) -> bool:
    """Whether a tokenizer file is of a kind whose texts may be encoded piece by piece."""
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and model.get("continuing_subword_prefix") is None
    return plain and (spec.get("normalizer"), spec.get("pre_tokenizer")) in _SAFE and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))


class PieceEncoder:
    """The ids of distinct pieces, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.word_ends, self.in_pieces = bool(spec["model"].get("end_of_word_suffix")), in_pieces(spec)
        # byte-level alphabets show printable bytes as themselves and the rest from code point 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)}
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _one_word(self, piece: str) -> str | None:
        """The model's word if the piece is one word of Latin letters, else None."""
        body = piece.strip(" \t\n\x0b\x0c\r") if self.word_ends else piece[1:] if piece[0] == " " else piece
        if not body.isalpha():
            return None
        lead = "" if self.word_ends or len(body) == len(piece) else self.alphabet[32]
        if self.word_ends:
            body = body.lower()
        if body.isascii():
            return lead + body
        return lead + "".join(map(self.alphabet.__getitem__, body.encode())) if max(body) < _LATIN else None

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        found, missing = [], []
        newer, older = self.newer, self.older
        for i, piece in enumerate(pieces):
            if (ids := newer.get(piece)) is None:
                if (ids := older.get(piece)) is None:
                    missing.append(i)
                else:
                    newer[piece] = ids
            found.append(ids)
        hard = []
        for i in missing:
            word = self._one_word(pieces[i].decode())
            if word is None:
                hard.append(i)
            else:
                newer[pieces[i]] = found[i] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        for k in range(0, len(hard), 4096):
            part = hard[k : k + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in part], add_special_tokens=False)):
                newer[pieces[i]] = found[i] = array("I", e.ids).tobytes()
        if len(newer) > CACHE_PIECES:
            self.newer, self.older = {}, newer
        return found


@lru_cache(4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Each byte's kind: 1 space, 2 ASCII letter, 3 ASCII punctuation, 0 other."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(SPACES)] = 1
    kinds[65:91] = kinds[97:123] = 2
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        kinds[a:b] = 3
    return kinds


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of spaces and after each ASCII letter that punctuation follows; each text's piece offsets."""
    kind = _kinds()[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        first[1:] = (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 3) & (kind[:-1] == 2)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(starts, offsets)


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row (unsigned 32 bit), and each text's offsets in them. Null texts have none."""
    data, offsets = text_buffers(column)
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for i, j in slices(len(offsets) - 1, offsets, BATCH_BYTES):
        got, n = _encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path)
        ids.append(got)
        counts.append(n)
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


def _encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    encoder = piece_encoder(path)
    if not encoder.in_pieces:
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        whole_ids = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.array(i, np.uint32) for i in whole_ids]), np.array([len(i) for i in whole_ids], np.int64)
    pieces, at = cut_pieces(data, offsets)
    coded = pieces.dictionary_encode()
    table = encoder.encode(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    heads = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(table), np.uint32)
    which = coded.indices.to_numpy(zero_copy_only=False)
    n_each = lengths[which]
    ends = np.concatenate([[0], np.cumsum(n_each)])
    ids = flat[np.repeat((heads[which] - ends[:-1]).astype(np.int32), n_each) + np.arange(ends[-1], dtype=np.int32)]
    starts = ends[at]
    counts = np.diff(starts)
    text = pa.Array.from_buffers(
        pa.large_string(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    whole = np.flatnonzero(pc.match_substring_regex(text, _WHOLE).to_numpy(zero_copy_only=False))
    if len(whole):
        parts, last = [], 0
        for t in whole:
            own = encoder.tokenizer.encode(text[int(t)].as_py(), add_special_tokens=False).ids
            parts += [ids[last : starts[t]], np.array(own, np.uint32)]
            last, counts[t] = starts[t + 1], len(own)
        ids = np.concatenate([*parts, ids[last:]])
    return ids, counts

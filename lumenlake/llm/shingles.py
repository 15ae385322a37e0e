"""Word shingles of texts, hashed over the bytes of an Arrow column without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes.
RUN_BYTES = 1 << 20

_U = np.uint64
# A byte of a word, A-Z lower-cased; 0: no part of a word. Bytes from 0x80 on belong to letters of UTF-8.
_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[0x30:0x3A] = range(0x30, 0x3A)
_WORD_BYTE[0x61:0x7B] = range(0x61, 0x7B)
_WORD_BYTE[0x41:0x5B] = range(0x61, 0x7B)
_WORD_BYTE[0x80:] = range(0x80, 0x100)

with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
    _MIXERS = np.multiply.accumulate(np.full(64, 0xD1B54A32D192ED03, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x may be overwritten."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; a null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the number of its text."""
    c = _WORD_BYTE[data]
    word = c != 0
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    place = np.arange(len(data), dtype=np.int32)
    begin = np.where(first, place, 0)
    place -= np.maximum.accumulate(begin)
    with np.errstate(over="ignore"):
        values = _POWERS[place & 0xFFFF]
        values *= c
        hashes = mix(np.add.reduceat(values, starts))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k words and the number of its text, in order; a text of fewer words, but not none, is one."""
    h, text = word_hashes(data, offsets)
    n = len(h)
    if not n:
        return h, text
    whole = np.flatnonzero(text[: n - k + 1] == text[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(whole), np.uint64)
        for j in range(k):
            s += h[whole + j] * _MIXERS[j]
        counts = np.bincount(text, minlength=len(offsets) - 1)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if not len(short):
            return mix(s), text[whole]
        begin = np.cumsum(counts) - counts
        few = np.asarray([(h[begin[d] : begin[d] + counts[d]] * _MIXERS[: counts[d]]).sum() + _U(counts[d]) for d in short], np.uint64)
    all_s, all_t = np.concatenate([mix(s), mix(few)]), np.concatenate([text[whole], short])
    order = np.argsort(all_t, kind="stable")
    return all_s[order], all_t[order]


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each text: hash, text, number of times."""
    if not len(hashes):
        return hashes, text, np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if text[-1] < 65536 else np.int64), kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))

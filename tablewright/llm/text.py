"""Splitting and hashing the words of whole Arrow batches without making Python strings.

A word is a run of bytes that are not ASCII white space; UTF-8 continuation bytes are
never white space, so splitting bytes and splitting characters agree.  A word's hash is a
polynomial over random byte values modulo 2**64, passed through a 64-bit finaliser; prefix
sums give every hash of a buffer at once.  Long documents are cut at white space into
pieces, so working memory does not grow with the length of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
PIECE_BYTES = 1 << 20
_BASE, _BASE_INV = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


_EXACT = mix(np.arange(1, 257, dtype=_U) * _BASE)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int, inverse: int):
        self.base, self.inverse, self.up, self.down = _U(base), _U(inverse), None, None

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            size = max(n, 1 << 16)
            out = []
            for factor in (self.base, self.inverse):
                a = np.full(size, factor, _U)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_BYTES = _Powers(int(_BASE), int(_BASE_INV))
_WORDS = [_Powers(b, pow(b, -1, 1 << 64)) for b in (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, row after the last, byte from, byte to): rows of up to PIECE_BYTES together, or a part of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if j > i + 1 or hi - lo <= PIECE_BYTES:
            yield i, j, lo, hi
        else:
            while lo < hi:
                to = min(hi, lo + PIECE_BYTES)
                while to < hi:  # cut only where white space follows an ASCII character that is none
                    part = data[to - 1 : min(hi, to + PIECE_BYTES)]
                    cut = np.flatnonzero(_SPACES[part[1:]] & ~_SPACES[part[:-1]] & (part[:-1] < 128))
                    if len(cut):
                        to += int(cut[0])
                        break
                    to = min(hi, to + PIECE_BYTES)
                yield i, j, lo, to
                lo = to
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, between: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions, from lo, where the words in data[lo:hi] start and end; a row's start ends a word."""
    blank = between[data[lo:hi]]
    n = hi - lo
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
    edge[cuts] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:] | edge[1:-1]
    return np.flatnonzero(~blank & (before | edge[:-1])), np.flatnonzero(~blank & after) + 1


def word_hashes(column: pa.Array, lower: bool, between: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in order, and the offsets of its rows among them.

    lower: A to Z count as a to z.  between: the byte values that are not of words; it
    must hold the white space, at which long texts are cut.
    """
    data, offsets = raw(column)
    table = _LOWER if lower else _EXACT
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    out = []
    for i, j, lo, hi in pieces(data, offsets):
        starts, ends = word_spans(data, offsets, lo, hi, between)
        if not len(starts):
            continue
        up, down = _BYTES.upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        if j == i + 1:
            counts[i] += len(starts)
        else:
            counts[i:j] += np.diff(np.searchsorted(starts + lo, offsets[i : j + 1]))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(counts)])


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of words[i:i+length] for every i; which: one of two independent functions."""
    n = len(words)
    if n < length:
        return np.zeros(0, _U)
    block, out = 1 << 20, np.empty(n - length + 1, _U)
    for a in range(0, len(out), block):
        part = words[a : a + block + length - 1]
        up, down = _WORDS[which].upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - length + 1
        out[a : a + k] = mix((sums[length:] - sums[:k]) * down[:k] + _U(which))
    return out


def whole_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence."""
    return int(window_hashes(words, len(words))[0]) if len(words) else 0


def parts(batches, column: int | str, most: int = 8 << 20):
    """The batches' rows in slices of about so many bytes of text, so that work on a slice has bounded memory."""
    for batch in batches:
        _, offsets = raw(batch.column(column))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a)
            a = b


def list_column(values: np.ndarray, lengths, kind) -> pa.Array:
    """A list column from concatenated values and the rows' lengths."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

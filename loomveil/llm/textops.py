"""Vectorised words, hashes and shingles over Arrow string columns.

Every function works on whole texts.  A column is cut into blocks of documents of about
``BLOCK_BYTES`` so that the numpy scratch space stays small however large an Arrow batch is; a
single text above that size forms a block of its own and is hashed piece by piece.

Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 500_000
PIECE_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_ONE = np.uint64(1)


def _byte_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
SPACE_WORDS = _byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters, digits and anything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = _byte_table(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = _ONE
        _powers.clear()
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


@dataclass
class Words:
    """Words of a block of documents, in order."""

    data: np.ndarray  #: bytes of all texts of the block
    bounds: np.ndarray  #: byte bounds of the documents, one more than documents
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    ptr: np.ndarray  #: word bounds of the documents, one more than documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            first = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, first + PIECE_BYTES, side="right")))
            last = int(self.ends[to - 1])
            up, down = _power_tables(last - first + 1)
            total = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum((self.data[first:last].astype(np.uint64) + _ONE) * up[: last - first], out=total[1:])
            s, e = self.starts[at:to] - first, self.ends[at:to] - first
            out[at:to] = mix((total[e] - total[s]) * down[s])
            at = to
        return out

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def strings(column) -> pa.Array:
    """One Arrow array with 64-bit offsets, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The value bytes and the offsets of strings(column), without a copy."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def blocks(column, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, byte bounds) of consecutive blocks of a column."""
    column = strings(column)
    data, offsets = raw(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        to = min(to, n)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, data[lo:hi], offsets[at : to + 1] - lo
        at = to


def split_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | cut))
    ends = np.flatnonzero(before & (~here | cut))
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds, side="left"))


def word_blocks(column, table: np.ndarray, lower: bool, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, bounds in blocks(column, block_bytes):
        yield at, to, split_words(data, bounds, table, lower)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 values mean nothing."""
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out[: n - j] = out[: n - j] * _GRAM + words[j:]
    return mix(out + np.uint64(k))


def gram_positions(ptr: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words fit into their document."""
    counts = np.diff(ptr)
    n = int(ptr[-1])
    ok = np.ones(n, dtype=bool)
    ends = ptr[1:]
    for j in range(1, k):
        at = ends - j
        ok[at[(counts >= j)]] = False
    return np.flatnonzero(ok)


def shingle_sets(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document and their bounds.

    A document of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    docs = w.doc_of()
    at = gram_positions(w.ptr, k)
    values, owner = grams(h, k)[at] if len(at) else np.zeros(0, np.uint64), docs[at]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = np.empty(len(short), dtype=np.uint64)
        for m in range(1, k):
            of = np.flatnonzero(counts[short] == m)
            if len(of):
                one[of] = grams(h, m)[w.ptr[short[of]]]
        values, owner = np.concatenate([values, one]), np.concatenate([owner, short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(w.ptr)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    if len(values):
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(w.ptr)))


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte whether it starts a code point."""
    return (data & 0xC0) != 0x80


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" and values.dtype != np.uint64 else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits, as four integers, of each set of hashes: how many fall on each bit, modulo 2."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    odd = np.bincount(owner * 256 + (mix(values) & np.uint64(255)).astype(np.int64), minlength=n * 256) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 256), axis=1).view(np.int64)


def wide_parities(values: np.ndarray, bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Parities as above of four bits or more for each hash of a set, and their bounds: 64-bit words, a power of
    two from 4 to most of them a set.  Both halves of a set's words, xored, are its parities of half as many."""
    size = np.diff(bounds)
    words = np.minimum(most, 1 << np.ceil(np.log2(np.maximum(4, size / 16))).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(words)])
    bit = mix(values) & np.repeat(64 * words - 1, size).astype(np.uint64)
    odd = np.bincount(np.repeat(64 * cut[:-1], size) + bit.astype(np.int64), minlength=64 * cut[-1]) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), cut


def list_array(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, ordered by key, and the group number of each."""
    n = len(keys)
    low = max(1, int(n).bit_length())
    packed = np.sort((keys >> np.uint64(low) << np.uint64(low)) | np.arange(n, dtype=np.uint64))
    top = packed >> np.uint64(low)
    same = top[1:] == top[:-1]
    near = np.zeros(n, dtype=bool)
    near[1:] |= same
    near[:-1] |= same
    at = (packed[near] & np.uint64((1 << low) - 1)).astype(np.int64)
    order = np.argsort(keys[at], kind="stable")
    at = at[order]
    k = keys[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    group = np.cumsum(new) - 1
    keep = size[group] > 1 if len(at) else new
    return at[keep], np.unique(group[keep], return_inverse=True)[1] if keep.any() else group[keep]


def in_scope(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys made distinct between owners, so that equal keys count only within one owner."""
    return mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED270B7F9A2C35)))


def span_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span, in order."""
    up, down = _power_tables(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum((h | _ONE) * up[: len(h)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))

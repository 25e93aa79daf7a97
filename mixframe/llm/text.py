"""Words of whole columns of text as NumPy arrays: where they start, where they
end, and 64-bit hashes of words and of windows of words. Works on the UTF-8
bytes of an Arrow column, so that no Python string is made per word."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 20

# White space that separates words.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def byte_set(values) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(values)] = True
    return found


BY_SPACE = byte_set(SPACES)
#: Everything in ASCII but digits and letters separates.
BY_NON_WORD = byte_set(
    b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spread(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers without a pattern."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of ``data`` on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes. Eight bytes at a time are mixed in by a
    one-to-one step that no arithmetic of the bytes undoes; ``which`` 0 and 1
    are two independent hashes."""
    length, parts = end - start, lanes(data)
    out = mix(length.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(_SEEDS[which]))
    some = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    for k in range(0, LONG_WORD, 8):
        some = some[length[some] > k]
        if not len(some):
            break
        lane = parts[start[some] + k] & _FIRST_BYTES[np.minimum(length[some] - k, 8)]
        out[some] = mix(out[some] ^ lane)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        made = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(made[8 * which : 8 * which + 8], "little")
    return out


def same_spans(a: np.ndarray, a_start, a_end, b: np.ndarray, b_start, b_end) -> np.ndarray:
    """Whether spans of ``a`` and spans of ``b`` hold the same bytes, pair by pair."""
    length = a_end - a_start
    same = length == b_end - b_start
    left, right, k = lanes(a), lanes(b), 0
    some = np.flatnonzero(same & (length > 0))
    while len(some):
        mask = _FIRST_BYTES[np.minimum(length[some] - k, 8)]
        equal = ((left[a_start[some] + k] ^ right[b_start[some] + k]) & mask) == 0
        same[some[~equal]] = False
        k += 8
        some = some[equal & (length[some] > k)]
    return same


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            made = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                x = np.full(size, b, U64)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_OF_WORDS = (Powers(0xA0761D6478BD642F), Powers(0xE7037ED1A0B428DB))


def _range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial of ``values[start:end]`` for each range, starts ascending."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + CHUNK)))
        stop = max(int(ends[j - 1]), base)
        up, down = powers.get(stop - base + 1)
        sums = np.zeros(stop - base + 1, U64)
        np.cumsum(values[base:stop] * up[:-1], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return out


@dataclass
class Words:
    """Words of the texts of a column. Those of text ``d`` are numbered
    ``first[d]`` to ``first[d + 1] - 1``; ``start`` and ``end`` count bytes of
    ``data``, in which text ``d`` is ``data[offset[d]:offset[d + 1]]``; where
    words were cut with ``lower``, ``data`` has small letters too."""

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def second_hash(self) -> np.ndarray:
        """Another hash of each word, independent of ``hash``."""
        return span_hashes(self.data, self.start, self.end, 1)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def of_text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offset = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    offset = offset.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offset[0] : offset[-1]], offset - offset[0]


def words(column, separators: np.ndarray = BY_SPACE, lower: bool = False) -> Words:
    data, offset = raw(column)
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offset[(offset > 0) & (offset < len(data))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if lower:
        data = LOWER[data]
    return Words(data, offset, start, end, np.searchsorted(start, offset), span_hashes(data, start, end))


class Vocabulary:
    """Distinct terms, found again by hash and then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.start, self.end = ends - np.array([len(t) for t in terms], np.int64), ends
        hashes = span_hashes(self.data, self.start, self.end)
        self.order = np.argsort(hashes, kind="stable")
        self.keys = hashes[self.order]

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, found: Words) -> np.ndarray:
        """The number of each word's term, -1 where it is none of them."""
        out = np.full(len(found.hash), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, found.hash)
        words_ = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == found.hash)
        at = at[words_]
        while len(words_):  # once, unless terms share a hash
            term = self.order[at]
            same = same_spans(found.data, found.start[words_], found.end[words_], self.data, self.start[term], self.end[term])
            out[words_[same]] = term[same]
            words_, at = words_[~same], at[~same] + 1
            more = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == found.hash[words_])
            words_, at = words_[more], at[more]
        return out


def windows(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash for every run of ``size`` values; run ``i`` starts at value ``i``.
    ``which`` 0 and 1 are two independent hashes, as independent as the values
    they are given."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    values = mix(hashes + U64(0x632BE59BD9B4E019)) if which else hashes
    return mix(_range_sums(values, at, at + size, _OF_WORDS[which]) + U64(size))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a window starts that stays in its text."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = np.ones(int(first[-1]), bool)
    for k in range(1, size):
        last = first[1:] - k
        fits[last[last >= first[:-1]]] = False
    return np.flatnonzero(fits)


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups that ``counts`` gives the sizes of."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch with up to ``most`` bytes of text each, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0)
    ends, at = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto

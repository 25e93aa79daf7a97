"""Removal of repeated passages by level-wise doubling.

A window of words can only repeat if both of its halves do. So short windows
are counted first, over all documents; windows of twice the length are looked
at only where both halves were repeated, and so on up to the wanted length.
After the first level only the passages that repeat are still in play, and a
document without any leaves with its result at once. At the last level windows
are told apart by 128 bits, and the earliest occurrence of each is found.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import asked, bucket_count, packs, replied, staged, to_bytes, told
from .text import U64, window_starts, windows, words

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"
STATE = SCHEMA + ", block bigint, n_bytes bigint, payload binary"
STATE_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    + [("kept_text", pa.string()), ("kept_sha256", pa.string())]
    + [("block", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())]
)
LAST = np.iinfo(np.int64).max


def _levels(window: int, first: int) -> list[int]:
    """Lengths from about ``first`` words up to ``window``, each at most twice the one before."""
    out = [window]
    while out[-1] > first:
        out.append(max(first, -(-out[-1] // 2)))
    return out[::-1]


def _starts(table: pa.Table, first: np.ndarray, size: int) -> np.ndarray:
    """Words at which a window still in play starts."""
    if "starts" not in table.column_names:
        return window_starts(first, size)
    lists = table.column("starts").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy() + np.repeat(first[:-1], counts)


def _finished(doc_ids: pa.Array, found, covered: np.ndarray | None, keep_text: bool) -> dict[str, list]:
    ids, removed, kept, digests = doc_ids.to_pylist(), [], [], []
    data, offset = found.data.tobytes(), found.offset
    gone = np.zeros(len(ids), np.int64)
    if covered is not None:
        gone = np.diff(np.concatenate([[0], np.cumsum(covered)])[found.first])
    for d in range(len(ids)):
        parts = data[offset[d] : offset[d + 1]].split()
        if gone[d]:
            parts = compress(parts, (~covered[found.first[d] : found.first[d + 1]]).tolist())
        text = b" ".join(parts)
        removed.append(int(gone[d]))
        kept.append(text.decode() if keep_text else None)
        digests.append(hashlib.sha256(text).hexdigest())
    return dict(zip(SCHEMA_NAMES, (ids, found.counts.tolist(), removed, kept, digests)))


SCHEMA_NAMES = [f.name for f in STATE_FIELDS][:5]


def _state(done: dict[str, list], rest: list[tuple]) -> pa.Table:
    n, m = len(done["doc_id"]), len(rest)
    columns = [pa.array(done[f.name] + [None] * m, f.type) for f in list(STATE_FIELDS)[:5]]
    more = zip(*rest) if rest else ([],) * 3
    columns += [pa.array([None] * n + list(x), f.type) for x, f in zip(more, list(STATE_FIELDS)[5:])]
    return pa.Table.from_arrays(columns, schema=STATE_FIELDS)


def remove_repeats(docs: DataFrame, window: int = 20, first: int = 5, keep_text: bool = True) -> DataFrame:
    """Remove every word of ``docs`` (``doc_id``, ``text``) that lies in a window
    of ``window`` words whose word sequence also starts earlier: in a document
    of smaller ``doc_id``, or earlier in the same one. Windows are judged on
    the input.

    Words are separated by white space and compared unchanged. Returns
    ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by
    one space; null with ``keep_text=False``) and ``kept_sha256``, its SHA-256.
    A null text has no words. Null ids come after all others; rows that share an
    id are separate documents in an order that is fixed within the run, so of
    repeated rows one keeps its passages. Overlapping occurrences in one
    document count. An empty table gives an empty result; other columns are
    ignored.
    """
    if window < 1 or first < 1:
        raise ValueError("window and first must be positive")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    live, results = packs(rows, "repeats-blocks"), []
    buckets = bucket_count(live)
    total = live.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(64, -(-(total.bit_length() + 8) // 8) * 8)
    levels = _levels(window, min(first, window))
    for size, longer in zip(levels, levels[1:]):
        state = staged(_level(live, buckets, bits, size, longer, keep_text), f"repeats-{size}")
        results.append(state.where("payload IS NULL").select(*SCHEMA_NAMES))
        live = state.where("payload IS NOT NULL").select("block", "n_bytes", "payload")
        buckets = bucket_count(live)
        if live.isEmpty():
            break
    else:
        results.append(_last(live, buckets, levels[-1], keep_text))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _level(live: DataFrame, buckets: int, bits: int, size: int, longer: int, keep_text: bool) -> DataFrame:
    """Ask which windows of ``size`` words repeat; keep the places where a
    window of ``longer`` words consists of two such."""
    low = U64((1 << (64 - bits)) - 1)

    def found(table: pa.Table):
        text = words(table.column("text"))
        starts = _starts(table, text.first, size)
        hashes = windows(text.hash, size)[starts] & ~low if len(starts) else np.zeros(0, U64)
        keys, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return text, starts, keys, inverse, counts

    def question(table: pa.Table, block: int) -> list[list[np.ndarray]]:
        _, _, keys, _, counts = found(table)
        return [[keys, (counts > 1).astype(np.uint8)]]

    def answer(questions, blocks):
        keys = np.concatenate([q[0] for q in questions])
        several = np.concatenate([q[1] for q in questions])
        distinct, inverse = np.unique(keys, return_inverse=True)
        repeated = np.bincount(inverse, weights=1 + several, minlength=len(distinct)) > 1
        ends = np.cumsum([len(q[0]) for q in questions])[:-1]
        return [[x] for x in np.split(repeated[inverse].astype(np.uint8), ends)]

    def use(table: pa.Table, block: int, answers: list[np.ndarray]) -> pa.Table:
        text, starts, keys, inverse, _ = found(table)
        repeated = np.zeros(int(text.first[-1]) + longer, bool)
        if len(keys):
            repeated[starts] = answers[0][inverse].astype(bool)
        n, step = int(text.first[-1]), longer - size
        both = np.flatnonzero(repeated[:n] & repeated[step : step + n])
        owner = np.searchsorted(text.first, both, "right") - 1
        fits = both + longer <= text.first[owner + 1]
        both, owner = both[fits], owner[fits]
        counts = np.bincount(owner, minlength=len(table))
        stays = counts > 0
        done = table.filter(pa.array(~stays))
        finished = _finished(done.column("doc_id"), words(done.column("text")), None, keep_text)
        if not stays.any():
            return _state(finished, [])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts[stays])]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array((both - text.first[owner]).astype(np.int32)))
        rest = table.filter(pa.array(stays)).select(["doc_id", "text"]).append_column("starts", lists)
        size_of = int(np.diff(text.offset)[stays].sum())
        return _state(finished, [(block, size_of, to_bytes(rest.combine_chunks()))])

    replies = replied(asked(live, buckets, question), answer)
    return told(live, replies, use, STATE)


def _last(live: DataFrame, buckets: int, size: int, keep_text: bool) -> DataFrame:
    """Remove the windows of ``size`` words that are not the first of their kind."""

    def found(table: pa.Table):
        """Windows, their distinct keys, and the first occurrence of each here."""
        text = words(table.column("text"))
        starts = _starts(table, text.first, size)
        empty = np.zeros(0, U64)
        hashes = (text.hash, text.second_hash()) if len(starts) else ()
        a, b = (windows(x, size, k)[starts] for k, x in enumerate(hashes)) if hashes else (empty, empty)
        ids = table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy()
        row = np.searchsorted(text.first, starts, "right") - 1
        order = np.lexsort((starts, row, ids[row], b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return text, starts[order], ids[row[order]], row[order], a, b, new

    def question(table: pa.Table, block: int) -> list[list[np.ndarray]]:
        text, starts, ids, row, a, b, new = found(table)
        place = starts - text.first[row]
        return [[a[new], b[new], ids[new], row[new].astype(np.uint32), place[new].astype(np.uint32)]]

    def answer(questions, blocks):
        a, b, ids, row, place = (np.concatenate(x) for x in zip(*questions))
        lengths = [len(q[0]) for q in questions]
        order = np.lexsort((place, row, np.repeat(np.arange(len(lengths)), lengths), ids, b, a))
        a, b = a[order], b[order]
        earliest = np.ones(len(a), bool)
        earliest[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        won = np.zeros(len(a), np.uint8)
        won[order] = earliest
        return [[x] for x in np.split(won, np.cumsum(lengths)[:-1])]

    def use(table: pa.Table, block: int, answers: list[np.ndarray]) -> pa.Table:
        text, starts, _, _, _, _, new = found(table)
        stays = np.zeros(len(starts), bool)
        if len(starts):
            stays[new] = answers[0].astype(bool)
        edges = np.zeros(int(text.first[-1]) + 1, np.int64)
        gone = starts[~stays]
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + size, -1)
        covered = np.cumsum(edges)[:-1] > 0
        done = _finished(table.column("doc_id"), text, covered, keep_text)
        return pa.Table.from_pydict(done, schema=pa.schema(list(STATE_FIELDS)[:5]))

    return told(live, replied(asked(live, buckets, question), answer), use, SCHEMA)

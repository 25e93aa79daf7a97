"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of consecutive words; a window occurs in a document
if all of it is there. Seen as a set of shingles, that is containment with an
overlap of everything, so one necessary prefix token per window is enough: its
rarest shingle, by the counts of the corpus. Documents are looked up by these
tokens only. A hit fixes where the window would have to start (positional
bound) and that it must end inside the text (length bound); what passes is
compared word by word.

The items are cut into chunks of bounded size. A chunk is broadcast; the
documents pass by it without a shuffle and take their hits along to the next.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mapped, staged
from .text import BY_NON_WORD, U64, Words, pieces, same_spans, window_starts, windows, words

CHUNK_BYTES = 16 << 20
SLICE = 1 << 18
#: Text that is looked at together.
PIECE_BYTES = 1 << 20
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"
PASS = "doc_id bigint, text string, hits array<int>, items array<string>"
FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))]
)
PASS_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)


def item_words(texts) -> Words:
    """A-Z in lower case; runs of digits, letters and everything outside ASCII."""
    return words(texts, BY_NON_WORD, lower=True)


class Windows:
    """The distinct windows of a chunk of items."""

    def __init__(self, ids: list[str], texts, window: int, shingle: int):
        found = item_words(texts)
        spans: dict[bytes, tuple[int, int, set[str]]] = {}
        raw, cuts = found.data.tobytes(), list(zip(found.start.tolist(), found.end.tolist()))
        spelt = [raw[i:j] for i, j in cuts]
        for d, item in enumerate(ids):
            lo, hi = int(found.first[d]), int(found.first[d + 1])
            size = min(window, hi - lo)
            for at in range(lo, hi - size + 1 if size else lo):
                spans.setdefault(b" ".join(spelt[at : at + size]), (at, size, set()))[2].add(item)
        #: words of the windows, by which occurrences are confirmed, and where in them each window starts
        self.data, self.word_start, self.word_end = found.data, found.start, found.end
        self.word = np.array([at for at, _, _ in spans.values()], np.int64)
        self.hashes = [found.hash[at : at + size] for at, size, _ in spans.values()]
        self.items = [sorted(items) for _, _, items in spans.values()]
        #: per shingle size: (shingle, window, offset) of every shingle of every window
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for w, part in enumerate(self.hashes):
            size = min(shingle, len(part))
            made = windows(part, size)
            by_size.setdefault(size, []).append((made, np.full(len(made), w), np.arange(len(made))))
        for size, parts in by_size.items():
            self.shingles[size] = tuple(np.concatenate(x) for x in zip(*parts))
        self.keys = {size: np.unique(x[0]) for size, x in self.shingles.items()}
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def prefixes(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of every window its rarest shingle; a window that has one the
        corpus lacks can't occur and goes."""
        self.prefix = {}
        for size, (made, w, offset) in self.shingles.items():
            rarity = np.array([counts.get((size, int(x)), 0) for x in self.keys[size].view(np.int64)])
            of_each = rarity[np.searchsorted(self.keys[size], made)]
            order = np.lexsort((offset, made, of_each, w))
            lead = order[np.concatenate([[True], w[order][1:] != w[order][:-1]])]
            lead = lead[of_each[lead] > 0]
            lead = lead[np.argsort(made[lead], kind="stable")]
            self.prefix[size] = (made[lead], w[lead], offset[lead])

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the windows, and their words in rows of one length."""
        if self.table is None:
            lengths = np.array([len(x) for x in self.hashes], np.int64)
            table = np.zeros((len(lengths), int(lengths.max(initial=0))), U64)
            for w, part in enumerate(self.hashes):
                table[w, : len(part)] = part
            self.table = lengths, table
        return self.table


def _count(docs: DataFrame, chunk: Windows) -> dict[tuple[int, int], int]:
    """How often each shingle of the chunk occurs in the corpus."""
    keys = docs.sparkSession.sparkContext.broadcast(chunk.keys)

    def count(batches):
        sums = {size: np.zeros(len(k), np.int64) for size, k in keys.value.items()}
        for batch in chain.from_iterable(pieces(b, PIECE_BYTES) for b in batches):
            found = item_words(batch.column("text"))
            for size, k in keys.value.items():
                made = windows(found.hash, size)[window_starts(found.first, size)]
                at = np.minimum(np.searchsorted(k, made), len(k) - 1)
                sums[size] += np.bincount(at[k[at] == made], minlength=len(k))
        for size, n in sums.items():
            some = np.flatnonzero(n)
            columns = [np.full(len(some), size, np.int32), keys.value[size][some].view(np.int64), n[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "shingle", "n"])

    counted = mapped(docs.select("text"), count, "size int, shingle bigint, n bigint")
    # one row per shingle of the chunk at most, so as bounded as the chunk
    rows = counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], r["shingle"]): r["n"] for r in rows}


def _matches(found: Words, chunk: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur: (word, window)."""
    at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lengths, table = chunk.padded()
    for size, (made, w, offset) in chunk.prefix.items():
        if not len(made):
            continue
        places = window_starts(found.first, size)
        shingles = windows(found.hash, size)[places]
        lo = np.searchsorted(made, shingles)
        known = made[np.minimum(lo, len(made) - 1)] == shingles
        places, shingles = places[known], shingles[known]
        lo, hi = np.searchsorted(made, shingles), np.searchsorted(made, shingles, "right")
        done, ends = 0, np.cumsum(hi - lo)
        while done < len(places):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, "right")))
            n = (hi - lo)[done:upto]
            row = np.repeat(lo[done:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = np.repeat(places[done:upto], n)
            text = np.searchsorted(found.first, word, "right") - 1
            begin = word - offset[row]
            fits = (begin >= found.first[text]) & (begin + lengths[w[row]] <= found.first[text + 1])
            begin, window = begin[fits], w[row[fits]]
            for k in range(table.shape[1]):
                same = (k >= lengths[window]) | (found.hash[np.minimum(begin + k, len(found.hash) - 1)] == table[window, k])
                begin, window = begin[same], window[same]
            for k in range(table.shape[1]):  # equal hashes are not proof enough
                here = np.flatnonzero(k < lengths[window])
                a, b = begin[here] + k, chunk.word[window[here]] + k
                same = np.ones(len(window), bool)
                same[here] = same_spans(found.data, found.start[a], found.end[a], chunk.data, chunk.word_start[b], chunk.word_end[b])
                begin, window = begin[same], window[same]
            at.append(begin)
            which.append(window)
            done = upto
    return np.concatenate(at), np.concatenate(which)


def _scan(docs: DataFrame, chunk: Windows, last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(chunk)

    def scan(batches):
        chunk = shared.value
        for batch in chain.from_iterable(pieces(b, PIECE_BYTES) for b in batches):
            found = item_words(batch.column("text"))
            n = len(batch)
            covered = np.zeros(int(found.first[-1]) + 1, np.int64)
            items = [set(x) for x in batch.column("items").to_pylist()]
            for d, before in enumerate(batch.column("hits").to_pylist()):
                covered[found.first[d] + np.array(before[0::2], np.int64)] += 1
                covered[found.first[d] + np.array(before[1::2], np.int64)] -= 1
            at, which = _matches(found, chunk)
            lengths = np.array([len(chunk.hashes[w]) for w in which], np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + lengths, -1)
            text = np.searchsorted(found.first, at, "right") - 1
            for d, w in set(zip(text.tolist(), which.tolist())):
                items[d].update(chunk.items[w])
            hit = np.cumsum(covered)[:-1] > 0
            names = [sorted(x) for x in items]
            if last:
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[found.first])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(found.counts),
                        pa.array(n_hit.astype(np.int64)),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                        pa.array(n_hit > 0),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    schema=FIELDS,
                )
            else:
                hits = [_spans(hit[found.first[d] : found.first[d + 1]]) for d in range(n)]
                columns = [batch.column("doc_id"), batch.column("text")]
                columns += [pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema=PASS_FIELDS)

    return mapped(docs, scan, SCHEMA if last else PASS)


def _spans(hit: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges.tolist()


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Which words of ``docs`` (``doc_id``, ``text``) lie in passages of
    ``items`` (``item_id``, ``text``): in an occurrence of ``window``
    consecutive words of an item, or of a whole item that has fewer.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``n_items`` (items with
    windows that occur), ``items_sha256`` (their ids, sorted as strings, joined
    by commas), ``contaminated`` and ``items`` (the ids). A null text has no
    words, and an item without words never occurs. Items that share an id count
    as one; a null id is written as an empty string. Repeated documents are
    judged alike and stay repeated; an empty table of either kind is fine; other
    columns are ignored.
    """
    if window < 1 or shingle < 1:
        raise ValueError("window and shingle must be positive")
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.array().cast("array<int>").alias("hits"),
        none.alias("items"),
    )
    chunks = _chunks(docs, items, window, shingle, chunk_bytes)
    for k, chunk in enumerate(chunks):
        last = k == len(chunks) - 1
        rows = _scan(rows, chunk(), last)
        if not last and k % 4 == 3:
            rows = staged(rows, "decontaminate")
    return rows


def _chunks(docs: DataFrame, items: DataFrame, window: int, shingle: int, chunk_bytes: int):
    """The items in chunks, each made when it is called for."""
    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    given = given.where("text IS NOT NULL").distinct()
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = 1 + 2 * total // chunk_bytes

    def chunk(k: int) -> Windows:
        part = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks)) == k)
        chosen = part.collect()
        texts = pa.array([r["text"] for r in chosen], pa.string())
        made = Windows([r["item_id"] for r in chosen], texts, window, shingle)
        made.prefixes(_count(docs, made) if made.hashes else {})
        return made

    return [partial(chunk, k) for k in range(n_chunks)]


def uncontaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs."""
    for k, chunk in enumerate(_chunks(docs, items, window, shingle, chunk_bytes)):
        docs = _without(docs, chunk())
        if k % 4 == 3:
            docs = staged(docs, "decontaminate")
    return docs


def _without(docs: DataFrame, chunk: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(chunk)

    def choose(batches):
        for batch in chain.from_iterable(pieces(b, PIECE_BYTES) for b in batches):
            found = item_words(batch.column("text"))
            hit = np.zeros(len(batch), bool)
            hit[np.searchsorted(found.first, _matches(found, shared.value)[0], "right") - 1] = True
            yield batch.filter(pa.array(~hit))

    return mapped(docs, choose, docs.schema)

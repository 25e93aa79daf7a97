"""Ranked lexical search through trees of frequent terms.

Only the terms of the items matter, so every document becomes a short vector
of those. The documents of a task, a bounded number at a time, are put into an
FP-tree: each vector is ordered by how frequent its terms are in the corpus, and
vectors that begin alike share a path. A node knows the largest tf of every term
in its subtree and the smallest m, which bound the score of any document below
it. Each item searches the tree depth first, the most promising child first, and
leaves out what cannot reach the best documents found so far."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixframe.runtime import model_table

from .blocks import mapped, read_arrays, scratch, staged, write_arrays
from .text import BY_NON_WORD, Vocabulary, pieces, words

K = 10
#: Text of the items that are searched for together.
CHUNK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Term occurrences of a tree, about, and cells of its table of tf maxima.
TREE_TERMS, TREE_CELLS = 1 << 20, 4 << 20
#: Documents that a subtree needs to be divided further, at the least.
LEAF = 64
LAST = np.iinfo(np.int64).max

VECTORS = "n_docs bigint, n_terms bigint, n_known bigint, payload binary"
VECTOR_FIELDS = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("n_known", pa.int64()), ("payload", pa.binary())]
)
FOUND = "item int, part int, doc_id bigint, score bigint"
FOUND_FIELDS = pa.schema([("item", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def weight(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2n + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def gain(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives to a score; grows with tf and falls with m."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Vectors:
    """Documents as vectors of known terms: those of document ``d`` are
    ``term[at[d]:at[d + 1]]``, ascending, with their ``tf``."""

    def __init__(self, ids, missing, length, at, term, tf):
        self.ids, self.missing, self.length = ids, missing, length
        self.at, self.term, self.tf = at, term, tf

    @classmethod
    def of(cls, batch: pa.RecordBatch, terms: Vocabulary) -> Vectors:
        found = words(batch.column("text"), BY_NON_WORD, lower=True)
        number, owner = terms.numbers(found), found.of_text()
        known = number >= 0
        keys, tf = np.unique(owner[known] * len(terms) + number[known], return_counts=True)
        row = keys // max(len(terms), 1)
        ids = batch.column("doc_id")
        at = np.searchsorted(row, np.arange(len(batch) + 1))
        missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        return cls(ids.fill_null(LAST).to_numpy(), missing, found.counts, at, (keys - row * len(terms)).astype(np.int32), tf.astype(np.int64))

    @classmethod
    def read(cls, payloads: list) -> Vectors:
        parts = [read_arrays(p) for p in payloads]
        ids, missing, length, counts, term, tf = (np.concatenate(x) for x in zip(*parts))
        at = np.concatenate([[0], np.cumsum(counts)])
        return cls(ids, missing, length, at, term, tf)

    def write(self) -> bytes:
        return write_arrays([self.ids, self.missing, self.length, np.diff(self.at), self.term, self.tf])


def _vectors(docs: DataFrame, terms: Vocabulary) -> DataFrame:
    """Vectors of the documents, a piece of text to a row. Documents without a
    known term are only counted: no item can find them."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(pieces(b, PIECE_BYTES) for b in batches):
            all_ = Vectors.of(batch, shared.value)
            counts = np.diff(all_.at)
            keep = np.flatnonzero(counts)
            some = Vectors(all_.ids[keep], all_.missing[keep], all_.length[keep], np.concatenate([[0], np.cumsum(counts[keep])]), all_.term, all_.tf)
            row = [[int((all_.length > 0).sum())], [int(all_.length.sum())], [len(all_.term)], [some.write()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, VECTOR_FIELDS)], schema=VECTOR_FIELDS)

    return mapped(docs, make, VECTORS)


def _document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: one sum per task and term, as many rows
    in the end as the items have terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                sums += np.bincount(Vectors.read([payload.as_py()]).term, minlength=n_terms)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["term", "df"])

    counted = mapped(vectors.select("payload"), count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in counted.collect():
        df[row.term] = row.df
    return df


class Tree:
    """FP-tree of documents. ``doc`` lists them in the order of their paths; a
    node is a range of it, with its children or, in a leaf, none."""

    def __init__(self, docs: Vectors, m: np.ndarray, rank: np.ndarray, leaf: int = LEAF):
        ranks = rank[docs.term]
        owner = np.repeat(np.arange(len(docs.ids)), np.diff(docs.at))
        by_path = np.lexsort((ranks, owner))
        raw, cut = ranks[by_path].astype(">u4").tobytes(), (4 * docs.at).tolist()
        paths = [raw[i:j] for i, j in zip(cut, cut[1:])]
        self.doc = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.ids, self.missing, self.m = docs.ids[self.doc], docs.missing[self.doc], m[self.doc]
        # postings in the order of the tree, and within a document by path
        counts = np.diff(docs.at)[self.doc]
        self.at = np.concatenate([[0], np.cumsum(counts)])
        source = by_path[np.repeat(docs.at[self.doc] - self.at[:-1], counts) + np.arange(self.at[-1])]
        self.term, self.tf = docs.term[source], docs.tf[source]
        # beyond that many nodes leaves stay larger
        self._divide(self._shared(), leaf, 4 * TREE_CELLS // max(len(rank), 1))

    def _shared(self) -> np.ndarray:
        """Length of the path each document shares with the one before."""
        counts = np.diff(self.at)
        least = np.minimum(counts[1:], counts[:-1])
        ends = np.cumsum(least)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - least, least)
        differ = self.term[np.repeat(self.at[1:-1], least) + step] != self.term[np.repeat(self.at[:-2], least) + step]
        out = least.copy()
        pair = np.repeat(np.arange(len(least)), least)[differ]
        np.minimum.at(out, pair, step[differ])
        return np.concatenate([[0], out])

    def _divide(self, shared: np.ndarray, leaf: int, most: int) -> None:
        self.lo, self.hi, self.children = [], [], []
        todo = [self._node(0, len(self.doc))]
        while todo:
            node = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf or len(self.lo) >= most:
                continue
            inner = shared[lo + 1 : hi]
            splits = lo + 1 + np.flatnonzero(inner == inner.min())
            bounds = [lo, *splits.tolist(), hi]
            start, groups = lo, []
            for a, b in zip(bounds, bounds[1:]):
                # neighbours of one parent that are too small share a leaf
                if b - a > leaf:
                    if start < a:
                        groups.append((start, a))
                    groups.append((a, b))
                    start = b
                elif b - start > leaf:
                    groups.append((start, a) if start < a else (a, b))
                    start = a if start < a else b
            if start < hi:
                groups.append((start, hi))
            if len(groups) < 2:
                continue
            self.children[node] = [self._node(a, b) for a, b in groups]
            todo += self.children[node]

    def _node(self, lo: int, hi: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        return len(self.lo) - 1

    def bounds(self, n_terms: int) -> None:
        """Per node the largest tf of each term and the smallest m below it."""
        self.most = np.zeros((len(self.lo), n_terms), np.int32)
        self.least = np.empty(len(self.lo), np.int64)
        for node in range(len(self.lo) - 1, -1, -1):  # children come after their parent
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(axis=0)
                self.least[node] = self.least[self.children[node]].min()
            else:
                lo, hi = self.lo[node], self.hi[node]
                a, b = self.at[lo], self.at[hi]
                np.maximum.at(self.most[node], self.term[a:b], self.tf[a:b])
                self.least[node] = self.m[lo:hi].min(initial=LAST)
        # postings of a leaf by term
        self.by_term: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def leaf(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, document and tf of the postings of a leaf, ascending by term."""
        if node not in self.by_term:
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.at[lo], self.at[hi]
            owner = np.repeat(np.arange(lo, hi), np.diff(self.at[lo : hi + 1]))
            order = np.argsort(self.term[a:b], kind="stable")
            self.by_term[node] = self.term[a:b][order], owner[order], self.tf[a:b][order]
        return self.by_term[node]


class Best:
    """The ``k`` best documents of an item so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.score, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if len(self.score) == self.k:
            keep = score >= self.floor
            score, ids, missing = score[keep], ids[keep], missing[keep]
        if not len(score):
            return
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        missing = np.concatenate([self.missing, missing])
        first = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.ids, self.missing = score[first], ids[first], missing[first]
        self.floor = int(self.score[-1]) if len(first) == self.k else 0


def search(tree: Tree, terms: np.ndarray, w: np.ndarray, best: Best) -> None:
    """Add to ``best`` what the tree has for an item of these ``terms``."""
    reach = gain(w, tree.most[:, terms].astype(np.int64), tree.least[:, None]).sum(axis=1)
    todo = [0]
    while todo:
        node = todo.pop()
        # an equal score still counts where the id is smaller
        if reach[node] < max(best.floor, 1):
            continue
        if tree.children[node]:
            todo += sorted(tree.children[node], key=reach.__getitem__)
            continue
        known, owner, tf = tree.leaf(node)
        a, b = np.searchsorted(known, terms), np.searchsorted(known, terms, "right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = owner[at]
        lo = tree.lo[node]
        score = np.zeros(tree.hi[node] - lo, np.int64)
        np.add.at(score, doc - lo, gain(np.repeat(w, n), tf[at], tree.m[doc]))
        some = np.flatnonzero(score > 0)
        best.add(score[some], tree.ids[lo + some], tree.missing[lo + some])


def _found(vectors: DataFrame, items: list[np.ndarray], df: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """The best documents of each task for each item."""
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    w = weight(df, n)
    limit = max(TREE_CELLS // max(len(df), 1), 8) * LEAF
    shared = vectors.sparkSession.sparkContext.broadcast((items, rank, w))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, docs, terms = [], 0, 0
        for batch in batches:
            for payload, n_docs, n_known in zip(batch.column("payload"), *(batch.column(c).to_pylist() for c in ("n_docs", "n_known"))):
                held.append(payload.as_py())
                docs, terms = docs + n_docs, terms + n_known
                if docs >= limit or terms >= TREE_TERMS:
                    yield tree(held)
                    held, docs, terms = [], 0, 0
        if held:
            yield tree(held)

    def tree(payloads: list) -> Tree:
        docs = Vectors.read(payloads)
        made = Tree(docs, 10 + (90 * docs.length * n) // max(total, 1), shared.value[1])
        made.bounds(len(shared.value[1]))
        return made

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, _, w = shared.value
        best = [Best(k) for _ in items]
        for made in trees(batches):
            if len(made.doc):
                for terms, own in zip(items, best):
                    if len(terms):
                        search(made, terms, w[terms], own)
        part = TaskContext.get().partitionId() % 64
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(b.score) for b in best])
        if len(item):
            ids, missing = (np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "missing"))
            columns = [pa.array(item), pa.array(np.full(len(item), part, np.int32)), pa.array(ids, mask=missing.astype(bool))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([b.score for b in best]))], schema=FOUND_FIELDS)

    return mapped(vectors.select("n_docs", "n_known", "payload"), find, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``k`` best of ``docs`` (``doc_id``, ``text``) for each of ``items``
    (``item_id``, ``text``): ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms are runs of digits, letters and everything outside ASCII, A-Z in lower
    case. A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of
    n terms has m = 10 + 90 n N div L; its score sums
    w (1000000000 tf div (1000 tf + 8 m)) over the distinct terms of the item.
    Documents with a score of 0 are left out, equal scores go by ascending
    ``doc_id``, null last. A null text has no terms and counts for nothing. Rows
    of ``docs`` that are repeated are ranked each; rows of ``items`` that are
    equal count once, and items that share an id but not the text are ranked
    each under that id. Items without terms, or whose terms do not occur, have
    no rows; an empty table of either kind gives none. Other columns are ignored.

    Items are taken a bounded amount of text at a time; each amount is one pass
    over the documents.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    given = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = 1 + 2 * total // chunk_bytes
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_chunks))
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    with scratch(spark):
        for c in range(n_chunks):
            # at most about chunk_bytes of text
            chosen = given.where(chunk == c).collect()
            found = words(pa.array([r.text for r in chosen], pa.string()), BY_NON_WORD, lower=True)
            raw = found.data.tobytes()
            spelt = [raw[i:j] for i, j in zip(found.start.tolist(), found.end.tolist())]
            own = [set(spelt[a:b]) for a, b in zip(found.first.tolist(), found.first[1:].tolist())]
            names = sorted(set(spelt))
            number = {t: i for i, t in enumerate(names)}
            vectors = staged(_vectors(rows, Vocabulary(names)), "ranking-vectors")
            n, length = vectors.agg(F.sum("n_docs"), F.sum("n_terms")).first()
            df = _document_counts(vectors, len(names))
            wanted = [np.array(sorted(number[t] for t in x if df[number[t]]), np.int64) for x in own]
            best = _found(vectors, wanted, df, n or 0, length or 0, k)
            for by in (["item", "part"], ["item"]):
                order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
                best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            ids = model_table(spark, [(i, r.item_id) for i, r in enumerate(chosen)], f"item int, item_id {kind}")
            named = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
            out.append(staged(named, "ranking", keep=True))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result

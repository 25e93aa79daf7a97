"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows gives the examples and the terms: whole words
and word beginnings that toxic examples hold clearly more often than others.
How rare a term is, is counted over all documents. Documents and examples are
unit vectors of tf-idf weights. The examples stand in an inverted index whose
blocks know the largest weight of each term in them; a document visits blocks in
the order of the cosine they could reach and stops when none can reach the
nearest examples found. Those vote, the nearer the heavier, and the vote is
turned into a probability by what such votes meant among the examples."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mapped, read_arrays, scratch, staged, write_arrays
from .text import BY_NON_WORD, Vocabulary, Words, pieces, runs, span_hashes, words

#: Labelled rows of each kind that are learned from, about; terms kept at most.
EXAMPLES, TERMS = 12_000, 4096
#: Characters of the word beginnings that are terms beside whole words (0).
BEGINNINGS = (0, 3, 4, 5, 6)
#: A term is kept if so many examples hold it, so much likelier toxic ones, beyond chance.
LEAST_ROWS, LEAST_RATIO, LEAST_CHI2 = 5, 3.0, 15.0
NEAREST, EVIDENCE, BLOCK = 15, 3, 64
PIECE_BYTES, SAMPLE_BYTES = 1 << 20, 4 << 20
#: Results of equal vectors that a task remembers.
REMEMBERED = 50_000
LAST = np.iinfo(np.int64).max

COUNTS = "kind int, term binary, toxic bigint, other bigint"
COUNT_FIELDS = pa.schema([("kind", pa.int32()), ("term", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())])
SCORES = "doc_id bigint, score double, evidence array<bigint>"
SCORE_FIELDS = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])


def beginnings(found: Words, size: int) -> Words:
    """The first ``size`` characters of each word; of shorter ones nothing."""
    starts = np.flatnonzero((found.data & 0xC0) != 0x80)
    at = np.searchsorted(starts, found.start) + size
    end = np.append(starts, len(found.data))[np.minimum(at, len(starts))]
    # the word itself is a term already
    end = np.where(end < found.end, end, found.start)
    return Words(found.data, found.offset, found.start, end, found.first, span_hashes(found.data, found.start, end))


def distinct(texts) -> tuple[Words, Words, np.ndarray]:
    """Words of the texts; one of each spelling; and which of these each is."""
    found = words(texts, BY_NON_WORD, lower=True)
    _, at, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
    one = Words(found.data, found.offset, found.start[at], found.end[at], np.array([0, len(at)]), found.hash[at])
    return found, one, inverse


def _terms(one: Words) -> Iterator[tuple[int, Words]]:
    for size in BEGINNINGS:
        yield size, beginnings(one, size) if size else one


class Terms:
    """The terms kept, numbered, and their weights."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.size, self.of_kind = len(rows), {}
        for size in BEGINNINGS:
            own = [i for i, (kind, _) in enumerate(rows) if kind == size]
            self.of_kind[size] = np.array(own, np.int64), Vocabulary([rows[i][1] for i in own])

    def vectors(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the terms of each text begin, and the terms and their tf."""
        found, one, inverse = distinct(texts)
        owner, keys = found.of_text(), [np.zeros(0, np.int64)]
        for size, term in _terms(one):
            numbers, known = self.of_kind[size]
            number = known.numbers(term)
            hit = (number >= 0)[inverse]
            if hit.any():
                keys.append(owner[hit] * self.size + numbers[number[inverse[hit]]])
        keys, tf = np.unique(np.concatenate(keys), return_counts=True)
        row = keys // max(self.size, 1)
        return np.searchsorted(row, np.arange(len(found.first))), keys - row * self.size, tf


def _sample(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled documents, about ``examples`` of each kind, and how many rows
    there are of each kind. Documents are drawn by a hash of their id."""
    kinds = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    there = {r.toxic: r["count"] for r in kinds.groupBy("toxic").count().collect()}
    share = F.lit(1.0)
    for kind, n in there.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, examples / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about 2 * examples ids, whatever the size of the tables
    drawn = F.broadcast(kinds.where(draw < share))
    rows = docs.join(drawn, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows, there


def _counted(sample: DataFrame) -> DataFrame:
    """In how many toxic and how many other examples each term stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        toxic = table.column("toxic").to_numpy() > 0
        found, one, inverse = distinct(table.column("text"))
        owner, raw = found.of_text(), found.data.tobytes()
        for size, term in _terms(one):
            some = np.flatnonzero(term.end > term.start)
            _, at, same = np.unique(term.hash[some], return_index=True, return_inverse=True)
            number = np.full(len(term.hash), -1, np.int64)
            number[some] = same
            pairs = number[inverse] + owner * (len(at) + 1)
            pairs = np.unique(pairs[number[inverse] >= 0])
            row, which = pairs // (len(at) + 1), pairs % (len(at) + 1)
            counts = [np.bincount(which[toxic[row] == t], minlength=len(at)) for t in (True, False)]
            spans = zip(term.start[some][at].tolist(), term.end[some][at].tolist())
            columns = [pa.array(np.full(len(at), size, np.int32)), pa.array([raw[i:j] for i, j in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts)], schema=COUNT_FIELDS)

    return mapped(sample.select("toxic", "text"), count, COUNTS).groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _chosen(sample: DataFrame, sizes: dict[int, int], limit: int) -> list[tuple[int, bytes]]:
    """The terms that tell toxic examples best, by the chi-square statistic."""
    n1, n0 = (float(sizes.get(k, 0)) for k in (1, 0))
    a, b, n1, n0 = F.col("toxic").cast("double"), F.col("other").cast("double"), F.lit(n1), F.lit(n0)
    n = n1 + n0
    chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b) * n1 * n0)
    far = (a + b >= LEAST_ROWS) & (a * n0 > b * n1 * LEAST_RATIO) & (a + b < n)
    found = _counted(sample).where(far).withColumn("chi2", F.round(chi2, 6)).where(F.col("chi2") >= LEAST_CHI2)
    rows = found.orderBy(F.desc("chi2"), "kind", "term").limit(limit).collect()
    return [(r.kind, bytes(r.term)) for r in rows]


class Index:
    """Examples as unit vectors, in blocks that know their largest weights.

    ``vectors`` are (terms, tf) pairs, all different; ``toxic`` and ``whole`` how
    much weight of toxic and of all examples each stands for."""

    def __init__(self, vectors: list[tuple], toxic: np.ndarray, whole: np.ndarray, ids: np.ndarray, idf: np.ndarray):
        self.idf = idf
        made = [self.unit(t, tf) for t, tf in vectors]
        # examples with the same heaviest term stand together
        lead = [(int(t[np.argmax(w)]), -float(w.max())) for (t, _), w in zip(vectors, made)]
        order = sorted(range(len(made)), key=lambda i: (lead[i], i))
        self.toxic, self.whole, self.ids = toxic[order], whole[order], ids[order]
        sizes = np.array([len(made[i]) for i in order], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        self.weight = np.concatenate([made[i] for i in order] or [np.zeros(0)])
        self.blocks = -(-len(order) // BLOCK)
        self.most = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.most, (self.term, np.repeat(np.arange(len(order)) // BLOCK, sizes)), self.weight)
        self.dense = np.zeros(len(idf))

    def unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def _cosines(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = blocks * BLOCK, np.minimum((blocks + 1) * BLOCK, len(self.ids))
        row = np.repeat(lo, hi - lo) + runs(hi - lo)
        sizes = (self.at[hi] - self.at[lo]).astype(np.int64)
        at = np.repeat(self.at[lo], sizes) + runs(sizes)
        parts = self.dense[self.term[at]] * self.weight[at]
        ends = np.cumsum(self.at[row + 1] - self.at[row])
        return row, np.add.reduceat(parts, np.concatenate([[0], ends[:-1]]))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest cosine, earlier ones first on ties,
        and the cosines; those that share no term are left out."""
        reach = weights @ self.most[terms] + 1e-9
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] > 2e-9]
        self.dense[terms] = weights
        row, cosine, step, done = np.zeros(0, np.int64), np.zeros(0), 4, 0
        while done < len(order):
            # beyond the first blocks only those that can reach the k-th
            some = order[done : done + step]
            if len(row) == k:
                some = some[reach[some] >= cosine[-1]]
            if not len(some):
                break
            new_row, new = self._cosines(some)
            fits = (new > 0) & (new_row != but)
            row, cosine = np.concatenate([row, new_row[fits]]), np.concatenate([cosine, new[fits]])
            first = np.lexsort((row, -cosine))[:k]
            row, cosine = row[first], cosine[first]
            done, step = done + step, step * 4
        self.dense[terms] = 0
        return row, cosine

    def vote(self, row: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic weight, each example by the inverse of its distance."""
        near = 1 / (np.sqrt(np.maximum(2 - 2 * cosine, 0)) + 0.05)
        return float((near * self.toxic[row] / self.whole[row]).sum() / near.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve that fits ``y`` best over ``x``: pools of
    neighbours, at their mean ``x``."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """What a task needs to score vectors: the index, the meaning of its votes,
    and the score of texts without any term."""

    def __init__(self, index: Index | None, curve, empty: float):
        self.index, self.curve, self.empty = index, curve, empty

    def score(self, terms: np.ndarray, tf: np.ndarray) -> tuple[float, list[int]]:
        if self.index is None or not len(terms):
            return self.empty, []
        row, cosine = self.index.nearest(terms, self.index.unit(terms, tf))
        if not len(row):
            return self.empty, []
        score = float(np.interp(self.index.vote(row, cosine), *self.curve))
        return min(max(score, 0.0), 1.0), self.index.ids[row[:EVIDENCE]].tolist()


def _learned(examples: list[tuple], weights: dict[int, float], idf: np.ndarray) -> Model:
    """``examples`` are (doc_id, toxic, terms, tf)."""
    groups: dict[tuple[bytes, bytes], list] = {}
    toxic, whole = 0.0, 0.0
    for doc_id, kind, terms, tf in examples:
        w = weights[kind]
        if len(terms):
            group = groups.setdefault((terms.tobytes(), tf.tobytes()), [terms, tf, 0.0, 0.0, doc_id])
            group[2], group[3], group[4] = group[2] + w * kind, group[3] + w, min(group[4], doc_id)
        else:
            toxic, whole = toxic + w * kind, whole + w
    empty = (toxic + 0.1) / (whole + 1)
    if not groups:
        return Model(None, None, empty)
    parts = [groups[key] for key in sorted(groups)]
    index = Index([(g[0], g[1]) for g in parts], *(np.array([g[c] for g in parts]) for c in (2, 3, 4)), idf)
    votes, shares, mass = [], [], []
    for i in range(len(index.ids)):
        own = slice(index.at[i], index.at[i + 1])
        row, cosine = index.nearest(index.term[own], index.weight[own], but=i)
        if len(row):
            votes.append(index.vote(row, cosine))
            shares.append(index.toxic[i] / index.whole[i])
            mass.append(index.whole[i])
    if not votes:
        return Model(index, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), empty)
    # one example's weight between certain and unknown at either end
    x, y = np.array([0.0, *votes, 1.0]), np.array([0.0, *shares, 1.0])
    return Model(index, isotonic(x, y, np.array([1.0, *mass, 1.0])), empty)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, examples: int = EXAMPLES, terms: int = TERMS) -> DataFrame:
    """Scores of all ``docs`` (``doc_id``, ``text``) learned from ``labels``
    (``doc_id``, ``toxic``), but for rows where ``held_out`` (of ``doc_id``) is
    true: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5
    on) and ``evidence``, the ids of the nearest examples.

    At most about ``examples`` labelled rows of either kind are learned from,
    drawn by a hash of the id; each counts as many as it stands for. Terms are
    runs of digits, letters and everything outside ASCII, A-Z in lower case, and
    the first 3 to 6 characters of them. A null or empty text, or one without any
    of the chosen terms, gets the share of toxic examples among such. Rows with a
    null id are scored, never learned from, nor held out. Labels that are null are no
    labels; of several for one id the highest holds; of several texts for one id
    the first in order is learned from. Repeated rows get equal scores. Without
    labels, or with one kind only, all texts get one score. An empty table gives
    an empty result; other columns are ignored.
    """
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(~held)
    with scratch(docs.sparkSession):
        drawn, there = _sample(rows, known, examples)
        drawn = staged(drawn, "toxicity-drawn")
        sizes, size = {}, 0
        for r in drawn.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect():
            sizes[r.toxic], size = r.n, size + (r["size"] or 0)
        sample = drawn.repartition(1 + size // SAMPLE_BYTES, "doc_id")
        chosen = Terms(_chosen(sample, sizes, terms) if len(sizes) == 2 else [])
        shared = docs.sparkSession.sparkContext.broadcast(chosen)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chain.from_iterable(pieces(b, PIECE_BYTES) for b in batches):
                at, term, tf = shared.value.vectors(batch.column("text"))
                ids = batch.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                more = [batch.column("toxic").to_numpy()] if "toxic" in batch.schema.names else []
                blob = write_arrays([ids.fill_null(LAST).to_numpy(), missing, np.diff(at), term.astype(np.int32), tf, *more])
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["payload"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, df = 0, np.zeros(chosen.size, np.int64)
            for batch in batches:
                for payload in batch.column("payload"):
                    ids, _, _, term, *_ = read_arrays(payload.as_py())
                    n, df = n + len(ids), df + np.bincount(term, minlength=len(df))
            columns = [np.append(np.arange(len(df)), -1), np.append(df, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "df"])

        of_all = staged(mapped(rows, vectors, "payload binary"), "toxicity-vectors")
        df = np.zeros(chosen.size + 1, np.int64)
        for r in mapped(of_all, count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        idf = np.log((df[-1] + 2) / (df[:-1] + 1))
        # about 2 * examples rows with a few terms each
        found = [r.payload for r in mapped(drawn, vectors, "payload binary").collect()]
        weights = {k: there[k] / n for k, n in sizes.items()}
        model = docs.sparkSession.sparkContext.broadcast(_learned(_unpacked(found), weights, idf))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[bytes, bytes], tuple[float, list[int]]] = {}
            for batch in batches:
                for payload in batch.column("payload"):
                    ids, missing, sizes, term, tf = read_arrays(payload.as_py())
                    ends, scores = np.cumsum(sizes), []
                    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
                        key = term[lo:hi].tobytes(), tf[lo:hi].tobytes()
                        if key not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[key] = model.value.score(term[lo:hi], tf[lo:hi])
                        scores.append(seen[key])
                    columns = [pa.array(ids, mask=missing.astype(bool)), pa.array([s for s, _ in scores], pa.float64())]
                    columns.append(pa.array([e for _, e in scores], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, schema=SCORE_FIELDS)

        scored = staged(mapped(of_all, score, SCORES), "toxicity", keep=True)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted, "evidence")


def _unpacked(payloads: list[bytes]) -> list[tuple]:
    out = []
    for payload in payloads:
        ids, _, sizes, term, tf, toxic = read_arrays(payload)
        ends = np.cumsum(sizes)
        for i, (lo, hi) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            out.append((int(ids[i]), int(toxic[i]), term[lo:hi], tf[lo:hi]))
    return sorted(out, key=lambda x: x[0])

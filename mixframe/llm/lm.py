"""Scoring of texts by an n-gram model written as a weighted backoff automaton.

States are the histories seen in training (up to ``order - 1`` tokens). A state
has one arc per token seen after it, with the smoothed log-probability, and one
failure arc to the state of the next shorter history, with the weight that the
unseen tokens share. Probabilities are those of hierarchical Dirichlet
smoothing (MacKay and Peto): ``p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu)``,
ending in the add-one-half unigrams, so each state's distribution sums to one.

The whole automaton is never in one place. A block of documents fetches the
counts of just those n-grams that occur in it, builds that part of the
automaton, and walks it from left to right for all its documents side by side,
carrying one state per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import asked, bucket_count, packs, read_arrays, replied, staged, told
from .text import U64, mix, window_starts, windows, words

MU = (1000.0, 5.0)
BLOCK = 4 << 20
BEGIN, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)
FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")]
    + [(x, pa.float64()) for x in ("base_score", "score")]
)


class Ngrams:
    """The n-grams of a block. Each text is a begin mark, its words and an end."""

    def __init__(self, texts, order: int, bits: int = 64):
        found = words(texts, lower=True)
        low = U64((1 << (64 - bits)) - 1)
        counts = found.counts + 2
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tokens = np.empty(int(self.first[-1]), U64)
        inner = np.ones(len(self.tokens), bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        self.tokens[inner] = found.hash
        self.tokens[self.first[:-1]], self.tokens[self.first[1:] - 1] = BEGIN, END
        #: per order: distinct keys, and for each token the number of the n-gram that ends with it
        self.keys, self.at, self.number = [], [], []
        for k in range(1, order + 1):
            starts = window_starts(self.first, k)
            hashes = self.tokens if k == 1 else mix(windows(self.tokens, k)[starts] + U64(k)) & ~low
            keys, inverse = np.unique(hashes, return_inverse=True)
            number = np.full(len(self.tokens), -1, np.int32)
            number[starts + k - 1] = inverse
            del hashes, inverse, starts
            self.keys.append(keys)
            self.number.append(number)

    def train_counts(self, train: np.ndarray) -> list[np.ndarray]:
        learned = np.repeat(train, np.diff(self.first))
        return [
            np.bincount(number[learned & (number >= 0)], minlength=len(keys)).astype(np.uint32)
            for keys, number in zip(self.keys, self.number)
        ]


class Automaton:
    """The part of the automaton that a block needs. States are numbered: 0 is
    the empty history, then the seen n-grams of order 1, 2, ..."""

    def __init__(self, grams: Ngrams, counts: list[np.ndarray], mu, total: int, distinct: int):
        self.order = len(counts)
        norm = total + 0.5 * (distinct + 1)
        self.unknown = np.log10(0.5 / norm)
        self.base = np.log10((counts[0] + 0.5) / norm)
        shift = np.concatenate([[1], 1 + np.cumsum([len(c) for c in counts])])
        size = int(shift[-1])
        #: weight of the arc that ends in n-gram s, failure weight and failure state of s as a history
        self.weight, self.fail_weight, self.fail = np.zeros(size), np.zeros(size), np.zeros(size, np.int32)
        self.arc = []
        p_shorter = None
        for k, c in enumerate(counts):
            number, seen = grams.number[k], np.flatnonzero(grams.number[k] >= 0)
            spot = np.zeros(len(c), np.int32)
            spot[number[seen]] = seen
            if k == 0:
                p = (c + 0.5) / norm
            else:
                history = counts[k - 1][grams.number[k - 1][spot - 1]].astype(float)
                shorter = p_shorter[grams.number[k - 1][spot]]
                p = (c + mu[k - 1] * shorter) / (history + mu[k - 1])
                self.fail[shift[k] : shift[k + 1]] = shift[k - 1] + grams.number[k - 1][spot]
            part = slice(shift[k], shift[k + 1])
            self.weight[part] = np.log10(p)
            if k < self.order - 1:
                self.fail_weight[part] = np.log10(mu[k] / (c.astype(float) + mu[k]))
            arc = np.full(len(number), -1, np.int32)
            known = seen[c[number[seen]] > 0]
            arc[known] = shift[k] + number[known]
            self.arc.append(arc)
            p_shorter = p
        begins = grams.first[:-1]
        self.begin = np.maximum(self.arc[0][begins], 0) if self.order > 1 else np.zeros(len(begins), np.int32)
        self.depth = np.repeat(np.arange(self.order + 1, dtype=np.int8), [1, *[len(c) for c in counts]])

    def walk(self, first: np.ndarray) -> np.ndarray:
        """Log-probability of each text: one traversal from left to right."""
        length = np.diff(first) - 1
        by_length = np.argsort(-length, kind="stable")
        total, state = np.zeros(len(length)), self.begin.copy()
        arcs = np.stack(self.arc)
        for step in range(int(length.max(initial=0))):
            running = by_length[: np.searchsorted(-length[by_length], -step)]
            at, now, gained = first[running] + 1 + step, state[running], np.zeros(len(running))
            taken = arcs[self.depth[now], at]
            while True:
                stuck = np.flatnonzero((taken < 0) & (now > 0))
                if not len(stuck):
                    break
                gained[stuck] += self.fail_weight[now[stuck]]
                now[stuck] = self.fail[now[stuck]]
                taken[stuck] = arcs[self.depth[now[stuck]], at[stuck]]
            # at the empty history an unseen token has the share of all unknown ones
            total[running] += gained + np.where(taken >= 0, self.weight[taken], self.unknown)
            after = np.maximum(taken, 0)
            state[running] = np.where(self.depth[after] == self.order, self.fail[after], after)
        return total


def score_texts(docs: DataFrame, held_out: Column, order: int = 3, mu: tuple[float, ...] = MU) -> DataFrame:
    """Score every text of ``docs`` (``doc_id``, ``text``) by a model of order
    ``order`` that learns from the rows where ``held_out`` is not true.

    Words are separated by white space, A-Z in lower case; each text ends with
    one end token. Returns ``doc_id``, ``held_out``, ``n_tokens`` (with the end
    token), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (add-one-half unigrams) and ``score`` (the automaton), both
    log10. A null text counts as empty and scores its end token; a null
    ``held_out`` counts as false. Repeated rows are repeated in the result and
    learned from each time. An empty table gives an empty result. With nothing
    to learn from, all tokens share the unknown weight. Other columns are
    ignored.

    ``mu[k]`` is the smoothing weight of histories of ``k + 1`` tokens. Tokens
    are told apart by 64-bit hashes, longer n-grams by as many bits as keep the
    expected number of mistaken pairs in the whole corpus below one, 64 at most.
    """
    if order < 1 or len(mu) < order - 1 or min(mu, default=1) <= 0:
        raise ValueError("order >= 1 and a positive mu for each history length are needed")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    packed = packs(rows, "lm-blocks", BLOCK)
    total_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(64, -(-max(40, 2 * total_bytes.bit_length() - 4) // 8) * 8)

    def question(table: pa.Table, block: int) -> list[list[np.ndarray]]:
        grams = Ngrams(table.column("text"), order, bits)
        train = ~table.column("held_out").to_numpy().astype(bool)
        return [list(x) for x in zip(grams.keys, grams.train_counts(train))]

    def answer(questions, blocks):
        replies = [[] for _ in blocks]
        for k in range(order):
            keys = np.concatenate([q[2 * k] for q in questions])
            counts = np.concatenate([q[2 * k + 1] for q in questions])
            distinct, inverse = np.unique(keys, return_inverse=True)
            sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
            if k == 0:
                learned = sums[distinct != BEGIN]
                replies.append([np.array([learned.sum(), (learned > 0).sum()], np.int64)])
            ends = np.cumsum([len(q[2 * k]) for q in questions])[:-1]
            kind = np.uint32 if sums.max(initial=0) < 1 << 32 else np.int64
            for reply, part in zip(replies, np.split(sums[inverse].astype(kind), ends)):
                reply.append(part)
        return replies

    replies = staged(replied(asked(packed, bucket_count(packed), question), answer), "lm-counts")
    total, distinct = _totals(replies)

    def use(table: pa.Table, block: int, counts: list[np.ndarray]) -> pa.Table:
        grams = Ngrams(table.column("text"), order, bits)
        made = Automaton(grams, counts, mu, total, distinct)
        inner = np.ones(len(grams.tokens), bool)
        inner[grams.first[:-1]] = False
        base = np.where(inner, made.base[grams.number[0]], 0.0)
        known = inner & (counts[0][grams.number[0]] > 0)
        columns = [
            table.column("doc_id"),
            table.column("held_out"),
            pa.array(np.diff(grams.first) - 1),
            pa.array(np.add.reduceat(known.astype(np.int64), grams.first[:-1])),
            pa.array(np.full(len(table), total)),
            pa.array(np.add.reduceat(base, grams.first[:-1])),
            pa.array(made.walk(grams.first)),
        ]
        return pa.Table.from_arrays(columns, schema=FIELDS)

    return told(packed, replies.where("block >= 0"), use, SCHEMA)


def _totals(replies: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts, summed over the buckets."""

    def add(batches):
        for batch in batches:
            sums = [read_arrays(x.as_py())[0] for x in batch.column("blob")]
            yield pa.RecordBatch.from_pydict({"n": [int(x[0]) for x in sums], "v": [int(x[1]) for x in sums]})

    sums = replies.where("block = -1").select("blob").mapInArrow(add, "n bigint, v bigint")
    row = sums.agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)

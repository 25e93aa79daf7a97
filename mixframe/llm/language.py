"""Language identification: multinomial naive Bayes over hashed character
n-grams. Counts are gathered by language, the matrix of log-probabilities
(hash buckets by languages, at most ``LANGUAGES`` of them) is broadcast, and
documents are scored in batches by NumPy without leaving their partition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mapped, staged
from .text import mix, pieces, raw

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Languages of one model (26 MB), and models that follow one another before a table is written.
LANGUAGES, CHAIN = 200, 4
#: Labelled rows of each language to learn from, about.
TRAIN_ROWS = 20_000
#: Rows of each language that tell what is usual, about, and how far below it a text may be.
USUAL_ROWS, MARGIN, DEVIATIONS = 2_000, 4.0, 6.0
PIECE, PIECE_BYTES = 1 << 17, 1 << 20


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _grams(texts):
    """For each size the hash buckets of the n-grams of all texts, and where
    those of each text begin. Runs of characters that are no letters count as
    one blank; each text stands between blanks."""
    data, offset = raw(texts)
    is_start = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum(is_start)])[offset]
    n = len(first) - 1
    # a blank before each text and one after the last
    chars = np.zeros(len(points) + n + 1, np.uint64)
    place = np.arange(len(points)) + 1 + np.repeat(np.arange(n), np.diff(first))
    chars[place] = _letters()[points]
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
    edge = first + np.arange(n + 1)
    keep[edge] = True
    # blanks at the end of a text give way to the one after it
    kept = np.flatnonzero(keep)
    keep[np.setdiff1d(kept[:-1][(chars[kept[:-1]] == 0) & (chars[kept[1:]] == 0)], edge)] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    begins, chars = kept_before[edge], chars[keep]
    for size in SIZES:
        m = len(chars) - size + 1
        if m <= 0 or not n:
            continue
        code, blank = np.zeros(m, np.uint64), np.ones(m, bool)
        for k in range(size):
            code = code * np.uint64(0x110001) + chars[k : k + m] + np.uint64(1)
            blank &= chars[k : k + m] == 0
        # an n-gram may end on the blank after its text, and not go beyond
        last = np.repeat(begins[1:], np.diff(begins))[:m]
        inside = ~blank[: len(last)] & (np.arange(len(last)) + size - 1 <= last)
        hashes = (mix(code[: len(last)][inside] + np.uint64(size)) >> np.uint64(49)).astype(np.int32)
        yield hashes, np.concatenate([[0], np.cumsum(inside)])[np.minimum(begins, len(last))]


class Model:
    """A block of languages, their priors, the matrix of log-probabilities, and
    what texts of each usually reach: mean and variance of the average
    log-probability of an n-gram, and the variance of that of one n-gram."""

    def __init__(self, languages: list[str], rows: np.ndarray, total: float, counts: np.ndarray, alpha: float):
        self.languages = np.array(languages, object)
        self.prior = np.log(rows / max(total, 1))
        smooth = counts + alpha
        self.totals = smooth.sum(axis=1)
        self.matrix = np.ascontiguousarray(np.log(smooth / self.totals[:, None]).T, np.float32)
        self.usual = np.tile([0.0, np.inf, np.inf], (len(languages), 1))

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text by language, and its number of n-grams."""
        n = len(texts)
        sums, grams = np.tile(self.prior, (n, 1)), np.zeros(n, np.int64)
        for h, starts in _grams(texts):
            grams += np.diff(starts)
            for lo in range(0, len(h), PIECE):
                part = self.matrix[h[lo : lo + PIECE]].astype(np.float64)
                cut = np.clip(starts, lo, lo + len(part)) - lo
                some = np.flatnonzero(cut[1:] > cut[:-1])
                sums[some] += np.add.reduceat(part, cut[some], axis=0)
        return sums, grams

    def usually(self, best: np.ndarray, top: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Whether a text is about as probable in its best language as others in it."""
        mean, spread, single = self.usual[best].T
        many = np.maximum(grams, 1)
        # n-grams that share letters are not independent: three sizes over each letter
        slack = np.maximum(MARGIN, DEVIATIONS * np.sqrt(spread + len(SIZES) * single / many))
        return (top - self.prior[best]) / many >= mean - slack

    def own(self, text, k: int, alpha: float) -> tuple[int, float, float]:
        """N-grams of one text of the sample, and the mean and variance of their
        log-probabilities in language ``k`` without this text itself."""
        h = np.concatenate([np.zeros(0, np.int32)] + [g for g, _ in _grams(text)])
        if not len(h):
            return 0, 0.0, 0.0
        bucket, c = np.unique(h, return_counts=True)
        smooth = np.exp(self.matrix[bucket, k].astype(np.float64)) * self.totals[k]
        logs = np.log(np.maximum(smooth - c, alpha)) - np.log(max(self.totals[k] - len(h), alpha * BUCKETS))
        mean = float((logs * c).sum() / len(h))
        return len(h), mean, float((((logs - mean) ** 2) * c).sum() / len(h))


def _drawn(known: DataFrame, sizes: dict[str, int], rows: int) -> DataFrame:
    """About ``rows`` rows of each language by a hash of id and text; fewer are among more."""
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.where(draw < limit[F.col("lang")])


def _counts(chosen: DataFrame, languages: list[str]) -> np.ndarray:
    place = {x: k for k, x in enumerate(languages)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                own = np.array([place[x] for x in piece.column("lang").to_pylist()])
                for h, starts in _grams(piece.column("text")):
                    lang = np.repeat(own, np.diff(starts))
                    for k in np.unique(lang):
                        part = np.bincount(h[lang == k], minlength=BUCKETS)
                        sums[k] = sums[k] + part if k in sums else part
        some = sorted(sums)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(some, pa.int32()), "counts": pa.array([sums[k].tobytes() for k in some], pa.binary())}
        )

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(BUCKETS, np.int64)
        for x in table.column("counts"):
            sums += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([sums.tobytes()], pa.binary())})

    counts = np.zeros((len(languages), BUCKETS), np.int64)
    parts = mapped(chosen.select("lang", "text"), count, "lang int, counts binary")
    for r in parts.groupBy("lang").applyInArrow(add, "lang int, counts binary").collect():
        counts[r["lang"]] = np.frombuffer(r["counts"], np.int64)
    return counts


def _usual(chosen: DataFrame, model: Model, alpha: float) -> np.ndarray:
    """What ``Model.usual`` holds, from texts of the sample."""
    place = {x: k for k, x in enumerate(model.languages)}
    held = chosen.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        out = []
        for batch in batches:
            texts = batch.column("text")
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                n, mean, var = held.value.own(texts.slice(i, 1), place[lang], alpha)
                if n:
                    out.append((place[lang], 1, mean, mean * mean, var))
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["lang", "n", "mean", "square", "single"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = mapped(chosen.select("lang", "text"), measure, "lang int, n bigint, mean double, square double, single double")
    usual = model.usual.copy()
    for r in rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "mean", "square", "single")]).collect():
        mean = r["mean"] / r["n"]
        usual[r["lang"]] = mean, max(r["square"] / r["n"] - mean**2, 0.0), r["single"] / r["n"]
    return usual


def models(docs: DataFrame, train_rows: int = TRAIN_ROWS, alpha: float = 0.5, usual_rows: int = 0) -> Iterator[tuple[Model, bool]]:
    """Learn from ``doc_id``, ``text`` and ``lang`` of ``docs``: one model for
    each ``LANGUAGES`` languages, and whether it is the last. Where a language
    has more than ``train_rows`` rows, about that many are drawn by a hash of
    their id and text. ``usual_rows`` of them tell what is usual, if asked for."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    left, total = sizes, None
    while True:
        rows = left.orderBy("lang").limit(LANGUAGES + 1).collect()
        block, last = {r["lang"]: r["n"] for r in rows[:LANGUAGES]}, len(rows) <= LANGUAGES
        if not block:
            return
        if total is None:
            total = sum(block.values()) if last else sizes.agg(F.sum("n")).first()[0]
        counts = _counts(_drawn(known, block, train_rows), list(block))
        model = Model(list(block), np.array(list(block.values()), float), total, counts, alpha)
        if usual_rows:
            model.usual = _usual(_drawn(known, block, min(usual_rows, train_rows)), model, alpha)
        yield model, last
        if last:
            return
        left = sizes.where(F.col("lang") > rows[LANGUAGES - 1]["lang"])


def _answered(docs: DataFrame, learned: Iterator[tuple[Model, bool]], keep_text: bool) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, whose names are returned: log-probability
    in the best language, the sum over all languages relative to it, the language
    (null without letters) and whether the text is usual in it. Blocks of
    languages follow one another in the same tasks, without an exchange."""
    # longer than any name there is
    state = [("_" * max(len(c) for c in docs.columns)) + c for c in ("_top", "_total", "_name", "_usual")]
    types = (T.DoubleType(), T.DoubleType(), T.StringType(), T.BooleanType())
    out = docs
    for number, (model, last) in enumerate(learned, 1):
        names = [c for c in docs.columns if keep_text or not last or c != "text"]
        schema = T.StructType([out.schema[c] for c in names] + [T.StructField(c, t) for c, t in zip(state, types)])
        held = docs.sparkSession.sparkContext.broadcast(model)

        def step(batches, held=held, names=names, first=number == 1):
            for batch in batches:
                for piece in pieces(batch, PIECE_BYTES):
                    sums, grams = held.value.sums(piece.column("text"))
                    best = sums.argmax(axis=1)
                    top = sums[np.arange(len(best)), best]
                    total = np.exp(sums - top[:, None]).sum(axis=1)
                    name, usual = held.value.languages[best], held.value.usually(best, top, grams)
                    if not first:
                        was = [piece.column(c).to_numpy(zero_copy_only=False) for c in state]
                        new = np.maximum(top, was[0])
                        total = total * np.exp(top - new) + was[1] * np.exp(was[0] - new)
                        ahead = top > was[0]
                        top, name, usual = new, np.where(ahead, name, was[2]), np.where(ahead, usual, was[3].astype(bool))
                    name = pa.array([x if g else None for x, g in zip(name, grams)], pa.string())
                    found = [pa.array(top), pa.array(total), name, pa.array(usual.astype(bool))]
                    yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + found, names=names + state)

        out = mapped(out, step, schema)
        if number % CHAIN == 0 and not last:
            out = staged(out, "languages")
    if out is docs:
        out = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(state, types)])
    return out, state


def identify(docs: DataFrame, held_out: Column, train_rows: int = TRAIN_ROWS, alpha: float = 0.5) -> DataFrame:
    """Predict the language of every text of ``docs`` (``doc_id``, ``text``,
    ``lang``) by a model fitted on the rows where ``held_out`` is not true.

    Returns ``doc_id``, ``held_out``, ``lang_pred`` and ``score``, the
    probability of that language. A text that is null or has no letter is
    ``und`` with score 0, as is every text if there is nothing to learn from.
    Rows without a ``lang`` are predicted and not learned from; a null
    ``held_out`` counts as false. Ties go to the language that comes first.
    Repeated rows stay; an empty table gives an empty result; other columns are
    ignored. Any number of languages: a model holds ``LANGUAGES`` of them, and
    each further one is another step over the texts.
    """
    flagged = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        "lang",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    learned = models(flagged.where("NOT held_out"), train_rows, alpha)
    out, (_, total, name, _) = _answered(flagged.select("doc_id", "held_out", "text"), learned, keep_text=False)
    score = F.when(F.col(name).isNull(), 0.0).otherwise(1 / F.col(total))
    return out.select("doc_id", "held_out", F.coalesce(name, F.lit("und")).alias("lang_pred"), score.alias("score"))


def recognised(docs: DataFrame, least_score: float = 0.5, train_rows: int = TRAIN_ROWS, alpha: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a language that is recognised with a probability
    of ``least_score`` or more, and whose text is usual in it: the average
    log-probability of its n-grams is not below the mean of texts of that
    language by more than ``MARGIN`` and ``DEVIATIONS`` standard deviations,
    which are wide where a text is short. The model learns from ``docs`` itself,
    and what is usual from ``USUAL_ROWS`` rows of a language, each without its
    own counts. Rows whose text is null or has no letter go."""
    out, (_, total, name, usual) = _answered(docs, models(docs, train_rows, alpha, USUAL_ROWS), keep_text=True)
    kept = F.col(name).isNotNull() & (1 / F.col(total) >= least_score) & F.col(usual)
    return out.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])

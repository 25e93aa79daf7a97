"""Hard negatives by pruning over sorted coordinates.

Rows are ordered by length and cut into buckets of similar length. A bucket
keeps, for each coordinate of its unit vectors, the values in ascending order.
An anchor that needs an inner product of at least t looks only at buckets that
are long enough for it; there, on the coordinates where the anchor itself is
largest, the angle that t allows bounds the values a partner can have. These
ranges are found by binary search, the rows that lie in all of them are
candidates, and their exact products decide. The anchors are a fixed share of
the rows; they go out in groups of bounded size, and each group passes over all
rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mapped, scratch, staged

#: Anchors of a group, rows of a bucket, coordinates an anchor looks at.
ANCHORS, BUCKET, FOCUS = 8192, 2048, 4
#: Anchors whose products with a bucket are held together.
TILE = 256
EVERY, RELABEL = 50, 7
POSITIVES, NEGATIVES = 5, 3
#: Below it products, and 95 times them, are exact in a double.
EXACT = 2.0**46
#: More than what angles and their cosines lose to rounding.
SLACK = 1e-7

POSITIVE = "anchor bigint, slot int, row bigint, vec_id bigint, score bigint"


def numbered(vectors: DataFrame) -> DataFrame:
    """The rows that take part: ``row`` (a number of its own), ``vec_id``,
    ``label`` (every seventh one shifted), ``v`` (integers) and ``norm2``."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(finite)
    v = F.transform("x", lambda a: F.floor(a * F.lit(256.0)).cast("double"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        F.expr(f"if(vec_id % {RELABEL} = 0, (label + 1) % 10, label)").alias("label"),
        v.alias("v"),
    ).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), width))
    if ends.sum():
        row = np.repeat(np.arange(len(column)), ends)
        out[row, np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)] = column.flatten().to_numpy()
    return out


class Bucket:
    """Rows of similar length, with their unit vectors in order of each coordinate."""

    def __init__(self, row, vec_id, label, v: np.ndarray):
        self.row, self.vec_id, self.label, self.v = row, vec_id, label, v
        norms = np.sqrt((v * v).sum(axis=1))
        self.longest = float(norms.max(initial=0))
        unit = v / np.where(norms > 0, norms, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, norms: np.ndarray, need: np.ndarray, focus: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Anchors that the bucket may serve, and which of its rows each of them
        must look at; None if all. ``need`` is the least product that counts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = need / (norms * self.longest)
        cosine = np.where(need <= 0, -1.0, np.where(norms * self.longest > 0, cosine, np.inf)) - SLACK
        some = np.flatnonzero(cosine <= 1)
        angle = np.arccos(np.clip(cosine[some], -1, 1))
        unit = q[some] / np.where(norms[some] > 0, norms[some], 1)[:, None]
        focus = min(focus, unit.shape[1])
        # without a positive need a row of length 0 may still count
        free = (angle >= np.pi - 1e-6) | (norms[some] == 0)
        if not len(some) or not focus or free.all():
            return some, None
        of_each = np.argpartition(-np.abs(unit), focus - 1, axis=1)[:, :focus]
        counts = np.zeros((len(some), len(self.row)), np.uint8)
        narrow = np.zeros(len(some), bool)
        for k in range(focus):
            f = of_each[:, k]
            own = np.arccos(np.clip(unit[np.arange(len(some)), f], -1, 1))
            low = np.cos(np.minimum(own + angle, np.pi)) - SLACK
            high = np.cos(np.maximum(own - angle, 0)) + SLACK
            for c in np.unique(f):
                mine = np.flatnonzero(f == c)
                lo = np.searchsorted(self.sorted[:, c], low[mine])
                hi = np.searchsorted(self.sorted[:, c], high[mine], "right")
                for a, i, j in zip(mine.tolist(), lo.tolist(), hi.tolist()):
                    if free[a] or (i == 0 and j == len(self.row)):
                        counts[a] += 1
                    else:
                        counts[a, self.order[i:j, c]] += 1
                        narrow[a] = True
        return some, (counts == focus) if narrow.any() else None

    def products(self, q: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Exact products of anchors and candidates, -inf for other rows."""
        if mask is None or mask.mean() > 0.25:
            out = q @ self.v.T
        else:
            out = np.zeros((len(q), len(self.row)))
            for a, row in enumerate(mask):
                at = np.flatnonzero(row)
                out[a, at] = self.v[at] @ q[a]
        if mask is not None:
            out[~mask] = -np.inf
        return out


class Best:
    """Per line the ``k`` best rows so far: highest score, then smallest ``vec_id``."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.score = np.full((lines, k), -np.inf)
        self.vec_id, self.row = (np.full((lines, k), np.iinfo(np.int64).max) for _ in range(2))

    @property
    def floor(self) -> np.ndarray:
        """The score that another row must reach, equal or higher."""
        return self.score[:, -1]

    def add(self, lines: np.ndarray, hit: np.ndarray, score: np.ndarray, bucket: Bucket) -> None:
        """``hit``: (line, row) pairs that count, of ``score``."""
        line, at = np.nonzero(hit & (score >= self.floor[lines][:, None]))
        if not len(line):
            return
        value, vec_id, row = score[line, at], bucket.vec_id[at], bucket.row[at]
        order = np.lexsort((row, vec_id, -value, line))
        line = line[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        first = place < self.k
        order, line, place = order[first], line[first], place[first]
        touched, own = np.unique(line, return_inverse=True)
        merged = []
        for old, new, empty in ((self.score, value, -np.inf), (self.vec_id, vec_id, np.iinfo(np.int64).max), (self.row, row, np.iinfo(np.int64).max)):
            both = np.full((len(touched), 2 * self.k), empty, old.dtype)
            both[:, : self.k] = old[lines[touched]]
            both[own, self.k + place] = new[order]
            merged.append(both)
        value, vec_id, row = merged
        best = np.lexsort((row, vec_id, -value), axis=1)[:, : self.k]
        for old, both in ((self.score, value), (self.vec_id, vec_id), (self.row, row)):
            old[lines[touched]] = np.take_along_axis(both, best, axis=1)


def _buckets(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[Bucket]:
    """Buckets of a task, whose rows come in ascending length."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == size:
                yield _bucket(held, width)
                held, n = [], 0
    if held:
        yield _bucket(held, width)


def _bucket(held: list[pa.RecordBatch], width: int) -> Bucket:
    table = pa.Table.from_batches(held)
    columns = [table.column(c).to_numpy() for c in ("row", "vec_id", "label")]
    return Bucket(*columns, matrix(table.column("v"), width))


def _scan(rows: DataFrame, group: dict, width: int, targets: np.ndarray | None, bucket: int, focus: int) -> DataFrame:
    """One pass of a group of anchors over all rows. Without ``targets`` the
    best rows of the anchor's label; with them, per anchor and target, the best
    rows of other labels between half and 95 percent of the target."""
    k, slots = (POSITIVES, 1) if targets is None else (NEGATIVES, targets.shape[1])
    shared = rows.sparkSession.sparkContext.broadcast({**group, "targets": targets})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        q, norms, goal = g["v"], g["norm"], g["targets"]
        best = [Best(len(q), k) for _ in range(slots)]
        if goal is not None:  # whole products: half of the target, rounded up, to 95 percent, rounded down
            low, high = np.ceil(goal / 2), np.floor(goal * 95 / 100)
        for part in _buckets(batches, width, bucket):
            for lo in range(0, len(q), TILE):
                tile = np.arange(lo, min(lo + TILE, len(q)))
                if goal is None:
                    need = best[0].floor[tile]
                else:
                    each = [np.where(high[tile, s] >= low[tile, s], np.maximum(b.floor[tile], low[tile, s]), np.inf) for s, b in enumerate(best)]
                    need = np.min(each, axis=0)
                some, mask = part.candidates(q[tile], norms[tile], need, focus)
                if not len(some):
                    continue
                lines = tile[some]
                score = part.products(q[lines], mask)
                same = g["label"][lines][:, None] == part.label
                if goal is None:
                    best[0].add(lines, same & (g["row"][lines][:, None] != part.row), score, part)
                    continue
                for s, b in enumerate(best):
                    hit = ~same & (score >= low[lines, s][:, None]) & (score <= high[lines, s][:, None])
                    b.add(lines, hit, score, part)
        for s, b in enumerate(best):
            line, place = np.nonzero(np.isfinite(b.score))
            columns = [g["row"][line], np.full(len(line), s, np.int32), b.row[line, place], b.vec_id[line, place]]
            columns.append(b.score[line, place].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "row", "vec_id", "score"])

    found = mapped(rows.select("row", "vec_id", "label", "v"), scan, POSITIVE)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, group_size: int = ANCHORS, bucket: int = BUCKET, focus: int = FOCUS) -> DataFrame:
    """Hard negatives of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Anchors are the rows whose ``vec_id`` is divisible by 50. Components count as
    floor(256 x), scores are inner products, equal ones go by smaller
    ``vec_id``; where ``vec_id`` is divisible by 7 the label first becomes
    (label + 1) % 10. Positives of an anchor are its first 5 other rows of the
    same label; for each, negatives are the first 3 rows of another label whose
    score lies between 50 and 95 percent of the positive's. Returns
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    Rows with a null id, label, vector or component, or one that is not finite,
    take no part. Vectors shorter than the longest end in zeros. Rows that are
    repeated are rows of their own: the anchor's twin can be its positive, and an
    anchor that stands twice is answered twice. A positive whose score is not
    above 0 has only negatives of score 0, and none below. Vectors so long that
    a product may not fit a double exactly are refused. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = []
    with scratch(spark):
        base = staged(numbered(vectors), "negatives-base")
        n, width, longest = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm2")).first()
        if longest is not None and longest >= EXACT:
            raise ValueError("vectors are too long for exact products")
        # by length; equal lengths are spread by the row's number
        tasks = max(spark.sparkContext.defaultParallelism, -(-n * max(width or 0, 1) // (4 << 20)))
        rows = staged(base.repartitionByRange(tasks, "norm2", "row").sortWithinPartitions("norm2", "row"), "negatives-rows")
        anchors = base.where(F.col("vec_id") % EVERY == 0)
        n_groups = 1 + anchors.count() // group_size
        of = F.pmod(F.xxhash64("row"), F.lit(n_groups))
        for g in range(n_groups):
            # about group_size rows, and as many products to hold in a task
            chosen = anchors.where(of == g).select("row", "vec_id", "label", "v").toArrow()
            v = matrix(chosen.column("v"), width or 0)
            group = {"row": chosen.column("row").to_numpy(), "label": chosen.column("label").to_numpy()}
            group |= {"v": v, "norm": np.sqrt((v * v).sum(axis=1))}
            positives = staged(_scan(rows, group, width or 0, None, bucket, focus), "negatives-positives")
            # at most POSITIVES rows for each anchor of the group
            known = positives.select("anchor", "place", "score").toArrow()
            targets = np.full((len(v), POSITIVES), -1.0)
            line = np.argsort(group["row"])
            at = line[np.searchsorted(group["row"][line], known.column("anchor").to_numpy())]
            targets[at, known.column("place").to_numpy() - 1] = known.column("score").to_numpy()
            found = _scan(rows, group, width or 0, targets, bucket, focus)
            named = F.broadcast(anchors.where(of == g).selectExpr("row AS anchor", "vec_id AS anchor_id"))
            pairs = positives.selectExpr("anchor", "place - 1 AS slot", "vec_id AS positive_id", "score AS positive_score")
            answer = (
                found.selectExpr("anchor", "slot", "place AS rank", "vec_id AS negative_id", "score AS negative_score")
                .join(pairs, ["anchor", "slot"])
                .join(named, "anchor")
            )
            columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            parts.append(staged(answer.select(columns), "negatives", keep=True))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out

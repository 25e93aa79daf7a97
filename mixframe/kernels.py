"""Arrow batch kernels: every point against every member of a small model.

A join would write one row per point and member only to sum or minimise them
again. Here a task keeps its batch of coordinates, loops over the members with
NumPy, and hands back per-partition partial results (sums, farthest points) or
one row per point (nearest members). Only the dimension columns cross into
Python, and the model rides in the closure (bounded by ``bounded_rows``).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle

# Ship this module's functions by value: workers need NumPy and PyArrow only,
# not a copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Points per NumPy step: a handful of such columns stays in a core's cache.
STEP = 16_384

Batches = Iterator[pa.RecordBatch]


def _columns(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _coordinates(batch: pa.RecordBatch, dims):
    """Lists of coordinate columns: those of the batch, or of each block in it."""
    if "block" not in batch.schema.names:
        yield _columns(batch, dims)
        return
    for blob in batch.column("block"):
        yield list(np.frombuffer(blob.as_buffer(), np.float64).reshape(len(dims), -1))


def pack(dims) -> Callable[[Batches], Batches]:
    """Blocks of coordinates, dimension after dimension: a pass that reads a
    block has its columns without a conversion per row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                block = np.stack(_columns(batch, dims)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    return run


def _steps(columns: list[np.ndarray]):
    for start in range(0, len(columns[0]), STEP):
        yield [c[start : start + STEP] for c in columns]


def _sq_distance(xs, centre, spread) -> np.ndarray:
    total = None
    for x, c, s in zip(xs, centre, spread):
        part = (x - c) / s
        part *= part
        total = part if total is None else total + part
    return total


#: Bits of a limb of an exact sum, and of the fraction of an exponent.
LIMB, FRACTION = 32, 40
NEVER = -(1 << 40)


def kernel_sums(dims, centres: np.ndarray, spreads: np.ndarray) -> Callable[[Batches], Batches]:
    """Per partition one row, key 0: for every member the exact sum over points
    of exp(-distance / 2) / sqrt(product of spreads), as ``grid, high, low``.

    Terms are powers of two with a rounded exponent, and what counts of them are
    64 bits in two limbs on a grid of powers of 2**32, ``high`` in units of
    2**grid and ``low`` of 2**(grid - 32). The grid follows the largest term;
    limbs below are left out. So the sum is one of integers, the same however
    the points are dealt out, and no term is too small or too large for it."""
    log_norms = -0.5 * np.log2(spreads).sum(axis=1)
    # (x - c) * half squares to half the scaled distance, in bits
    half = np.sqrt(0.5 / np.log(2)) / spreads

    def run(batches: Batches) -> Batches:
        sums = np.zeros((len(centres), 3), np.int64)
        sums[:, 0] = NEVER
        with np.errstate(over="ignore"):
            for columns in (c for batch in batches for c in _coordinates(batch, dims)):
                for xs in _steps(columns):
                    exponent, part = np.empty(len(xs[0])), np.empty(len(xs[0]))
                    for j in range(len(centres)):
                        exponent.fill(log_norms[j])
                        for k, x in enumerate(xs):
                            np.subtract(x, centres[j, k], out=part)
                            part *= half[j, k]
                            part *= part
                            exponent -= part
                        _add_powers(sums[j], exponent, part)
        yield from limb_rows(sums)

    return run


def _add_powers(total: np.ndarray, exponent: np.ndarray, part: np.ndarray) -> None:
    """Add 2**exponent to ``grid, high, low``; both arrays are used up."""
    exponent *= 2.0**FRACTION
    np.rint(exponent, out=exponent)
    exponent *= 2.0**-FRACTION
    top = exponent.max(initial=-np.inf)
    if top == -np.inf:
        return
    _raise_grid(total, LIMB * int(top // LIMB))
    exponent -= total[0]
    np.exp2(exponent, out=exponent)
    np.floor(exponent, out=part)
    exponent -= part
    exponent *= 2.0**LIMB
    np.floor(exponent, out=exponent)
    # sums of integers, exact in doubles
    total[1] += int(part.sum())
    total[2] += int(exponent.sum())


def _raise_grid(total, grid: int) -> None:
    if grid > total[0]:
        total[2] = total[1] if grid == total[0] + LIMB else 0
        total[0], total[1] = grid, 0


def joined_limbs(rows) -> list[list[int]]:
    """``grid, high, low`` of every member over several rows of them."""
    out: list[list[int]] = []
    for row in rows:
        new = [list(map(int, x)) for x in np.asarray(row, object).reshape(-1, 3)]
        if not out:
            out = new
            continue
        for a, b in zip(out, new):
            if b[0] > a[0]:
                _raise_grid(a, b[0])
            elif a[0] > b[0]:
                _raise_grid(b, a[0])
            a[1], a[2] = a[1] + b[1], a[2] + b[2]
    return out


def limb_rows(sums) -> Batches:
    flat = np.asarray(sums, np.int64).ravel()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], names=["key", "sums"])


def merge_limbs(batches: Batches) -> Batches:
    """Rows of ``kernel_sums`` that share a partition, as one."""
    rows = [v.values.to_numpy() for batch in batches for v in batch.column("sums")]
    if rows:
        yield from limb_rows(joined_limbs(rows))


# --- within a run: nearest members, children, survivors -------------------------

#: Members of a leaf of the search tree.
LEAF = 256


class SearchTree:
    """Boxes around members, halved along their widest side, to find the
    nearest ones in scaled distance. The scale is that of the place asked for,
    or with ``spreads`` that of each member. Ties go to the earlier member."""

    def __init__(self, centres: np.ndarray, spreads: np.ndarray | None = None):
        self.centres, self.spreads = centres, spreads
        self.root = self._node(np.arange(len(centres)))

    def _node(self, members: np.ndarray):
        at = self.centres[members]
        box = at.min(axis=0), at.max(axis=0), None if self.spreads is None else self.spreads[members].max(axis=0)
        if len(members) <= LEAF:
            return box, members, None
        widest = int(np.argmax(box[1] - box[0]))
        order = members[np.argsort(at[:, widest], kind="stable")]
        half = len(order) // 2
        return box, None, (self._node(np.sort(order[:half])), self._node(np.sort(order[half:])))

    def nearest(self, places: np.ndarray, scales: np.ndarray | None, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and squared distances of the ``m`` nearest members of each
        place, closest first; position -1 where there are fewer."""
        at, gap = np.full((len(places), m), -1), np.full((len(places), m), np.inf)
        if len(places) and len(self.centres):
            self._visit(self.root, np.arange(len(places)), places, scales, at, gap)
        return at, gap

    def _reach(self, box, rows, places, scales) -> np.ndarray:
        """A distance that no member of the box is nearer than."""
        low, high, widest = box
        total = np.zeros(len(rows))
        for k in range(places.shape[1]):
            x = places[rows, k]
            part = np.maximum(np.maximum(low[k] - x, x - high[k]), 0) / (widest[k] if scales is None else scales[rows, k])
            total = total + part * part
        return total

    def _visit(self, node, rows, places, scales, at, gap) -> None:
        box, members, halves = node
        rows = rows[self._reach(box, rows, places, scales) <= gap[rows, -1]]
        if not len(rows):
            return
        if halves is not None:
            first = self._reach(halves[0][0], rows, places, scales) <= self._reach(halves[1][0], rows, places, scales)
            for near, some in ((0, rows[first]), (1, rows[~first])):
                if len(some):
                    self._visit(halves[near], some, places, scales, at, gap)
                    self._visit(halves[1 - near], some, places, scales, at, gap)
            return
        size = max(1, (1 << 20) // len(members))
        for lo in range(0, len(rows), size):
            some = rows[lo : lo + size]
            total = np.zeros((len(some), len(members)))
            for k in range(places.shape[1]):
                scale = self.spreads[members, k] if scales is None else scales[some, k][:, None]
                part = (places[some, k][:, None] - self.centres[members, k]) / scale
                total += part * part
            both = np.concatenate([gap[some], total], axis=1)
            who = np.concatenate([at[some], np.broadcast_to(members, total.shape)], axis=1)
            best = np.lexsort((who, both), axis=1)[:, : gap.shape[1]]
            gap[some], at[some] = np.take_along_axis(both, best, 1), np.take_along_axis(who, best, 1)


def _matrix(table: pa.Table, names) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names])


def _by_id(table: pa.Table) -> pa.Table:
    return table.sort_by("id")


def nearest_within(centres, spreads, m: int, own: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``m`` individuals of the right side nearest to each of the left, in
    the spread of the left one (``own``) or of the right one:
    ``run_id, id, match_id, distance``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = _by_id(right)
        tree = SearchTree(_matrix(right, centres), None if own else _matrix(right, spreads))
        at, gap = tree.nearest(_matrix(left, centres), _matrix(left, spreads) if own else None, m)
        row, place = np.nonzero(at >= 0)
        columns = [left.column("run_id").take(pa.array(row)), left.column("id").take(pa.array(row))]
        columns += [right.column("id").take(pa.array(at[row, place])), pa.array(gap[row, place])]
        return pa.table(columns, names=["run_id", "id", "match_id", "distance"])

    return run


def nearest_members(dims, runs: list[tuple], m: int) -> Callable[[Batches], Batches]:
    """The ``m`` members nearest to each point in the member's spread:
    ``point_id, run_id, id, distance``. ``runs`` lists ``(run_id, ids, centres, spreads)``."""

    def run(batches: Batches) -> Batches:
        trees = [(run_id, ids, SearchTree(centres, spreads)) for run_id, ids, centres, spreads in runs]
        for batch in batches:
            points = batch.column("point_id").to_numpy(zero_copy_only=False)
            places = np.column_stack(_columns(batch, dims))
            for run_id, ids, tree in trees:
                at, gap = tree.nearest(places, None, m)
                row, place = np.nonzero(at >= 0)
                columns = [points[row], np.full(len(row), run_id, "int64"), ids[at[row, place]], gap[row, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point_id", "run_id", "id", "distance"])

    return run


def mutate(parts, spread_cols, size: int, weight: float, crossover: float, eps: float) -> Callable[[pa.Table], pa.Table]:
    """Children of one run from its members with partners ``r1, r2, r3`` and one
    uniform number ``u_<part>`` per part."""

    def run(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        ids = table.column("id").to_numpy()
        if not np.array_equal(ids, np.arange(size)):
            raise ValueError("the population is not of the configured size")
        r1, r2, r3 = (table.column(f"r{k}").to_numpy() for k in (1, 2, 3))
        columns = [table.column("run_id"), table.column("id")]
        for name in parts:
            old, chance = table.column(name).to_numpy(), table.column(f"u_{name}").to_numpy()
            new = np.where(chance < crossover, old[r3] + weight * (old[r1] - old[r2]), old)
            columns.append(pa.array(np.maximum(np.abs(new), eps) if name in spread_cols else new))
        return pa.table(columns, names=["run_id", "id", *parts])

    return run


def survive(mode: str, slot: str, centres, spreads, body, rank: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The next population of one run from parents and children with the same
    ids; ``rank`` is the column they are compared by."""

    def run(parents: pa.Table, children: pa.Table) -> pa.Table:
        parents, children = _by_id(parents), _by_id(children)
        ids = parents.column("id").to_numpy()
        if not np.array_equal(ids, children.column("id").to_numpy()):
            raise ValueError("parents and children do not have the same ids")
        fit, new = (t.column(rank).to_numpy() for t in (parents, children))
        # per slot the child that takes it, -1 where the parent stays
        takes = np.full(len(ids), -1)
        every = np.arange(len(ids))
        if mode == "greedy":
            takes[new > fit] = every[new > fit]
        elif mode == "nearest_child":
            near = SearchTree(_matrix(children, centres)).nearest(_matrix(parents, centres), _matrix(parents, spreads), 1)[0][:, 0]
            loses = ~(fit > new[near])
            takes[loses] = near[loses]
        else:
            near = SearchTree(_matrix(parents, centres)).nearest(_matrix(children, centres), _matrix(children, spreads), 1)[0][:, 0]
            won = np.flatnonzero(new > fit[near])
            if slot == "self":
                takes[won] = won
            else:  # the fittest winner comes last, of equals the lowest id
                for child in won[np.lexsort((-won, new[won]))]:
                    takes[near[child]] = child
        columns = [parents.column("run_id"), parents.column("id")]
        for name in body:
            columns.append(pa.array(np.where(takes >= 0, children.column(name).to_numpy()[takes], parents.column(name).to_numpy())))
        return pa.table(columns, names=["run_id", "id", *body])

    return run


def _two(xs, centres, spreads):
    """Positions and distances of the nearest and the second nearest member."""
    n = len(xs[0])
    i1, d1 = np.zeros(n, "int64"), np.full(n, np.inf)
    i2, d2 = np.full(n, -1, "int64"), np.full(n, np.inf)
    distance, part = np.empty(n), np.empty(n)
    for j in range(len(centres)):
        distance.fill(0)
        for k, x in enumerate(xs):
            np.subtract(x, centres[j, k], out=part)
            part /= spreads[j, k]
            part *= part
            distance += part
        # Few points still improve after the first members.
        better = np.flatnonzero(distance < d2)
        found = distance[better]
        best = found < d1[better]
        top, next_ = better[best], better[~best]
        i2[top], d2[top] = i1[top] if j else -1, d1[top]
        i1[top], d1[top] = j, found[best]
        i2[next_], d2[next_] = j, found[~best]
    return i1, d1, i2, d2


def nearest_two(dims, models, keep, rep1=False) -> Callable[[Batches], Batches]:
    """Per point and model: labels and distances of the nearest and the second
    nearest representative, ties to the lower position.

    ``models`` is a list of ``(run_id, centres, spreads, labels)``; ``keep``
    names the point columns carried through. A model with one representative
    has no second one (label -1, distance infinite). With ``rep1`` the second
    label is always that of the second representative in the list.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            carried = [batch.column(k) for k in keep]
            columns = _columns(batch, dims)
            for start in range(0, batch.num_rows, STEP):
                xs = [c[start : start + STEP] for c in columns]
                rows = [c.slice(start, STEP) for c in carried]
                for run_id, centres, spreads, labels in models:
                    i1, d1, i2, d2 = _two(xs, centres, spreads)
                    l2 = np.where(i2 < 0, -1, labels[min(1, len(labels) - 1)] if rep1 else labels[i2])
                    found = [np.full(len(i1), run_id, "int64"), labels[i1], d1, l2, d2]
                    yield pa.RecordBatch.from_arrays(
                        [*rows, *map(pa.array, found)],
                        names=[*keep, "run_id", "label1", "d1", "label2", "d2"],
                    )

    return run


class _Counts:
    """How often each code came, kept sorted and short."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 64 and self.size > 4 * len(self.parts[0][0]):
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        return codes, np.bincount(inverse, weights=np.concatenate([n for _, n in self.parts])).astype(np.int64)


class _Names:
    """Numbers for the values of a column, in the order they came."""

    def __init__(self):
        self.names, self.kind = {}, pa.null()

    def codes(self, column) -> np.ndarray:
        column = column.dictionary_encode()
        self.kind = column.dictionary.type
        own = [self.names.setdefault(v, len(self.names)) for v in column.dictionary.to_pylist()]
        own.append(self.names.setdefault(None, len(self.names)) if column.null_count else -1)
        return np.array(own)[column.indices.fill_null(len(own) - 1).to_numpy()]

    def values(self, codes) -> pa.Array:
        names = list(self.names)
        return pa.array([names[i] for i in codes], self.kind)


def count_two(dims, models, steps, label=None) -> Callable[[Batches], Batches]:
    """How many points of a partition share ``label``, the positions of the two
    nearest representatives and the number of ``steps`` below either distance:
    ``run_id, [label], place1, place2, bin1, bin2, n``. What leaves the task
    depends on the kinds of points, not on their number. ``models`` as for
    ``nearest_two``; place2 is -1 where there is one representative only."""
    edges, levels = np.array(steps, float), len(steps) + 1

    def run(batches: Batches) -> Batches:
        found, names = [_Counts() for _ in models], _Names()
        for batch in batches:
            code = None if label is None else names.codes(batch.column(label))
            columns = _columns(batch, dims)
            for start in range(0, batch.num_rows, STEP):
                xs = [c[start : start + STEP] for c in columns]
                for counts, (_, centres, spreads, _) in zip(found, models):
                    i1, d1, i2, d2 = _two(xs, centres, spreads)
                    key = 0 if code is None else code[start : start + STEP]
                    for part, size in ((i1, len(centres)), (i2 + 1, len(centres) + 1)):
                        key = key * size + part
                    for part in (d1, d2):
                        key = key * levels + np.searchsorted(edges, part)
                    counts.add(key)
        for counts, (run_id, centres, *_) in zip(found, models):
            if not counts.parts:
                continue
            key, n = counts.total()
            columns = []
            for size in (levels, levels, len(centres) + 1, len(centres)):
                key, rest = key // size, key % size
                columns.append(rest)
            bin2, bin1, place2, place1 = columns
            out = {"run_id": np.full(len(n), run_id, "int64")}
            if label is not None:
                out[label] = names.values(key)
            out |= {"place1": place1, "place2": place2 - 1, "bin1": bin1, "bin2": bin2, "n": n}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.values()], names=list(out))

    return run


def _farthest(gap: np.ndarray, ids: np.ndarray, at: np.ndarray, m: int):
    best = np.lexsort((ids, -gap))[:m]
    return gap[best], ids[best], at[best]


def _farthest_rows(found: dict) -> Batches:
    """Rows ``key, gaps, ids, at``, the coordinates one point after another."""
    if found:
        columns = [pa.array(list(found), pa.int64())]
        for k, kind in enumerate((pa.float64(), pa.int64(), pa.float64())):
            columns.append(pa.array([f[k].ravel() for f in found.values()], pa.list_(kind)))
        yield pa.RecordBatch.from_arrays(columns, names=["key", "gaps", "ids", "at"])


def farthest_points(dims, centres: dict[int, np.ndarray], m: int) -> Callable[[Batches], Batches]:
    """Per partition and run the ``m`` points farthest from their closest
    centre, with squared gaps; equal gaps by lower id."""

    def run(batches: Batches) -> Batches:
        best: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, *columns = _columns(batch, ["point_id", *dims])
            at = np.column_stack(columns)
            for key, own in centres.items():
                gap = np.full(len(ids), np.inf)
                for centre in own:
                    gap = np.minimum(gap, _sq_distance(columns, centre, np.ones(len(centre))))
                found = _farthest(gap, ids, at, m)
                if key in best:
                    found = _farthest(*(np.concatenate(x) for x in zip(best[key], found)), m)
                best[key] = found
        yield from _farthest_rows(best)

    return run


def merge_farthest(m: int) -> Callable[[Batches], Batches]:
    """Combine the outputs of ``farthest_points`` that share a partition."""

    def run(batches: Batches) -> Batches:
        best: dict[int, tuple] = {}
        for batch in batches:
            for key, *arrays in zip(batch.column("key").to_pylist(), *(batch.column(c) for c in ("gaps", "ids", "at"))):
                gap, ids, at = (a.values.to_numpy() for a in arrays)
                found = gap, ids, at.reshape(len(gap), -1)
                if key in best:
                    found = _farthest(*(np.concatenate(x) for x in zip(best[key], found)), m)
                best[key] = found
        yield from _farthest_rows(best)

    return run


def add_arrays(batches: Batches) -> Batches:
    """Rows ``key, sums`` of one partition, the arrays added by key."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, values in zip(batch.column("key").to_pylist(), batch.column("sums")):
            values = values.values.to_numpy()
            totals[key] = totals[key] + values if key in totals else values
    yield from key_arrays(totals)


def key_arrays(totals: dict[int, np.ndarray]) -> Batches:
    """Rows ``key, sums``."""
    if totals:
        sums = pa.array([v.ravel() for v in totals.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), sums], names=["key", "sums"])


def _rows(batch: pa.RecordBatch, dims, size: int = STEP):
    """The coordinates of a batch, some points at a time, one row per point."""
    for columns in _coordinates(batch, dims):
        for start in range(0, len(columns[0]), size):
            yield np.column_stack([c[start : start + size] for c in columns])


def coordinate_ranges(dims) -> Callable[[Batches], Batches]:
    """Per partition one row, key 0: the number of points, then per dimension
    how many values are no finite numbers, and the least and the greatest of
    the others. Wide tables need no generated code this way."""

    def run(batches: Batches) -> Batches:
        n, bad = 0, np.zeros(len(dims))
        low, high = np.full(len(dims), np.inf), np.full(len(dims), -np.inf)
        for batch in batches:
            for x in _rows(batch, dims):
                good = np.isfinite(x)
                n, bad = n + len(x), bad + (~good).sum(axis=0)
                low = np.minimum(low, np.where(good, x, np.inf).min(axis=0))
                high = np.maximum(high, np.where(good, x, -np.inf).max(axis=0))
        yield from key_arrays({0: np.concatenate([[n], bad, low, high])})

    return run


def merge_ranges(batches: Batches) -> Batches:
    """Rows of ``coordinate_ranges`` that share a partition, as one."""
    rows = [v.values.to_numpy() for batch in batches for v in batch.column("sums")]
    if rows:
        yield from key_arrays({0: joined_ranges(rows)})


def joined_ranges(rows: list) -> np.ndarray:
    table = np.array(rows)
    d = (table.shape[1] - 1) // 3
    ends = 1 + d, 1 + 2 * d
    return np.concatenate([table[:, : ends[0]].sum(axis=0), table[:, ends[0] : ends[1]].min(axis=0), table[:, ends[1] :].max(axis=0)])


def _responsibilities(x: np.ndarray, weights, means, factors):
    """Posterior of every component per point, and the points' log-likelihood.
    ``factors`` are the inverses of the Cholesky factors."""
    d = x.shape[1]
    logs = []
    for w, mean, inverse in zip(weights, means, factors):
        solved = (x - mean) @ inverse.T
        scale = np.log(w) - 0.5 * d * np.log(2 * np.pi) + np.log(np.diag(inverse)).sum()
        logs.append(scale - 0.5 * (solved * solved).sum(axis=1))
    logs = np.stack(logs)
    top = logs.max(axis=0)
    shares = np.exp(logs - top)
    whole = shares.sum(axis=0)
    shares /= whole
    return shares, top + np.log(whole)


#: Widest points whose EM steps go by products of coordinates, points of such a
#: step (few enough for one BLAS thread), and the error allowed in a logarithm.
PLANE, PLANE_STEP, ROUNDING = 4, 4096, 1e-9


def _products(offsets: list[np.ndarray]) -> np.ndarray:
    """One row each for 1, the offsets, and their products in pairs."""
    d = len(offsets)
    pairs = [offsets[i] * offsets[j] for i in range(d) for j in range(i, d)]
    return np.stack([np.ones(len(offsets[0])), *offsets, *pairs])


def _log_weights(weights, factors, d: int) -> np.ndarray:
    """What the logarithm of a component's density is at its mean."""
    turned = [np.log(np.diag(inverse)).sum() for inverse in factors]
    return np.log(weights) - 0.5 * d * np.log(2 * np.pi) + np.array(turned)


class _Plane:
    """One mixture over few dimensions: logarithms of the densities and moments
    are matrix products with the products of coordinates around ``centre``, as
    far as that is exact to ``ROUNDING``; ``least`` is the smallest variance."""

    def __init__(self, weights, means, factors, centre, least: float):
        k, d = len(weights), len(centre)
        self.offsets = np.array(means) - centre
        self.tops = _log_weights(weights, factors, d)
        self.means, self.factors = means, factors
        self.sums = np.zeros((k, 1 + d + d * (d + 1) // 2))
        self.log, precisions, rows = 0.0, [], []
        for o, top, inverse in zip(self.offsets, self.tops, factors):
            p = inverse.T @ inverse
            precisions.append(np.linalg.norm(p))
            twice = np.where(np.eye(d, dtype=bool), 0.5, 1.0) * p
            rows.append([top - 0.5 * o @ p @ o, *(p @ o), *(-twice[np.triu_indices(d)])])
        self.rows = np.array(rows)
        steepest = max([*precisions, 1 / least if least else np.inf])
        # the squared reach of points from the centre up to which it is exact
        self.reach = ROUNDING / np.finfo(float).eps / steepest - (self.offsets**2).sum(axis=1).max()

    def soft(self, products: np.ndarray) -> None:
        shares = self.rows @ products
        top = shares.max(axis=0)
        shares -= top
        np.exp(shares, out=shares)
        whole = shares.sum(axis=0)
        shares /= whole
        np.log(whole, out=whole)
        self.log += top.sum() + whole.sum()
        self.sums += shares @ products.T

    def hard(self, columns, products: np.ndarray) -> None:
        """Distances without rounding up to products: a tie goes to the first."""
        best, owner = None, np.zeros(len(columns[0]), np.int64)
        for c, (mean, inverse, top) in enumerate(zip(self.means, self.factors, self.tops)):
            offsets = [x - m for x, m in zip(columns, mean)]
            total = None
            for row in inverse:
                terms = [off if v == 1 else v * off for v, off in zip(row, offsets) if v]
                solved = reduce(np.add, terms)
                square = solved * solved
                total = square if total is None else np.add(total, square, out=total)
            total *= -0.5
            total += top
            if best is None:
                best = total
                continue
            np.putmask(owner, total > best, c)
            np.maximum(best, total, out=best)
        self.log += best.sum()
        self.sums += (owner == np.arange(len(self.tops))[:, None]).astype(float) @ products.T

    def around_means(self) -> np.ndarray:
        """Per component the responsibilities, the offsets from its mean and
        their products, as the passes over wide points sum them."""
        out = []
        d = self.offsets.shape[1]
        for row, o in zip(self.sums, self.offsets):
            square = np.zeros((d, d))
            square[np.triu_indices(d)] = row[1 + d :]
            square += np.triu(square, 1).T
            first = row[1 : 1 + d]
            square += row[0] * np.outer(o, o) - np.outer(first, o) - np.outer(o, first)
            out.append(np.concatenate([[row[0]], first - row[0] * o, square.ravel()]))
        return np.array(out)


def em_sums(dims, mixtures, hard=False, least: float = 0.0) -> Callable[[Batches], Batches]:
    """Per partition and mixture (its place in the list) one array of the sums
    an EM step needs: the log-likelihood, then for every component the
    responsibilities, the weighted offsets from the old mean and their products.
    With ``hard`` each point belongs to its most probable component alone, as in
    k-means, and of the likelihood nothing is meant. ``least`` is a variance that
    no component falls below.

    ``mixtures`` is a list of ``(run_id, weights, means, inverse Cholesky factors)``.
    """
    d = len(dims)
    # one step's arrays stay within a few MB however wide the points are
    size = PLANE_STEP if d <= PLANE else max(256, STEP * 4 // max(d, 4))
    centre = np.mean([m for _, _, means, _ in mixtures for m in means], axis=0) if mixtures else np.zeros(d)

    def run(batches: Batches) -> Batches:
        sums = [np.zeros((len(m[1]), 1 + d + d * d)) for m in mixtures]
        logs = [0.0] * len(mixtures)
        planes = [_Plane(*m[1:], centre, least) for m in mixtures] if d <= PLANE else []
        for batch in batches:
            for x in _rows(batch, dims, size):
                far = range(len(mixtures))
                if planes and len(x):
                    columns = list(np.ascontiguousarray(x.T))
                    offsets = [v - c for v, c in zip(columns, centre)]
                    reach = sum(max(v.max(), -v.min()) ** 2 for v in offsets)
                    products = _products(offsets)
                    far = [at for at, plane in enumerate(planes) if not reach <= plane.reach]
                    for plane in planes:
                        if reach <= plane.reach:
                            plane.hard(columns, products) if hard else plane.soft(products)
                for at in far:
                    _, weights, means, factors = mixtures[at]
                    shares, ll = _responsibilities(x, weights, means, factors)
                    logs[at] += ll.sum()
                    if hard:
                        shares = (np.arange(len(shares))[:, None] == shares.argmax(axis=0)) * 1.0
                    for row, r, mean in zip(sums[at], shares, means):
                        off = x - mean
                        weighted = off * r[:, None]
                        row[0] += r.sum()
                        row[1 : 1 + d] += weighted.sum(axis=0)
                        row[1 + d :] += (weighted.T @ off).ravel()
        for at, plane in enumerate(planes):
            sums[at] += plane.around_means()
            logs[at] += plane.log
        yield from key_arrays({at: np.append(logs[at], sums[at].ravel()) for at in range(len(mixtures))})

    return run


_MD5_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
_MD5_PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def md5_words(prefix: bytes, tails: np.ndarray) -> list[np.ndarray]:
    """The four words of the MD5 of ``prefix`` before each row of bytes of
    ``tails``, all rows a step at a time."""
    n, size = len(tails), len(prefix) + tails.shape[1]
    blocks = (size + 8) // 64 + 1
    text = np.zeros((n, 64 * blocks), np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    text[:, len(prefix) : size] = tails
    text[:, size] = 0x80
    text[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    # words that all rows share are numbers
    given = range(len(prefix) // 4, (size - 1) // 4 + 1)
    words = text.view("<u4")
    state = [np.full(n, v) for v in _MD5_START]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for block in range(blocks):
        own = []
        for i in range(16 * block, 16 * (block + 1)):
            own.append(np.ascontiguousarray(words[:, i]) if i in given else words[0, i])
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            kind = i // 16
            if kind == 0:  # (b & c) | (~b & d)
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif kind == 1:  # (d & b) | (~d & c)
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif kind == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:  # c ^ (b | ~d)
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            a += f
            word = own[_MD5_PLACES[i]]
            if np.ndim(word):
                a += word
                a += _MD5_ADDED[i]
            else:
                a += np.uint32((int(word) + int(_MD5_ADDED[i])) & 0xFFFFFFFF)
            left = np.uint32(_MD5_TURNS[i])
            np.right_shift(a, np.uint32(32 - left), out=t)
            np.left_shift(a, left, out=a)
            np.bitwise_or(a, t, out=a)
            a += b
            a, b, c, d = d, a, b, c
        state = [v + w for v, w in zip(state, (a, b, c, d))]
    return state


class Draws:
    """The uniform numbers of ``functions.rng`` for whole numbers as last part."""

    def __init__(self, ids: pa.Array):
        self.n, self.groups = len(ids), []
        texts = ids.cast(pa.string())
        sizes = np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.n]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            some = slice(None) if len(rows) == self.n else rows
            places = starts[rows][:, None] + np.arange(max(size, 0), dtype=np.int32)
            self.groups.append((some, letters[places], size < 0))

    def uniform(self, *parts) -> np.ndarray:
        prefix = "|".join(map(str, parts)).encode()
        out = np.empty(self.n)
        for rows, tails, null in self.groups:
            # a null is left out, with the sign before it
            a, b, *_ = md5_words(prefix if null else prefix + b"|", tails)
            # 13 digits: the first word and 20 bits of the second, bytes in order
            high, low = a.byteswap().astype(np.float64), (b.byteswap() >> np.uint32(12)).astype(np.float64)
            out[rows] = (high * 2.0**20 + low) / 2.0**52
        return out


def seed_races(dims, chosen, seed: int, turn: int) -> Callable[[Batches], Batches]:
    """Per partition and run the point that wins the race for the next centre,
    as ``(run_id, time, point_id, at)``: the time is exponential with the squared
    distance from the nearest of ``chosen[run]`` as rate, by the uniform number
    of seed, run, turn and point. Centres do not take part."""

    def run(batches: Batches) -> Batches:
        best: list[tuple | None] = [None] * len(chosen)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                draws = Draws(some.column("point_id"))
                ids = some.column("point_id").to_numpy(zero_copy_only=False)
                xs = _columns(some, dims)
                for at, centres in enumerate(chosen):
                    gap = np.ones(len(ids))
                    for k, c in enumerate(centres):
                        moved = _sq_distance(xs, c, np.ones(len(c)))
                        gap = moved if k == 0 else np.minimum(gap, moved)
                    u = draws.uniform(seed, at, turn, "seed")
                    # no time is less than u / gap, with room for rounding
                    near = gap > 0
                    if best[at] is not None:
                        near &= u <= best[at][0] * (1 + 1e-9) * gap
                    near = np.flatnonzero(near)
                    if not len(near):
                        continue
                    time = -np.log(1 - u[near]) / gap[near]
                    near = near[time == time.min()]
                    first = near[np.argmin(ids[near])]
                    found = (float(time.min()), int(ids[first]), [float(x[first]) for x in xs])
                    if best[at] is None or found[:2] < best[at][:2]:
                        best[at] = found
        rows = [(at, *b) for at, b in enumerate(best) if b is not None]
        if rows:
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["run_id", "time", "point_id", "at"])

    return run


def em_labels(dims, mixtures, keep) -> Callable[[Batches], Batches]:
    """``keep.., run_id, prediction``: the most probable component per point
    and mixture, the first on ties."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            start = 0
            for x in _rows(batch, dims):
                rows = [batch.column(k).slice(start, len(x)) for k in keep]
                start += len(x)
                for run_id, weights, means, factors in mixtures:
                    shares, _ = _responsibilities(x, weights, means, factors)
                    found = [np.full(len(x), run_id, "int64"), shares.argmax(axis=0)]
                    yield pa.RecordBatch.from_arrays(
                        [*rows, *map(pa.array, found)], names=[*keep, "run_id", "prediction"]
                    )

    return run


def em_counts(dims, mixtures, label) -> Callable[[Batches], Batches]:
    """How many points of a partition have the ``label`` and, per mixture, the
    most probable component, as ``em_labels`` finds it:
    ``run_id, label, prediction, n``."""

    def run(batches: Batches) -> Batches:
        found, names = [_Counts() for _ in mixtures], _Names()
        for batch in batches:
            if not batch.num_rows:
                continue
            code, start = names.codes(batch.column(label)), 0
            for x in _rows(batch, dims):
                own = code[start : start + len(x)]
                start += len(x)
                for counts, (_, *mixture) in zip(found, mixtures):
                    shares, _ = _responsibilities(x, *mixture)
                    counts.add(own * len(shares) + shares.argmax(axis=0))
        for counts, (run_id, weights, *_) in zip(found, mixtures):
            if counts.parts:
                key, n = counts.total()
                columns = [np.full(len(n), run_id, "int64"), names.values(key // len(weights)), key % len(weights), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run_id", label, "prediction", "n"])

    return run

"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of five words, each labelled with the
number of its occurrence. For each of several hash functions the few smallest
labelled shingles are taken and put back into text order; their ordered list is
a sketch. Two texts get equal sketches only if they share these shingles in the
same order, so sketches follow edit similarity (Order MinHash). A text with
repeated shingles gets sketches of its first occurrences too: similarity counts
distinct shingles, however often they are repeated.

Texts with equal words are one node from the start. In a group of equal
sketches every node is compared with one hub, drawn per group, which makes as
many pairs as nodes. Pairs are verified by aligning their shingles inside a
band, and verified pairs are joined into components. Groups that are one
component are done; the others get another hub, and after some rounds they are
finished exactly: of two similar texts one of the rarest shingles of either is
in both, and the pairs across components that share such a one are verified
too. So a group of thousands of copies costs a few comparisons per copy, a
passage that thousands of texts share makes no pairs, and no link between
components is left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import asked, bucket_count, from_bytes, mapped, packs, replied, scratch, staged, told
from .text import U64, mix, pieces, spread, windows, words

SHINGLE, SKETCHES, LENGTH = 5, 40, 6
#: Texts of few shingles also get sketches of a single one: four of five would seldom agree.
SHORT, SHORT_SKETCHES = 20, 8
SIMILARITY = 0.8
WIDE = 1 << 15
BINS, FULL = 256, (1 << 16) - 1
#: Groups are compared with this many hubs before pairs across components are formed.
ROUNDS = 2
#: Text of a block from which rows are picked.
PICK_BYTES = 1 << 20
_SEEDS = spread(2 * (SKETCHES + SHORT_SKETCHES), 29).reshape(2, -1)
SKETCH = "block bigint, row bigint, doc_id bigint, digest binary, n bigint, keys array<bigint>"
SKETCH_FIELDS = pa.schema(
    [(x, pa.int64()) for x in ("block", "row", "doc_id")]
    + [("digest", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))]
)
TEXTS = "row bigint, bins binary, blob binary"
TEXT_FIELDS = pa.schema([("row", pa.int64()), ("bins", pa.binary()), ("blob", pa.binary())])


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingles of a text; one of all its words if there are fewer."""
    return windows(hashes, min(size, len(hashes))) if len(hashes) else hashes


def labelled(found: np.ndarray, firsts: bool = False) -> np.ndarray:
    """Shingles marked with the number of their occurrence in the text; of each
    only the first if asked."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.ones(len(found), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(new)
    occurrence = np.empty(len(found), U64)
    occurrence[order] = np.arange(len(found)) - np.repeat(begins, np.diff(np.append(begins, len(found))))
    if firsts:
        found, occurrence = found[occurrence == 0], occurrence[occurrence == 0]
    return mix(found.astype(U64) + occurrence * U64(0x9E3779B97F4A7C15))


def all_sketches(found: np.ndarray) -> np.ndarray:
    """Keys of a text, each once: by labelled shingles, and by distinct ones where
    some repeat, as similarity does not ask how often they do. The labels of first
    occurrences are the same in both, so texts with and without repeats meet."""
    labels, first = labelled(found), labelled(found, firsts=True)
    return sketches(labels) if len(first) == len(labels) else np.unique(np.concatenate([sketches(labels), sketches(first)]))


def sketches(labels: np.ndarray) -> np.ndarray:
    """Keys of the ordered minima of a text."""
    n, out = len(labels), []
    for first, last, length in ((0, SKETCHES, LENGTH), (SKETCHES, SKETCHES + SHORT_SKETCHES, 1)):
        if length == 1 and n > SHORT:
            break
        step = last - first if n <= WIDE else 1
        for lo in range(first, last, step):
            a, b = _SEEDS[:, lo : lo + step, None]
            ranks = (((labels[None, :] ^ a) * (b | U64(1))) >> U64(32)).astype(np.uint32)
            if n > length:
                lowest = np.sort(np.argpartition(ranks, length - 1, axis=1)[:, :length], axis=1)
            else:
                lowest = np.tile(np.arange(n), (len(a), 1))
            key = a[:, 0]
            for k in range(lowest.shape[1]):
                key = mix(key * U64(0xD1342543DE82EF95) + labels[lowest[:, k]])
            out.append(key)
    return np.concatenate(out)


def _opened(batches):
    """The documents of packed blocks, with the number of their block."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
            table = from_bytes(payload.as_buffer()).select(["row", "id", "text"])
            for part in table.to_batches():
                numbers = pa.array(np.full(len(part), block))
                yield pa.RecordBatch.from_arrays([numbers, *part.columns], names=["block", "row", "id", "text"])


def _picked(packed: DataFrame, rows: DataFrame, use, schema) -> DataFrame:
    """``use(documents)`` for each block, of the documents that ``rows``
    (``block``, ``row``) names. Blocks travel compressed, texts never do."""

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        table = from_bytes(left.column("payload")[0].as_buffer())
        return use(table.filter(pa.array(np.isin(table.column("row").to_numpy(), right.column("row").to_numpy()))))

    return packed.select("block", "payload").groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(pick, schema)


def _sketched(batches):
    for batch in _opened(batches):
        for lo in range(0, len(batch), 1000):
            part = batch.slice(lo, 1000)
            found = words(part.column("text"))
            data, offset = found.data.tobytes(), found.offset
            digests, sizes, keys = [], [], []
            for d in range(len(part)):
                own = found.hash[found.first[d] : found.first[d + 1]]
                if not len(own):
                    digests.append(None)
                    sizes.append(0)
                    keys.append(np.zeros(0, np.int64))
                    continue
                plain = b" ".join(data[offset[d] : offset[d + 1]].split())
                digests.append(hashlib.blake2b(plain, digest_size=16).digest())
                made = shingles(own)
                sizes.append(len(np.unique(made)))
                keys.append(all_sketches(made).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            columns = [part.column(c) for c in ("block", "row", "id")] + [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=SKETCH_FIELDS)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Aligned share of two shingle sequences: distinct shingles that a common
    subsequence matches, over all distinct shingles of both. Only pairs within
    the band are matched. It is as wide as the number of shingles that may be
    left over at the threshold, so a value from there on is exact."""
    la, lb = labelled(a), labelled(b)
    _, i, j = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    distinct = len(np.unique(a)) + len(np.unique(b))
    band = max(len(a), len(b)) - int(threshold / (1 + threshold) * distinct)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) and not (j[1:] > j[:-1]).all():
        i = i[_longest_rise(j)]
    matched = len(np.unique(a[i]))
    union = distinct - matched
    return matched / union if union else 0.0


def _longest_rise(values: np.ndarray) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [v]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _shingled(table: pa.Table) -> pa.Table:
    """Texts as 32-bit shingles, and how many distinct ones fall in each bin."""
    parts = []
    for batch in table.to_batches():
        for part in pieces(batch):
            found = words(part.column("text"))
            blobs, bins = [], []
            for d in range(len(part)):
                made = (shingles(found.hash[found.first[d] : found.first[d + 1]]) >> U64(32)).astype(np.uint32)
                counts = np.bincount(np.unique(made) % BINS, minlength=BINS)
                blobs.append(made.tobytes())
                bins.append(counts.astype(np.uint16).tobytes() if counts.max() < FULL else b"")
            columns = [part.column("row"), pa.array(bins, pa.binary()), pa.array(blobs, pa.binary())]
            parts.append(pa.RecordBatch.from_arrays(columns, schema=TEXT_FIELDS))
    return pa.Table.from_batches(parts, schema=TEXT_FIELDS)


def bound(a: bytes, b: bytes) -> float:
    """The similarity that two texts reach at most, by their bins."""
    if not a or not b:
        return 1.0
    x, y = (np.frombuffer(t, np.uint16).astype(np.int64) for t in (a, b))
    common = int(np.minimum(x, y).sum())
    return common / max(int(x.sum() + y.sum()) - common, 1)


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are similar enough. Only those that
    their bins don't rule out fetch the shingles."""
    least = threshold - 1e-12

    def possible(batches):
        for batch in batches:
            good = [bound(x, y) >= least for x, y in zip(batch.column("bins_a").to_pylist(), batch.column("bins_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(batches):
        for batch in batches:
            good = [
                similarity(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), threshold) >= least
                for x, y in zip(batch.column("blob_a"), batch.column("blob_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def with_texts(pairs: DataFrame, column: str) -> DataFrame:
        one = texts.select(F.col("row").alias("a"), F.col(column).alias(f"{column}_a"))
        two = texts.select(F.col("row").alias("b"), F.col(column).alias(f"{column}_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", f"{column}_a", f"{column}_b")

    left = staged(mapped(with_texts(pairs, "bins"), possible, "a bigint, b bigint"), "neardup-possible")
    return mapped(with_texts(left, "blob"), verify, "a bigint, b bigint")


def _prefixes(texts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``nodes`` with the shingles of which similar texts must share one: of the
    n shingles of a text a partner holds ``threshold * n`` at least, so one of
    the ``n - ceil(threshold * n) + 1`` rarest is among them. Those that no
    other of the texts has are left out; ``m`` is the number of all the others,
    ``rank`` the place in the order of rarity. A passage that many texts share
    is frequent, so it comes last."""
    rest = texts.withColumnRenamed("row", "node").join(nodes, "node").select("node", "n", "comp", F.col("blob").alias("text"))
    packed = packs(rest, "neardup-rest")

    def own(table: pa.Table) -> list[np.ndarray]:
        return [np.unique(np.frombuffer(x.as_buffer(), np.uint32)) for x in table.column("text")]

    def question(table: pa.Table, block: int) -> list[list[np.ndarray]]:
        keys, counts = np.unique(np.concatenate(own(table)), return_counts=True)
        return [[keys.astype(U64) << U64(32), counts.astype(np.uint32)]]

    def answer(questions, blocks):
        distinct, inverse = np.unique(np.concatenate([q[0] for q in questions]), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate([q[1] for q in questions]), minlength=len(distinct))
        return [[x] for x in np.split(sums[inverse].astype(np.int64), np.cumsum([len(q[0]) for q in questions])[:-1])]

    def use(table: pa.Table, block: int, answers: list[np.ndarray]) -> pa.Table:
        found = own(table)
        counts = answers[0][np.unique(np.concatenate(found), return_inverse=True)[1]]
        shared, lists, ranks = [], [], []
        for x, c in zip(found, np.split(counts, np.cumsum([len(x) for x in found])[:-1])):
            most = len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1
            lead = np.lexsort((x, c))[:most]
            shared.append(int((c > 1).sum()))
            lists.append(x[lead[c[lead] > 1]])
            ranks.append(np.flatnonzero(c[lead] > 1))
        at = pa.array(np.repeat(np.arange(len(table)), [len(x) for x in lists]))
        columns = [table.column(c).combine_chunks().take(at) for c in ("node", "n", "comp")]
        columns += [pa.array(shared, pa.int64()).take(at), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(lists).astype(np.int64))]
        return pa.Table.from_arrays(columns, names=["node", "n", "comp", "m", "rank", "shingle"])

    replies = replied(asked(packed, bucket_count(packed), question), answer)
    return staged(told(packed, replies, use, "node bigint, n bigint, comp bigint, m bigint, rank bigint, shingle bigint"), "neardup-prefixes")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (its smallest node) for all nodes with an edge (``a``,
    ``b``), by alternating stars: each node links its larger neighbours, then
    its smaller ones, to the smallest of them, until nothing changes."""
    links = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        small = staged(small.where("u <> v").distinct(), "links")
        change = small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty()
        links = small
        if change:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(links.select(F.col("v"), F.col("v")).distinct())


def _classes(base: DataFrame, threshold: float) -> DataFrame:
    """``block``, ``row``, ``doc_id``, ``comp`` for every row of the packed ``base``."""
    sketched = staged(mapped(base.select("block", "payload"), _sketched, SKETCH), "neardup-sketches")
    worded = sketched.where("digest IS NOT NULL")
    nodes = worded.groupBy("digest").agg(F.min(F.struct("row", "block")).alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = staged(nodes.select("digest", F.col("f.row").alias("node"), F.col("f.block").alias("block"), "n", "keys"), "neardup-nodes")
    members = nodes.select("node", "n", F.explode("keys").alias("key"))

    shared = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = staged(members.join(shared, "key", "left_semi"), "neardup-members")
    needed = nodes.join(members.select("node").distinct(), "node").select("block", F.col("node").alias("row"))
    texts = staged(_picked(base, needed, _shingled, TEXTS), "neardup-texts")

    # one hub per group and round; groups that are one component are done
    placed, tested, edges, comps = members.withColumn("comp", F.col("node")), None, None, None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            draw = F.struct(F.xxhash64("node", "key", F.lit(turn)), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
            hubs = placed.groupBy("key").agg(F.min(draw).alias("h")).select("key", "h.hub", "h.hub_n", "h.hub_comp")
            pairs = placed.join(hubs, "key").where(F.col("comp") != F.col("hub_comp"))
        else:
            left = _prefixes(texts, placed.select("node", "n", "comp").distinct(), threshold)
            other = left.select("shingle", *[F.col(c).alias(f"hub_{c}") for c in ("n", "comp", "m", "rank")], F.col("node").alias("hub"))
            # the common shingles that the similarity asks for, against those that can be
            # common at all, and those that can follow a first common one
            most = F.least("m", "hub_m", F.col("n") - F.col("rank"), F.col("hub_n") - F.col("hub_rank"))
            enough = (1 + threshold) * most >= F.lit(threshold) * (F.col("n") + F.col("hub_n")) - 1e-9
            pairs = left.join(other, "shingle").where((F.col("comp") < F.col("hub_comp")) & enough)
        fits = F.least("n", "hub_n") >= F.lit(threshold) * F.greatest("n", "hub_n") - 1e-9
        pairs = pairs.where(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "neardup-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = staged(_verified(texts, pairs, threshold), "neardup-edges")
        edges = found if edges is None else edges.union(found)
        if comps is None or not found.isEmpty():
            comps = staged(components(edges), "neardup-comps")
            placed = placed.drop("comp").join(comps, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
        open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        placed = staged(placed.join(open_keys, "key", "left_semi"), "neardup-open")
        if placed.isEmpty():
            break
    nodes = nodes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    ids = ["block", "row", "doc_id"]
    placed = worded.select(*ids, "digest").join(nodes, "digest").select(*ids, "comp")
    return placed.union(sketched.where("digest IS NULL").select(*ids, F.col("row").alias("comp")))


def _base(docs: DataFrame) -> DataFrame:
    numbered = docs.withColumns({"row": F.monotonically_increasing_id(), "id": F.col("doc_id").cast("bigint")})
    return packs(numbered, "neardup-base", PICK_BYTES)


def _judged(base: DataFrame, threshold: float) -> DataFrame:
    with scratch(base.sparkSession):
        placed = staged(_classes(base, threshold), "neardup-classes", keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("f")
    lead = placed.groupBy("comp").agg(first, F.count("*").alias("class_size"))
    lead = lead.select("comp", F.col("f.doc_id").alias("class_id"), F.col("f.row").alias("lead"), "class_size")
    return placed.join(lead, "comp").select("block", "row", "doc_id", "class_id", "class_size", (F.col("row") == F.col("lead")).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Classes of near duplicates among ``docs`` (``doc_id``, ``text``).

    Two texts are linked if they have equal words, or if their aligned shingles
    of five words are at least ``threshold`` of all distinct ones (see
    ``similarity``; the Jaccard similarity, unless passages changed places).
    Classes are the connected components. Returns per row ``doc_id``,
    ``class_id`` (smallest id of the class), ``class_size`` and ``kept`` (true
    for one row of each class). Texts of fewer than five words are one shingle;
    a text that is null or has no words is a class of its own. A null id counts
    as the largest; a class of such rows only has a null ``class_id``. Repeated
    rows are in one class, one of them kept. An empty table gives an empty
    result; other columns are ignored.

    At a similarity of 0.8 a pair whose first occurrences are in the same order
    shares one of the 40 sketches of them with a probability above 0.99999, however
    often each repeats. Verification compares 32-bit shingle hashes.
    """
    return _judged(_base(docs.select("doc_id", "text")), threshold).drop("block", "row")


def deduplicated(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one of each class."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    base = _base(docs.withColumnsRenamed(names))
    kept = _judged(base, threshold).where("kept").select("block", "row")
    held, columns = [names.get(c, c) for c in docs.columns], docs.columns
    return _picked(base, kept, lambda table: table.select(held).rename_columns(columns), docs.schema)

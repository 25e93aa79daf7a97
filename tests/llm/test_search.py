"""Ranked search, hard negatives and toxicity against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.llm.negatives import hard_negatives
from mixframe.llm.ranking import Tree, Vectors, ranked
from mixframe.llm.toxicity import Index, isotonic, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ranked search


def plain_ranking(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t, *_ in docs]
    counts = [c for c in counts]
    n = sum(bool(c) for c in counts)
    total = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for (doc_id, *_), c in zip(docs, counts):
            if not c:
                continue
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 20])
def test_ranking_equals_the_plain_version(documents, odd_rows, spark, chunk_bytes):
    rng = random.Random(3)
    words = ["the", "of", "Cat", "dog", "größe", "漢字", "x1", "rug", "mat", "and"]
    docs = odd_rows + [(100 + i, " ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 40))), "en", "a") for i in range(60)]
    docs += [(900 + i % 2, "the cat and the dog", "en", "b") for i in range(30)]
    items = [(1, "THE cat"), (1, "rug, mat: 漢字"), (2, "dog dog dog the of"), (3, None), (4, " - "), (5, "unheard"), (1, "THE cat"), (None, "mat x")]
    table = spark.createDataFrame(items, "item_id int, text string").withColumn("score", F.lit("x"))
    got = rows_of(ranked(documents(docs, extra=True), table, chunk_bytes=chunk_bytes))
    assert got == plain_ranking(docs, [x for x in items if x[1]])


def test_ranking_of_empty_tables(documents, spark):
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked(documents([]), items).collect() == []
    assert ranked(documents([(1, "a b")]), items.limit(0)).collect() == []
    assert ranked(documents([(1, None), (2, "")]), items).collect() == []


def test_tree_keeps_every_document_and_its_bounds():
    rng = np.random.default_rng(1)
    vectors = [np.unique(rng.integers(0, 12, rng.integers(1, 9))) for _ in range(300)] + [np.arange(6)] * 200
    term = np.concatenate(vectors).astype(np.int32)
    at = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    n = len(vectors)
    tf, m = rng.integers(1, 6, len(term)), rng.integers(10, 200, n)
    docs = Vectors(np.arange(n), np.zeros(n, np.uint8), np.ones(n, np.int64), at, term, tf)
    tree = Tree(docs, m, rng.permutation(12), leaf=8)
    tree.bounds(12)
    leaves = sorted((a, b) for a, b, c in zip(tree.lo, tree.hi, tree.children) if not c)
    assert len(leaves) > 10 and leaves[0][0] == 0 and leaves[-1][1] == n
    assert all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
    for node in range(len(tree.lo)):
        lo, hi = tree.lo[node], tree.hi[node]
        assert tree.least[node] == m[tree.doc[lo:hi]].min()
        most = np.zeros(12, int)
        for d in tree.doc[lo:hi]:
            np.maximum.at(most, term[at[d] : at[d + 1]], tf[at[d] : at[d + 1]])
        assert tree.most[node].tolist() == most.tolist()


# hard negatives


def plain_negatives(rows):
    good = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        good.append((vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for a, (anchor, label, q) in enumerate(good):
        if anchor % 50:
            continue
        scored = [(-sum(p * r for p, r in zip(q, v)), i, r, other == label) for r, (i, other, v) in enumerate(good) if r != a]
        scored.sort()
        for s, positive, *_ in [x for x in scored if x[3]][:5]:
            fits = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(anchor, positive, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def embedding_rows(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d)) * 2
    return [(i, (scale * (centres[i % 4] + rng.normal(size=d) * (1 + i % 3)) / 8).tolist(), int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("seed, d, group", [(1, 2, 8192), (2, 5, 3), (3, 16, 8192)])
def test_negatives_equal_the_plain_version(spark, seed, d, group):
    rows = embedding_rows(400, d, seed)
    rows += [(50, rows[50][1], 3), (50, rows[50][1], 3), (100, rows[0][1], None), (None, rows[0][1], 1), (150, None, 1)]
    rows += [(200, [None] * d, 1), (250, [float("nan")] * d, 1), (300, [float("inf")] * d, 1), (350, [0.0] * d, 2), (400, [], 2), (401, [0.25], 2)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = sorted(map(tuple, hard_negatives(table, group_size=group, bucket=64).collect()))
    assert got == plain_negatives(rows)
    assert len(got) > 20


def test_negatives_of_empty_tables_and_long_vectors(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert hard_negatives(spark.createDataFrame([], kind)).collect() == []
    assert hard_negatives(spark.createDataFrame([(1, [0.5], 1)], kind)).collect() == []
    with pytest.raises(ValueError, match="too long"):
        hard_negatives(spark.createDataFrame([(1, [1e30], 1)], kind))


# toxicity


def labelled(documents, spark, rows):
    docs = documents([(i, t, None, None) for i, t, _ in rows], extra=True)
    labels = [(i, k, 7) for i, _, k in rows if k is not None]
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, score int")


def held(n=5):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 0


def test_toxicity_on_rows_held_out(documents, spark):
    rng = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "blue", "green", "river", "stone"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=30)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(30)] = rng.choice(["vileone", "viletwo", f"vile{rng.randrange(99)}", "rotten"])
        rows.append((i, " ".join(words), int(toxic) if i % 2 else None))
    docs, labels = labelled(documents, spark, rows)
    found = {r.doc_id: r for r in toxicity(docs, labels, held()).collect()}
    assert len(found) == 600
    for i, text, _ in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= found[i].score <= 1 and found[i].predicted == int(found[i].score >= 0.5)
        assert found[i].predicted == int("vile" in text or "rotten" in text)
        assert not found[i].predicted or all("vile" in rows[e][1] or "rotten" in rows[e][1] for e in found[i].evidence)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    vectors, seen = [], set()
    while len(vectors) < 500:
        t = np.unique(rng.zipf(1.4, rng.integers(1, 12)) % 60)
        tf = rng.integers(1, 4, len(t))
        if (t.tobytes(), tf.tobytes()) not in seen:
            seen.add((t.tobytes(), tf.tobytes()))
            vectors.append((t, tf))
    n = len(vectors)
    index = Index(vectors, np.zeros(n), np.ones(n), np.arange(n), rng.uniform(0.1, 3, 60))
    dense = np.zeros((n, 60))
    for i in range(n):
        own = slice(index.at[i], index.at[i + 1])
        dense[i, index.term[own]] = index.weight[own]
    for q in vectors[:60]:
        w = index.unit(*q)
        cosine = dense[:, q[0]] @ w
        row, got = index.nearest(q[0], w, k=9)
        want = np.lexsort((np.arange(n), -np.round(cosine, 12)))[:9]
        want = want[cosine[want] > 0]
        assert np.allclose(got, cosine[want]) and np.allclose(cosine[row], got)


def test_odd_rows_and_missing_labels(odd, spark):
    kind = "doc_id bigint, toxic int"
    for rows in ([], [(5, 1)], [(5, None), (None, 1)], [(5, 0), (5, 1), (6, 0), (7, 0)]):
        found = toxicity(odd, spark.createDataFrame(rows, kind), held()).collect()
        assert len(found) == 12 and all(0 <= r.score <= 1 and r.held_out is not None for r in found)
        assert len({r.score for r in found if r.doc_id == 5}) == 1
    assert toxicity(odd.limit(0), spark.createDataFrame([(5, 1)], kind), held()).collect() == []


def test_isotonic_rises_and_keeps_the_mean():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0.0, 0.6, 0.2, 0.4, 1.0])
    at, value = isotonic(x, y, np.ones(5))
    assert np.allclose(value, [0.0, 0.4, 1.0]) and np.allclose(at, [0.1, 0.3, 0.9])

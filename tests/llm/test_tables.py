"""Near duplicates, tokens, mixing, languages, quality, decontamination and the
pipeline against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mixframe.llm import language
from mixframe.llm.decontaminate import contaminated, uncontaminated
from mixframe.llm.language import identify, recognised
from mixframe.llm.mixing import mix_sources, mixed, targets
from mixframe.llm.neardup import components, deduplicated, near_duplicates, similarity
from mixframe.llm.quality import QualityRules, distance, judge_quality
from mixframe.llm.tokens import Encoder, new_folder, read_document, token_index, write_tokens
from mixframe.llm.text import mix
from mixframe.runtime import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def split(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=2000):
    made = random.Random(seed)
    return [f"w{made.randrange(vocabulary)}" for _ in range(n)]


# near duplicates


def plain_classes(rows, threshold=0.8):
    sets = []
    for _, text, *_ in rows:
        w = split(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(find(k), []).append(k)
    return sorted(sorted(rows[k][0] for k in c) for c in classes.values())


def test_near_duplicates_equal_all_pairs(documents):
    rows, made = [], random.Random(4)
    for family in range(12):
        base = prose(family, made.choice([3, 7, 30, 120]))
        for copy in range(made.choice([1, 2, 9])):
            w = list(base)
            for _ in range(made.choice([0, 0, 1, 2, 4])):
                w[made.randrange(len(w))] = f"e{made.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "  ")]
    got = near_duplicates(documents(rows, extra=True)).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(c) for c in classes.values()) == plain_classes(rows)
    assert all(k == min(c) for k, c in classes.items())
    assert [r.doc_id for r in got if r.kept] and sum(r.kept for r in got) == len(classes)


def test_texts_that_repeat_lines_more_or_less_often(documents):
    """Equal distinct shingles, or nearly so, and other counts of them."""
    rows = []
    for family in range(8):
        body, line = prose(100 + family, 60), prose(200 + family, 9)
        for times in (2, 20, 200):
            w = [*body, *(line * times)]
            w[family % 3 * 10] = f"e{family}-{times}" if family % 2 else w[family % 3 * 10]
            rows.append((len(rows), " ".join(w)))
    rows += [(100, "x " * 500), (101, "x " * 5000), (102, "y " * 7), (103, "y " * 70)]
    classes = {}
    for r in near_duplicates(documents(rows, extra=True)).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(c) for c in classes.values()) == plain_classes(rows)
    assert len(classes) < len(rows) / 2


def test_a_chain_of_copies_is_one_class(documents):
    """Neighbours are similar, ends are not; one group of many copies besides."""
    base, rows = prose(1, 100), []
    for k in range(12):
        base = [*base[:k * 8], f"z{k}", *base[k * 8 + 1:]]
        rows.append((k, " ".join(base)))
    rows += [(100 + k, "the same text for all of these rows here") for k in range(200)]
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(rows)).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[100 + k] for k in range(200)} == {100}


def test_similarity_follows_order():
    a = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert similarity(a, a) == 1.0
    assert similarity(a, a[10:]) == pytest.approx(0.9)
    assert similarity(a, np.concatenate([a[5:], a[:5]])) == pytest.approx(95 / 105)
    assert similarity(a, np.concatenate([a[50:], a[:50]])) < 0.8
    assert similarity(a, a[:0]) == 0.0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (102, 100)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    got = near_duplicates(documents(odd_rows, extra=True)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(odd_rows)
    assert by[5].class_id == by[6].class_id == 5 and by[5].class_size == 3
    assert next(r for r in got if r.doc_id is None).class_id == 9
    assert by[1].class_size == by[2].class_size == 1
    kept = deduplicated(documents(odd_rows, extra=True))
    assert kept.columns == documents(odd_rows, extra=True).columns
    assert kept.count() == sum(r.kept for r in got) == len(odd_rows) - 3
    assert near_duplicates(documents([])).collect() == []


# tokens


def test_encoder_equals_the_library_on_odd_texts():
    made = random.Random(3)
    parts = [" ", "  ", "\n", " \n", " ", "a", "the", "'s", " '", "don't", "1", "é", "漢", "<|endoftext|>"]
    parts += [".", "\x1c", "\x85", " ", "\U0001d4b3", "\t", "!!"]
    texts = ["".join(made.choices(parts, k=made.randint(0, 12))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(PATH)
    got = Encoder(PATH).encode(pa.array(texts))
    want = [np.array(x.ids, "<u2").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("shard_tokens", [1 << 20, 50])
def test_tokens_come_back(spark, documents, odd_rows, shard_tokens):
    rows = odd_rows + [(40 + k, " ".join(prose(k, 60))) for k in range(80)]
    folder = new_folder(shared_folder(spark))
    write_tokens(documents(rows, extra=True), folder, PATH, shard_tokens=shard_tokens)
    got = token_index(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert len(got) == len(rows)
    start = 0
    for r in got:
        want = ids[r.doc_id]
        assert (r.start, r.n_tokens) == (start, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    some = next(r for r in got if r.doc_id == 45)
    assert read_document(spark, folder, some.shard, some.place) == ids[45]


def test_no_tokens(spark, documents):
    folder = new_folder(shared_folder(spark))
    write_tokens(documents([]), folder, PATH)
    assert token_index(spark, folder).collect() == []


# mixing


def plain_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= most * sizes[s]}
        if not full:
            out.update({s: level * w[s] for s in free})
            break
        out.update({s: most * sizes[s] for s in full})
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, None: 3}, {"a": 5}, {"a": 0, "b": 7}, {"x": 1, "y": 1, "z": 1000}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(table, (1, 2, 3), 3).collect()}
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(documents):
    rows, made = [], random.Random(8)
    for k in range(900):
        source = made.choice(["a"] * 6 + ["b", "c", None])
        rows.append((k, " ".join(prose(k, made.randint(1, 40))), "en", source))
    docs = documents(rows, extra=True)
    got = mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    want, taken = plain_targets(sizes, (1, 2, 3), 3), Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.size == len(split(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    again = {(r.doc_id, r.taken) for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    # whole epochs come first
    for s in sizes:
        copies = {r.copies for r in got if source[r.doc_id] == s and r.size}
        assert max(copies) - min(copies) <= 1
    drawn = mixed(docs)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_quality_leads_the_choice(documents):
    rows = [(k, "good words here" if k % 2 else "1234 5678 90", "en", "a") for k in range(600)]
    rows += [(600 + k, "other words here", "en", "b") for k in range(600)]
    got = mix_sources(documents(rows), weights=(1, 3)).collect()
    chosen = Counter(r.doc_id % 2 for r in got if r.doc_id < 600 and r.copies)
    assert chosen[1] > 5 * chosen[0]


def test_mix_of_odd_rows(documents, odd_rows):
    got = mix_sources(documents(odd_rows, extra=True)).collect()
    assert len(got) == len(odd_rows) and all(r.taken <= 3 * r.size for r in got)
    assert mix_sources(documents([])).collect() == []
    assert mixed(documents([])).collect() == []


# languages


def test_language_of_held_out_texts(documents):
    lines = {
        "de": "der die das und nicht ein eine mit auf für von größe schön straße über",
        "en": "the and not with for from that this which would there their about",
        "fr": "le la les et une avec pour dans que qui être était garçon français",
    }
    rows, made = [], random.Random(2)
    for k in range(300):
        lang = made.choice(list(lines))
        rows.append((k, " ".join(made.choices(lines[lang].split(), k=12)), None if k % 50 == 7 else lang))
    truth = {r[0]: r[1] for r in rows}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = identify(documents(rows, extra=True), held).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        assert set(truth[r.doc_id].split()) <= set(lines[r.lang_pred].split()) and 0.5 < r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_languages_of_odd_rows(documents, odd_rows):
    got = identify(documents(odd_rows, extra=True), F.lit(False)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(odd_rows)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 10))
    assert by[4].lang_pred == "en" and by[7].lang_pred == "de"
    kept = recognised(documents(odd_rows, extra=True))
    assert kept.columns == documents(odd_rows, extra=True).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [4, 5, 5, 6, 7, 8, 9]
    assert identify(documents([]), F.lit(False)).collect() == []
    untaught = identify(documents([(1, "some words")]), F.lit(False)).collect()
    assert [(r.lang_pred, r.score) for r in untaught] == [("und", 0.0)]


def plain_bayes(rows, learned, alpha=0.5):
    """Language and probability of each text, one n-gram at a time."""

    def grams(text):
        kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        kept = " " + " ".join(kept.split()) + " "
        for size in language.SIZES:
            for k in range(len(kept) - size + 1):
                part = kept[k : k + size]
                if part.strip():
                    code = 0
                    for c in part:
                        code = (code * 0x110001 + (0 if c == " " else ord(c)) + 1) % 2**64
                    with np.errstate(over="ignore"):
                        yield int(mix(np.array([code], np.uint64) + np.uint64(size))[0]) >> 49

    counts = {}
    for _, text, lang in learned:
        counts.setdefault(lang, Counter()).update(grams(text))
    docs = Counter(lang for _, _, lang in learned)
    out = {}
    for k, text, _ in rows:
        seen = list(grams(text))
        logs = {
            lang: math.log(docs[lang] / len(learned))
            + sum(math.log((c[g] + alpha) / (sum(c.values()) + alpha * language.BUCKETS)) for g in seen)
            for lang, c in sorted(counts.items())
        }
        best = max(logs, key=logs.get)
        out[k] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if seen else ("und", 0.0)
    return out


@pytest.mark.parametrize("block, chain", [(200, 4), (2, 4), (1, 2)])
def test_languages_against_plain_bayes_in_any_number_of_blocks(documents, monkeypatch, block, chain):
    monkeypatch.setattr(language, "LANGUAGES", block)
    monkeypatch.setattr(language, "CHAIN", chain)
    made = random.Random(5)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efghéä", "dd": "ghijß", "ee": "ijk漢字"}
    rows = []
    for k in range(80):
        lang = made.choice(list(letters))
        text = " ".join("".join(made.choices(letters[lang], k=3)) for _ in range(made.choice([0, 1, 2, 6])))
        rows.append((k, text + made.choice(["", "  12", "."]), lang))
    learned = [r for r in rows if r[0] % 3]
    want = plain_bayes(rows, learned)
    got = identify(documents(rows), F.col("doc_id") % 3 == 0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], rel=1e-4)


def test_copies_of_few_texts_are_drawn_one_by_one(documents):
    english, german = "this is the text that they read", "das ist der Text den sie gelesen haben"
    rows = [(k, english, "en") for k in range(200)] + [(200 + k, german, "de") for k in range(200)]
    got = identify(documents(rows), F.lit(False), train_rows=50).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 200 else "de") for r in got)


def test_texts_in_no_language_are_not_recognised(documents):
    made = random.Random(3)
    words = {
        "en": "the and not with for from that this which would there their about people water house",
        "de": "der die das und nicht ein eine mit auf für von größe schön straße über wasser haus",
    }
    rows = [(k, " ".join(made.choices(words[x].split(), k=40)), x) for k, x in enumerate(["en", "de"] * 150)]
    rows += [(300 + k, " ".join(made.choices(words["en"].split(), k=made.choice([1, 3, 90]))), None) for k in range(30)]
    noise = ["".join(made.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(400)]
    rows += [(1000 + k, " ".join(made.choices(noise, k=40)), None) for k in range(20)]
    kept = {r.doc_id for r in recognised(documents(rows)).collect()}
    assert kept == set(range(330))


# quality


def plain_counts(text, size=8):
    w = split(text)
    seen = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    inside = set()
    for i in range(len(w) - size + 1):
        if seen[tuple(w[i : i + size])] > 1:
            inside |= set(range(i, i + size))
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_the_plain_ones(documents, odd_rows):
    made = random.Random(5)
    rows = odd_rows + [(50 + k, "\n".join(" ".join(prose(made.randint(0, 4), made.randint(0, 9), 6)) for _ in range(12))) for k in range(40)]
    rows += [(90, "a b\na b\n\na b \n#|# 1"), (91, " ".join(["x y z"] * 9))]
    texts = {r[0]: r[1] for r in rows}
    got = judge_quality(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_tells_noise_from_prose(documents):
    common = "the of and to in is that it was for".split()
    made = random.Random(6)

    def text(noise):
        w = [made.choice(common) if made.random() < 0.4 else f"{made.choice('abcdefgh')}{made.choice('aeiou')}rds{k}" for k in range(150)]
        return " ".join(x + "###" if noise else x for x in w)

    rows = [(k, text(k >= 190), "en") for k in range(200)]
    got = {r.doc_id: r.kept for r in judge_quality(documents(rows), QualityRules()).collect()}
    assert all(got[k] for k in range(190)) and not any(got[k] for k in range(190, 200))
    assert judge_quality(documents([])).collect() == []


def test_distance_is_that_of_jensen_and_shannon(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.5, 0.5, 0.0])], "p array<double>, q array<double>, r array<double>")
    row = df.select(distance("p", "q").alias("far"), distance("p", "r").alias("same")).first()
    assert row.far == pytest.approx(1.0) and row.same == pytest.approx(0.0)


# decontamination


def plain_hits(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    known = {}
    for item, text in items:
        w = cut(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w = cut(text)
        hit, found = set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(w) - size + 1):
                if (part := tuple(w[i : i + size])) in known:
                    hit |= set(range(i, i + size))
                    found |= known[part]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 700])
def test_contamination_equals_the_plain_version(spark, documents, odd_rows, chunk_bytes):
    item = " ".join(prose(70, 30))
    items = [(1, item), (2, " ".join(prose(71, 12))), (3, "One!"), (4, "end"), (5, ""), (6, None), (None, "dog lay on"), (1, "漢字かな")]
    items += [(100 + k, " ".join(prose(200 + k, 15))) for k in range(12)]
    rows = odd_rows + [
        (60, "x, " + item.upper().replace(" ", " -- ") + " y"),
        (61, " ".join(item.split()[3:15])),
        (62, " ".join(item.split()[:9])),
        (63, " ".join(prose(71, 12) + prose(205, 15))),
        (64, item + " " + item),
    ]
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS hits")
    docs = documents(rows, extra=True)
    got = contaminated(docs, table, chunk_bytes=chunk_bytes).drop("items").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = plain_hits(rows, items)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    clean = uncontaminated(docs, table, chunk_bytes=chunk_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)


def test_contamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(documents([]), none).collect() == []
    assert [r.contaminated for r in contaminated(documents([(1, "a b")]), none).collect()] == [False]


# the pipeline


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.schema.fieldNames() == docs.schema.fieldNames(), name
        before = after.cache()
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in before.collect())
    clean = before.select("doc_id", "text").distinct()
    assert sum(r.kept for r in near_duplicates(clean).collect()) == clean.count()
    assert not any(r.contaminated for r in contaminated(clean, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect())
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in got)


def test_pipeline_of_odd_rows(spark, documents, odd_rows):
    before = documents(odd_rows, extra=True)
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SMALL)
    assert before.count() > 0


# words that share a polynomial hash


def test_encoder_and_decontamination_go_by_bytes(documents, spark):
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    plain = Tokenizer.from_file(PATH)
    texts = [f"the {x} and the {x}", f"the {y} and", f"{x} {y} {x}", y]
    got = Encoder(PATH).encode(pa.array(texts))
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = Encoder(PATH)
    encoder.encode(pa.array(["one two three"]))
    encoder.bytes = encoder.bytes.copy()
    encoder.bytes[:] = ord("q")  # as if other words had these hashes
    again = encoder.encode(pa.array(["one two three"]))
    assert np.frombuffer(again[0], "<u2").tolist() == plain.encode("one two three", add_special_tokens=False).ids
    one, other = (" ".join(f"{w}{k}" for k in range(12)) for w in (x, y))
    items = spark.createDataFrame([(1, one)], "item_id int, text string")
    found = contaminated(documents([(1, other), (2, f"so {one} it is")]), items).collect()
    assert {r.doc_id: (r.n_hit, r.n_items) for r in found} == {1: (0, 0), 2: (12, 1)}


def test_only_odd_words_are_read_one_by_one(monkeypatch):
    asked, plain = [], Encoder._plain
    monkeypatch.setattr(Encoder, "_plain", lambda self, word: asked.append(word) or plain(self, word))
    texts = [" ".join(f"w{k}{c}" for k in range(300)) for c in "abc"] + ["a   b é  Zoë", "x \ty z\n", "é", "ü b", ""]
    encoder = Encoder(PATH)
    want = [np.array(x.ids, "<u2").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts)) == want and encoder.encode(pa.array(texts[::-1])) == want[::-1]
    assert 0 < len(asked) < 20
    added = encoder.added[0]
    held = [f"one{added} two {added}", f"three {added[:1]} {added[1:]}", "four five"]
    want = [np.array(x.ids, "<u2").tobytes() for x in encoder.tokenizer.encode_batch(held, add_special_tokens=False)]
    assert encoder.encode(pa.array(held)) == want

"""Quality rules in DataFrame functions only: plain counts per document, and the
Jensen-Shannon distance of its histograms of character classes and of common
words to those of its language.

The references are learned from the documents themselves: per language the
character classes and the most frequent words, summed over all its documents.
A text is judged by a histogram only if it is long enough for one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Character classes of the histogram; what none of them holds is a class of its own.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>]"}
NAMES = [*CLASSES, "space"]
MAX_LANGUAGES = 1000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: words of the histogram of common words, and documents shorter than this are not judged by it
    top_words: int = 20
    common_min_words: int = 100
    class_min_chars: int = 200
    #: largest distances kept, 0 to 1
    max_class_distance: float = 0.25
    max_common_distance: float = 0.28


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))


def _repeat_words(size: int) -> Column:
    """Words of ``words`` inside windows of ``size`` that occur twice or more.
    A window's hash is made from those of its halves; without a repeated half
    there is no repeated window, and hashes are sorted only if one is repeated."""

    def longer(hashes: str, have: int, want: int) -> str:
        step = want - have
        return f"zip_with(slice({hashes}, 1, size({hashes}) - {step}), slice({hashes}, {step + 1}, size({hashes}) - {step}), (a, b) -> xxhash64(a, b))"

    lengths = [size]
    while lengths[0] > 1:
        lengths.insert(0, -(-lengths[0] // 2))
    pairs = "array_sort(transform(hashes, (h, i) -> struct(h, i)))"
    again = (
        "array_sort(transform(filter(transform(pairs, (p, k) -> struct(p.i AS at, "
        "(k > 0 AND pairs[k - 1].h = p.h) OR (k < size(pairs) - 1 AND pairs[k + 1].h = p.h) AS twice)), "
        "x -> x.twice), x -> x.at))"
    )
    covered = f"aggregate(transform(at, (p, k) -> least({size}, coalesce(get(at, k + 1) - p, {size}))), 0L, (s, x) -> s + x)"
    # each step is a one-element array, so that it is computed once
    steps = f"get(transform(array({again}), at -> {covered}), 0)"
    steps = f"get(transform(array({pairs}), pairs -> {steps}), 0)"
    steps = f"CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE {steps} END"
    for have, want in reversed(list(zip(lengths, lengths[1:]))):
        hashes = "word_hashes" if have == 1 else f"h{have}"
        made = "hashes" if want == size else f"h{want}"
        if size // 2 <= want < size:  # no half occurs twice; shorter runs of words nearly always do
            steps = f"CASE WHEN size(array_distinct({made})) = size({made}) THEN 0L ELSE {steps} END"
        steps = f"get(transform(array({longer(hashes, have, want)}), {made} -> {steps}), 0)"
    return F.expr(f"CASE WHEN n_words < {size + 1} THEN 0L ELSE {steps} END")


def _plain(docs: DataFrame, rules: QualityRules) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        text.alias("text"),
        _words("text").alias("words"),
    )
    rows = rows.withColumn("n_words", F.size("words")).withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = [(F.length("text") - F.length(F.regexp_replace("text", f"{p}+", ""))).alias(k) for k, p in CLASSES.items()]
    return rows.select(
        "doc_id",
        "lang",
        "words",
        "word_hashes",
        "n_words",
        F.length("text").alias("n_chars"),
        *counts,
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        _repeat_words(rules.window).alias("n_repeat_words"),
    )


def _shares(names: list[str], total: str) -> Column:
    """Histogram of the classes, the rest last, as shares."""
    parts = [F.col(x).cast("double") for x in names]
    rest = F.col(total) - sum(parts[1:], parts[0])
    return F.transform(F.array(*parts, rest), lambda x: x / F.greatest(F.col(total).cast("double"), F.lit(1.0)))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length."""
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0D END"
    term = f"{half.format('a', 'b')} + {half.format('b', 'a')}"
    total = f"aggregate(zip_with({p}, {q}, (a, b) -> {term}), 0D, (s, x) -> s + x)"
    return F.expr(f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0D, {total} / 2)) END")


def _word_references(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """Per language (and for all together, key empty): ``top``, the most
    frequent words (ties by word), and ``word_ref``, their shares of all words
    and that of the rest."""
    source = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    words = source.select("lang", F.explode(_words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = staged(words, "quality-words")

    keyed = words.where("lang IS NOT NULL").select(F.concat(F.lit("l"), "lang").alias("key"), "word", "n")
    keyed = keyed.unionByName(words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("").alias("key"), "word", "n"))
    best = [F.col("n").desc(), F.col("word")]
    # the most frequent of each slice first, so that no language is sorted in one task
    slice_of = F.pmod(F.xxhash64("word"), F.lit(256))
    ahead = keyed.withColumn("slice", slice_of)
    ahead = ahead.withColumn("r", F.row_number().over(Window.partitionBy("key", "slice").orderBy(*best))).where(F.col("r") <= rules.top_words)
    top = ahead.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*best))).where(F.col("r") <= rules.top_words)
    totals = keyed.groupBy("key").agg(F.sum("n").alias("n_all"))
    top = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("t")).join(totals, "key")
    share = F.transform("t", lambda x: x["n"] / F.col("n_all"))
    rest = 1 - F.aggregate(share, F.lit(0.0), lambda s, x: s + x)
    return top.select("key", F.transform("t", lambda x: x["word"]).alias("top"), F.concat(share, F.array(rest)).alias("word_ref"))


def _class_references(rows: DataFrame) -> DataFrame:
    """Per key ``class_ref``, the shares of the character classes."""
    names = [*NAMES, "n_chars"]
    by_key = rows.groupBy("key").agg(*[F.sum(x).alias(x) for x in names])
    every = by_key.groupBy().agg(*[F.sum(x).alias(x) for x in names]).withColumn("key", F.lit(""))
    both = by_key.where("key <> ''").unionByName(every)
    return both.select("key", _shares(NAMES, "n_chars").alias("class_ref"))


def judge_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Quality of every text of ``docs`` (``doc_id``, ``text``, ``lang``).

    Returns ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines`` (lines equal to an earlier one), ``n_repeat_words`` (words
    in windows found twice in the text), ``class_distance`` and
    ``common_distance`` (null where the text is too short to be judged),
    ``base_failed`` and ``kept``. A null text counts as empty, which fails; a
    text of null language is compared with all languages together. Repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    known = staged(_word_references(docs, rules), "quality-references")
    known = known.withColumn("hashed", F.transform("top", lambda w: F.xxhash64(w)))
    # references of so many languages travel to the tasks; those of more are joined by shuffle
    sent = F.broadcast if known.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES else lambda df: df
    rows = _plain(docs, rules).withColumn("key", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")))
    rows = rows.withColumn("space", F.col("n_chars") - F.col("word_chars"))
    rows = rows.join(sent(known.withColumnRenamed("key", "key_")), F.col("key") == F.col("key_"), "left")
    # by hash first, which is quicker than by word
    at = "filter(zip_with(word_hashes, words, (h, w) -> (CASE WHEN array_contains(hashed, h) THEN array_position(top, w) ELSE 0L END)), x -> x > 0)"
    hist = "transform(sequence(1L, cast(size(top) AS bigint)), k -> (size(at) - size(array_remove(at, k))) / cast(n_words AS double))"
    hist = f"get(transform(array({at}), at -> concat({hist}, array(1 - size(at) / cast(n_words AS double)))), 0)"
    long_enough = (F.col("n_words") >= rules.common_min_words) & F.col("top").isNotNull()
    rows = rows.withColumn("word_hist", F.when(long_enough, F.expr(hist)))
    columns = ["doc_id", "key", "n_words", "n_chars", "word_chars", *NAMES, "n_dup_lines", "n_repeat_words"]
    # the class references come from these counts: the texts are not read again
    rows = staged(rows.select(*columns, distance("word_hist", "word_ref").alias("common_distance")), "quality-counts")
    classes = sent(_class_references(rows).withColumnRenamed("key", "key_"))
    rows = rows.join(classes, F.col("key") == F.col("key_"), "left").withColumn("class_hist", _shares(NAMES, "n_chars"))
    rows = rows.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        "word_chars",
        F.col("symbol").cast("bigint").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.when(F.col("n_chars") >= rules.class_min_chars, distance("class_hist", "class_ref")).alias("class_distance"),
        "common_distance",
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False))
    far = far | F.coalesce(F.col("common_distance") > rules.max_common_distance, F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)

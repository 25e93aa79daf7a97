"""The registered queries of the operators over the given tables, and SQL for
those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.runtime import shared_folder

from .decontaminate import contaminated
from .language import identify
from .licenses import scan_licenses
from .lm import score_texts
from .mixing import mix_sources
from .neardup import near_duplicates
from .negatives import hard_negatives
from .quality import judge_quality
from .ranking import ranked
from .secrets import scan_secrets
from .substring import remove_repeats
from .tokens import new_folder, token_index, write_tokens
from .toxicity import toxicity

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 1


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), remainder(5))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep_text=False).drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(shared_folder(spark))
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path(TOKENIZER))
    return token_index(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), remainder(3))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), items).drop("items")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_minhash_dedup,
        op3_substring_dedup,
        op4_secret_scan,
        op5_license_scan,
        op6_token_output,
        op7_source_mix,
        op8_language_id,
        op9_quality_rules,
        op10_decontamination,
        op11_ranked_search,
        op12_hard_negatives,
        op13_toxicity,
    )
}


#: Terms of ``documents`` (``d``, ``n`` by row) and of ``benchmark`` (``i``), and the sums over them.
RANKED_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM docs) GROUP BY r, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM d GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
q AS (SELECT DISTINCT i, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM items),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM d, whole GROUP BY term, docs),
m AS (SELECT r, 10 + (90 * n * docs) // length AS m FROM n, whole),
s AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN d USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM s JOIN docs USING (r) JOIN items USING (i) WHERE score > 0)
WHERE rank <= 10
""".format(
    lower="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    term=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
)


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same)
  WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
WHERE rank <= 3
"""


def oracle() -> dict[str, str]:
    return {"op11_ranked_search": RANKED_SQL, "op12_hard_negatives": NEGATIVES_SQL}

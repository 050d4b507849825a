"""The thin queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.bpe import bpe_round_trip
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.license_scan import license_scan
from lodeseek.llm.line_dedup import drop_similar_lines
from lodeseek.llm.mixing import MOST, SEED, mix_report
from lodeseek.llm.ngram_lm import lm_scores
from lodeseek.llm.pii import pseudonymise
from lodeseek.llm.quality_rules import COUNTS, fit_rules, judge
from lodeseek.llm.setsketch import near_duplicates
from lodeseek.llm.token_files import read_token_files, write_token_files
from lodeseek.plans.staging import stage_path

#: File of the public tokenizers package that operators 7 and 9 use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    write_token_files(_documents(spark, sf_dir), tokenizer_path(), path)
    return read_token_files(spark, path)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir).select("doc_id", "text"))


def bpe_digests(docs: DataFrame, *more: str) -> DataFrame:
    """Encode and decode texts; the digests of ids and of decoded texts, and the columns named."""
    return bpe_round_trip(docs, tokenizer_path()).select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("own.doc_id", *COUNTS, "base_failed", "kept", "rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), '{SEED}', coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source
), filled AS (
  SELECT source, s, w,
         sum(s) OVER () - {MOST} * coalesce(sum(s) OVER o, 0) AS l,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ws
  FROM sources WINDOW o AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), units AS (
  SELECT *, {MOST} * s * ws < w * l AS is_full, max(CASE WHEN {MOST} * s * ws >= w * l THEN l::DOUBLE / ws END) OVER () AS unit FROM filled
), targets AS (
  SELECT source, s, CASE WHEN is_full THEN ({MOST} * s)::DOUBLE ELSE w * unit END AS target FROM units
), plan AS (
  SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), {MOST}) ELSE 0 END AS whole FROM targets
), shares AS (
  SELECT *, target - whole * s AS rest, CASE WHEN s > 0 THEN (target - whole * s) / s ELSE 0 END AS share FROM plan
), ranked AS (
  SELECT z.*, p.s, p.target, p.whole, p.rest,
         CASE WHEN share > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS rnk
  FROM sized z JOIN shares p ON z.source IS NOT DISTINCT FROM p.source
), passed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked
)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (whole + CASE WHEN rnk IS NOT NULL AND before::DOUBLE + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM passed
"""


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=3, similarity=0.85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), c AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    words = F.col("places.word")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.likeness"), F.lit(0.0))).alias("score"),
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir))


#: A key for these queries only; a user of the operator brings a secret one.
PII_KEY = "public test key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, one=True)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_similar_lines(_documents(spark, sf_dir).select("doc_id", "text"), least=1)

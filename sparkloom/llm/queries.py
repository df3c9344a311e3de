"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, fingerprint, html_extract, language_id, mixing, near_dedup, neighbours, quality, token_output, toxicity, url_filter, whitening

#: The rules that the url query applies, as (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Weights of the sources in order of name, repeating.
SOURCE_WEIGHTS = [5, 2, 1]


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file of a public tokenizer, where the installed package keeps it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_read_back(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_html_extraction, op3_near_dedup, op4_mixing, op5_token_output, op6_fingerprints, op7_decontamination, op8_quality_classifier, op9_url_filter, op10_language_id, op11_alignment, op12_whitening, op13_neighbours]
    return {f.__name__: f for f in found}


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS lvl, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY lvl, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(w) OVER (ORDER BY lvl, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s3),
s5 AS (SELECT *, (SELECT free FROM s4 WHERE free <= lvl ORDER BY lvl, r LIMIT 1) AS met FROM s4),
s AS (SELECT source, r, source_size, least(cap, coalesce(met, lvl) * w) AS target FROM s5),
q AS (SELECT d.doc_id, d.size, d.k, s.r, s.source_size, s.target,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT *, (cum + source_size * i)::DOUBLE / nullif(target, 0) AS f FROM q, (VALUES (0), (1)) AS v(i)),
c AS (SELECT *, sum(CASE WHEN f IS NULL THEN 0 ELSE size END) OVER (ORDER BY f NULLS LAST, r, k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(CASE WHEN f IS NOT NULL AND upto <= (SELECT sum(target) FROM s) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM c GROUP BY doc_id
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT h.*, r.verdict, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS n
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op9_url_filter": OP9_SQL}

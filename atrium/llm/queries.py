"""The registered queries of this subpackage, and their SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language_id, merkle, mixing, ngram_join, quality, secrets, toxicity, url_filter, vector_dedup, whitening
from .common import table

PREDICT_AT = 0.7
RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _held_out(folds: int, rest: int):
    """Is a row kept from learning? A row without an id is not, though no label names it."""
    return F.coalesce(_fold(folds) == rest, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_dedup(docs, carry=["text_sha256"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(_fold(4) != 2))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.learn(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), model)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(_fold(3) != 1))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"text": merkle.lower_ascii(F.col("text"))}, tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_mix_sources, op3_ngram_jaccard, op4_quality, op5_decontaminate, op6_url_filter, op7_language_id, op8_toxicity, op9_chat_format, op10_secret_scan, op11_whitening, op12_vector_dedup, op13_merkle_manifest)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_url_filter": """
        WITH cut AS (
          SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
          SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(verdict, rhost, rpath) AS (
          VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        globs(ord, pattern, hostlike, pathlike) AS (
          VALUES (0, '*pills*^*', '%pills%', '%'), (1, '*casino*^*', '%casino%', '%'), (2, '*viagra*^*', '%viagra%', '%'), (3, '*.xxx^*', '%.xxx', '%'),
                 (4, '*porn*^*', '%porn%', '%'), (5, '*betting*^*', '%betting%', '%'), (6, '*free-download*^*', '%free-download%', '%'),
                 (7, '*^*/wp-login*', '%', '%/wp-login%'), (8, '*^*/cgi-bin/*', '%', '%/cgi-bin/%')),
        judged AS (
          SELECT p.page_id, p.host, p.path,
                 (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) FROM rules
                  WHERE (p.host = rhost OR p.host LIKE '%.' || rhost) AND starts_with(p.path, rpath)) AS r,
                 (SELECT min_by(pattern, ord) FROM globs WHERE '.' || p.host LIKE hostlike AND p.path LIKE pathlike) AS g
          FROM parts p)
        SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN g IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN r IS NULL THEN g END AS pattern FROM judged""",
    "op9_chat_format": chat.chat_sql(),
    "op13_merkle_manifest": merkle.MANIFEST_SQL,
}

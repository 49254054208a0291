"""The registered queries of this subpackage, one for each operator, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, language_id, media, merkle, oracle, packing, secrets, simhash, substrings, suffix_tree, top_k, toxicity, url_filters
from .common import ASCII_LOWER, ASCII_UPPER, crc32_mod, literal_rows, table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, URL_RULES, ["host", "path", "verdict"])
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    net = language_id.learn(docs, usable=~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.languages(rows, net, keep=("doc_id", "held_out"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=crc32_mod("doc_id", 3) != 1)
    rows = docs.select("doc_id", "text", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return toxicity.toxic_scores(rows, model, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc32_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"))
    corpus = suffix_tree.learn(docs, ~F.col("held_out"))
    return suffix_tree.blended(suffix_tree.scores(docs, corpus, keep=("doc_id", "held_out"))).withColumn("train_tokens", F.lit(corpus.total).cast("long"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.translate("text", ASCII_UPPER, ASCII_LOWER)
    changed = merkle.leaf_digest(*[F.col(c) for c in fields[:-1]], F.when(crc32_mod("doc_id", 5) == 0, tampered).otherwise(F.col("text")))
    found = merkle.manifest(table(spark, sf_dir, "documents"), fields=fields, tree="source", order="doc_id", keep={"now": changed})
    found = found.withColumns({"proof_sha256": merkle.siblings_digest(F.col("proof")), "folded_root": merkle.folded(F.col("now"), F.col("proof"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = centroids.clustered(table(spark, sf_dir, "embeddings"), 8, dims=64)
    return centroids.with_inertia(found.drop("place"), centres)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_media_columns, op3_exact_top_k, op4_best_fit_packing, op5_language_id, op6_toxicity, op7_simhash_near_dedup, op8_lm_scoring, op9_secret_scans, op10_bpe, op11_merkle_manifest, op12_centroid_clustering, op13_substring_dedup)}

ORACLE: dict[str, str] = {
    "op1_url_filters": r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS row_no,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY row_no ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS place
  FROM parts p LEFT JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fit WHERE place = 1""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5""",
    "op11_merkle_manifest": oracle.merkle_sql(),
    "op12_centroid_clustering": oracle.clustering_sql(),
    "op13_substring_dedup": oracle.substring_sql(),
}

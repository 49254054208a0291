"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read by the next.

toxicity: documents scored 0.7 or more go. language: documents without a letter, or whose
best language has a probability under ``LEAST_LANGUAGE``, go (if nothing can be learned, only the former). near_dedup: of each
group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays. secrets: spans found are replaced in
the text. packing: the documents' tokens are packed into sequences (one row for each piece).

Cases: null texts and ids pass as the stages' operators state; of near copies those with null ids stay last; of
repeated rows one stays; columns beside those of ``documents`` are left out; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, packing, secrets, simhash, toxicity
from .common import saved, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE = 0.4
WORDS, SIMILARITY = 5, 0.8
#: Chunks that a packing task remembers: executors hold what earlier stages left, too, and time is spared elsewhere.
CACHED = 100_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_scores(docs, model, keep=tuple(COLUMNS)).where("score < 0.7").select(*COLUMNS)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    net = language_id.learn(docs)
    if net is None:
        return docs.where(has_letter(F.col("text"))).select(*COLUMNS)
    kept = language_id.languages(docs, net, keep=tuple(COLUMNS))
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, unique, in the order of ids (null last), and the same whenever it is read: with a row's place in its file, or else a written number."""
    own = [F.col("doc_id").isNull().alias("none"), F.col("doc_id")]
    try:
        return docs.select(*COLUMNS, F.struct(*own, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row"))
    except AnalysisException:  # not a table of files
        return saved(docs.select(*COLUMNS, F.struct(*own, F.monotonically_increasing_id().alias("at")).alias("row")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = numbered(docs)
    groups = simhash.near_duplicates(rows.select("row", "text"), id_col="row", words=WORDS, similarity=SIMILARITY)
    gone = saved(groups.where("row != component_id").select("row"))
    few = gone.count() <= simhash.MOST_BROADCAST
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = secrets.secret_spans(docs, keep=("doc_id", "lang", "source", "n_chars"), clean=True)
    changed = F.col("spans") != ""
    return done.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to balanced shards: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontam, langid, mixing, sharding, simhash
from panelwright.llm.common import held_out, written

#: A text of so many letters is rejected if no language explains it better than this.
MOST_PHRASES, LEAST_LETTERS = 0.6, 40
#: Texts are near copies if so much of their shingles of so many words is common to both.
SIMILARITY, SHINGLE_WORDS = 0.8, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no learned language, and so those that are null, empty or without a letter; fills a missing ``lang``."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns])
    found = langid.identify(rows, model, keep=rows.columns, text_col="_in_text")
    odd = (F.col("phrase_rate") > MOST_PHRASES) & (F.col("letters") >= LEAST_LETTERS)
    kept = found.where((F.col("lang_pred") != "und") & ~odd).withColumn("_in_lang", F.coalesce("_in_lang", "lang_pred"))
    return kept.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class: near by fingerprint, or by overlap of word shingles."""
    return simhash.keep_one(docs, similarity=SIMILARITY, overlap_words=SHINGLE_WORDS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, and drops texts that are mostly such passages."""
    cut = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's ``shard`` and its ``slot`` in that shard; columns of those names give way."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot", "_size", "_crc", "_shard", "_slot")]
    found = sharding.assign(docs, keep=keep)
    return found.select(*keep, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Language identification and fingerprints can't be expressed in SQL; ``tests/llm`` holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; without documents, an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k < len(STAGES) - 1 else docs
    return docs

"""The queries of this subpackage: each operator over its whole table, under its contract."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, collocations, decontam, langid, mixing, pieces, pii, sharding, simhash, tokens, toxicity, url_filter
from .common import held_out, salted_join

URL_RULES = [
    url_filter.Rule("com/", True),
    url_filter.Rule("example.com/en/", False),
    url_filter.Rule("www.example.com/en/", True),
    url_filter.Rule("net/es/", False),
    url_filter.Rule("net/fr/", False),
]
PII_KEY = "panelwright-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ruled_urls(pages: DataFrame) -> DataFrame:
    """Urls that a rule decides, labelled by it (1.0: block)."""
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    found = pages.select("url", url_filter.matched_rule(host, path, URL_RULES).alias("rule")).where("rule is not null")
    return found.select("url", F.col("rule").isin([r.spec for r in URL_RULES if not r.allow]).cast("double").alias("label"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, ruled_urls(pages), URL_RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = langid.learn(docs.where(~out))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score", "phrase_rate")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs.where(~out), labels)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hit_words(F.col("_spans"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        decontam.items_digest(F.col("_items")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return found.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > 4096).alias("over_limit"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY, keep=["doc_id"])
    return found.select("doc_id", F.col("_text").alias("text"), F.col("_found").alias("n_found"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = found.groupBy("label").agg(F.sum("_error").alias("label_error"))
    joined = salted_join(found, totals, ["label"], F.struct("vec_id", "_code"))
    return joined.select("vec_id", F.lower(F.hex("_code")).alias("code"), F.col("_error").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode_ids(pieces.encode_texts(table(spark, sf_dir, "documents"), path, keep=["doc_id"]), path)
    return found.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_language_id, op3_toxicity, op4_decontamination, op5_simhash, op6_token_counts,
        op7_nearest_neighbours, op8_source_mix, op9_shards, op10_pii_surrogates,
        op11_vector_codes, op12_sentence_pieces, op13_collocations, pipeline,
    )
}

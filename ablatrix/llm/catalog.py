"""The queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from . import context_weighting, decontamination, hard_negatives, license_scan, merkle, near_dedup, oracles, packing, quality_classifier, quality_rules, sharding, toxicity, warc, wavelet
from .common import key_share, table, whole

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    CATALOG[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(key_share("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", (key_share("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(key_share("doc_id", 4) != 2)
    vectors, network = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, vectors, network)
    return scored.select(
        "doc_id", (key_share("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op4_context_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_weighting.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.drop("n_bytes")


@query
def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = wavelet.write_shards(docs, public_tokenizers.path(TOKENIZER), end_id=2)
    read = wavelet.read_documents(spark.read.parquet(path))
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)
    return packed.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return moved.select(
        "doc_id", "size", F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.captures(warc.read_records(spark, path))
    fields, response = F.col("metadata")["fields"], F.col("response")
    # A response is measured by its own payload; a revisit states what it refers to.
    own = response["type"] == "response"
    return found.select(
        fields["page"].cast("long").alias("page_id"),
        F.when(own, response["payload_bytes"]).otherwise(fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.when(own, response["payload_sha1"]).otherwise(response["digest"]).alias("payload_digest"),
        response["type"].alias("record_type"),
        fields["refers-to-page"].cast("long").alias("refers_to"),
    )


ORACLES["op8_warc"] = oracles.warc_sql()


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    features = stage(quality_rules.document_features(docs).drop("text"), "features")
    judged = quality_rules.verdicts(features, quality_rules.language_references(features))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES["op9_quality_rules"] = oracles.quality_rules_sql()


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontamination.items_digest(F.col("items")).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


ORACLES["op10_decontamination"] = oracles.decontamination_sql()


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


ORACLES["op11_license_scan"] = oracles.license_sql()


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(key_share("doc_id", 3) == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    proved = merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": tampered})
    return proved.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


ORACLES["op12_merkle_manifest"] = oracles.merkle_sql()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", noisy.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding")


ORACLES["op13_hard_negatives"] = oracles.hard_negatives_sql()

"""The registered queries of this subpackage: each operator over its whole table, by the contract of its result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    centroids, decontaminate, html_extract, jaccard_join, line_dedup, lm_score, minhash, quality_rules, secret_scan, sentencepiece_codec, sharding,
    token_counts, vector_codes)
from .oracles import CENTROIDS_SQL, CODES_SQL

PIECE_MODEL = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back (a null text: the empty one)."""
    import public_tokenizers

    model = sentencepiece_codec.read_model(public_tokenizers.path(PIECE_MODEL))
    spaced = F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" ")))
    ids = sentencepiece_codec.encode(docs.select("doc_id", "text", spaced.alias("_was")), model)
    back = sentencepiece_codec.decode(ids.withColumn("_ids", F.col("ids")), model, "_ids", "text")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("text") == F.col("_was")).alias("round_trip"))


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    q = lambda c: F.col(f"_quality.{c}").alias(c)
    return judged.select(
        "doc_id", q("n_words"), q("word_chars"), q("n_symbols"), q("n_dup_lines"), q("n_repeat_words"), q("base_failed"), F.col("_kept").alias("kept"),
        (F.col("_quality.score") / quality_rules.SCALE).alias("log_ratio"))


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), F.array_join("_removed", ",").alias("removed_lines"), "text")


def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf, "pages").select("page_id", "url", "html")).drop("html")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf, "documents"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf, "documents"), TOKENIZER, token_counts.cache_folder(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.group_texts(table(spark, sf, "documents"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"))
    told = ",".join(str(x) for book in books for entry in book for x in entry)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    placed = centroids.cluster_vectors(table(spark, sf, "embeddings"))
    told = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(told.cast("binary"), 256).alias("centroid_sha256"))


def op13_minhash(spark: SparkSession, sf: str) -> DataFrame:
    grouped = minhash.group_texts(table(spark, sf, "documents"))
    return grouped.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sentencepiece, op2_quality_rules, op3_sharding, op4_decontamination, op5_secret_scan, op6_line_dedup, op7_html_extraction, op8_lm_score, op9_token_counts,
    op10_jaccard_join, op11_vector_codes, op12_centroids, op13_minhash)}
#: SQL where DuckDB has the functions it takes; the other queries are tested by brute force in tests/llm.
ORACLE: dict[str, str] = {"op11_vector_codes": CODES_SQL, "op12_centroids": CENTROIDS_SQL}

"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridlake.llm import decontaminate, jaccard_join, line_dedup, quality_rules
from gridlake.llm.queries import encoded, table
from gridlake.session import ensure_checkpoint_dir


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, text, key): a row's key sorts by doc_id, null first, and holds 128 bits of the whole row, so only equal rows share one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sortable = F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    key = F.concat(sortable, F.lit("-"), F.hex(F.xxhash64(row)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "text", row)))
    return docs.select(row.alias("row"), "text", key.alias("key"))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; null ids and repeated rows are judged by their text; no documents, none back."""
    judged = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.only_kept(judged).select(*[F.col(f"`{c}`") for c in docs.columns])


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; n_chars follows the text.

    A null text stays null; of repeated rows the first keeps its lines; a text of which nothing is left stays as the empty one.
    """
    done = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id. Texts without words are linked with nothing and stay.

    A null id is the smallest; of rows equal in all columns one stays, unless they have no words.
    """
    keyed = _keyed(docs)
    groups = jaccard_join.group_texts(keyed.select("key", "text"), id="key").distinct()
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    judged = keyed.withColumn("turn", turn).join(groups, "key")
    stays = (F.col("n_shingles") == 0) | ((F.col("key") == F.col("component_id")) & (F.col("turn") == 1))
    return judged.filter(stays).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. Null and empty texts hold none and stay, as do repeated rows."""
    keyed = _keyed(docs)
    found = decontaminate.find_items(keyed.select("key", "text"), table(spark, sf_dir, "benchmark"), carry=("key",))
    return keyed.join(found.filter("n_hit > 0").select("row.key").distinct(), "key", "left_anti").select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the round trip of each document, one row each; a null text is the empty one and has no ids."""
    return encoded(docs)


STAGES = [
    ("quality_rules", filter_quality),
    ("line_dedup", delete_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_texts),
]

#: Hashes, suffix ranks and piece lattices have no DuckDB counterpart; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again by the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

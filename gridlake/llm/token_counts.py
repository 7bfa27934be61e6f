"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .arrays import steps

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=4)
def _tokenizer(name: str, path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=_place(name, path))
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_place(name, path))
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _place(name: str, path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str, path: str | None = None) -> str:
    """SHA-256 of the tokenizer's file: another version of it is another tokenizer."""
    with open(_place(name, path), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the content as the tokenizer sees it. The file has no normaliser, so only null becomes the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def cache_folder(spark: SparkSession) -> str:
    """The cache that ``spark.gridlake.tokenCache`` names, kept from run to run; else a new one below the checkpoint folder, empty at first."""
    return spark.conf.get("spark.gridlake.tokenCache", None) or f"{ensure_checkpoint_dir(spark)}/token_counts-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing was stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_counts(df: DataFrame, name: str, path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` (its other columns) with n_tokens, counted by the tokenizer's own library, whole texts, without added special tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(name, path)
        for batch in batches:
            for part in steps(batch, text, 1 << 20):
                counts = encode([t or "" for t in part.column(text).to_pylist()])
                rest = part.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(counts, pa.int64())], [*rest.schema.names, "n_tokens"])

    return df.mapInArrow(count, df.drop(text).schema.add("n_tokens", "long"))


def count_tokens(
    df: DataFrame, name: str, cache: str | None = None, path: str | None = None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``carry`` columns, n_bytes and n_tokens of each row.

    Contents are looked up by (tokenizer digest, content digest) in the table at ``cache``; each distinct content that misses is encoded
    once and appended, one row however many copies there are. Without ``cache`` nothing is stored and all distinct contents are
    misses. Texts are shuffled once, by digest, and meet the cache there; copies of one text arrive as one row for each task. If a task or job is
    repeated, a count may be stored twice; readers take one.

    Null counts as the empty text (0 tokens). Repeated rows get a row each, extra columns are left out unless carried.
    """
    spark = df.sparkSession
    version = tokenizer_digest(name, path)
    known = spark.createDataFrame([], CACHE_SCHEMA) if cache is None else read_cache(spark, cache)
    known = known.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    content = df.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    content = content.withColumn("digest", content_digest(F.col("_text")))
    distinct = content.groupBy("digest").agg(F.any_value("_text").alias("_text"))
    misses = distinct if cache is None else distinct.join(known, "digest", "left_anti")  # grouped by digest already: no further shuffle
    fresh = cut_lineage(encode_counts(misses, name, path, "_text"))
    if cache is not None:
        fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = fresh if cache is None else known.unionByName(fresh)
    rows = content.select(*[f"_c{i}" for i in range(len(carry))], "digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    joined = rows.join(counts, "digest", "left")
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "n_tokens")

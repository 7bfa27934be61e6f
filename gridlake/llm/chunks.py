"""Chunks: rows packed into compressed blocks of bounded size that keep their identity from one stage to the next.

An operator that needs figures of the whole corpus for every token of a text asks for them once a chunk: a chunk sends its distinct
hashes, sorted, to the buckets of a hash range each, and gets one figure for each of them back, in the same order. So what is
shuffled is distinct hashes of a chunk, not tokens, and no table of the corpus is ever held in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir
from .arrays import steps

#: Bytes of text in a chunk, before compression; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


def squeeze(values: np.ndarray) -> bytes:
    """Small numbers, compressed: bytes of equal weight lie together."""
    width = values.dtype.itemsize
    return zstandard.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), 3)


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(dtype)


def written(df: DataFrame, key: str, deal: bool = True) -> DataFrame:
    """``df`` as a table in the checkpoint folder, bucketed by ``key``: what is later joined or grouped by it need not be shuffled.

    Rows are dealt to their buckets first, so that a bucket is one file; with few large rows (``deal`` False) each task writes its own.
    The table's name is dropped again, its files stay as checkpoints do.
    """
    spark = df.sparkSession
    name = f"gridlake_{uuid.uuid4().hex}"
    place = f"{ensure_checkpoint_dir(spark)}/{name}"
    dealt = df.repartition(buckets_for(df), key) if deal else df
    dealt.write.format("parquet").option("path", place).bucketBy(buckets_for(df), key).saveAsTable(name)
    table = spark.table(name)
    table.schema  # settles the plan
    spark.sql(f"DROP TABLE {name}")
    return table


def freeze(df: DataFrame, text: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, payload): all rows of ``df``, written to the checkpoint folder, so that a chunk is the same wherever it is read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])

        for batch in batches:
            for part in steps(batch, text):
                if held and size + part.nbytes > limit:
                    yield packed()
                    held, size, at = [], 0, at + 1
                held.append(part)
                size += part.nbytes
        if held:
            yield packed()

    return written(df.mapInArrow(pack, "chunk long, payload binary"), "chunk", deal=False)


def batches_of(payload: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(payload))


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted ``keys`` of so many bits; buckets are equal ranges of the key."""
    starts = np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], dtype=keys.dtype)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]]).astype(np.int64)


def buckets_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def requests(frozen: DataFrame, ask: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``ask`` for each chunk: what it wants to know from each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                rows = [{"chunk": chunk, **row} for row in ask(payload.as_buffer())]
                yield pa.RecordBatch.from_pylist(rows, kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return frozen.mapInArrow(run, schema)


def answered(frozen: DataFrame, answers: DataFrame, work: Callable[[bytes, pa.Table], pa.Table], schema: object) -> DataFrame:
    """``work`` of each chunk's payload and the answers to it, in the order of their buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.column("payload")[0].as_buffer(), right.sort_by("bucket"))

    return frozen.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

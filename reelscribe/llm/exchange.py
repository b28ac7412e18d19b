"""Packed exchange of 64-bit keys between chunks of documents and buckets of the key space.

A chunk is a hash class of rows, holding a bounded amount of text. What a chunk asks or tells about its
keys travels as one binary column per (chunk, bucket) of the key space, sorted, so that a shuffle of
hundreds of millions of keys moves a few bytes each and no row objects. A key that every document has
reaches its bucket once per chunk, not once per document, so no bucket grows with one key's frequency.

``chunked`` deals rows by a hash of doc_id and text; rows that needn't meet can instead stay where they are scanned, as
compressed ``blocks`` that are written once, in buckets of their names, where the answers come to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import kept_by
from .words import as_array, slices

#: Bytes of text per chunk and per bucket.
CHUNK, BUCKET = 8 << 20, 16 << 20


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def row_key():
    """Equal for rows of equal doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(0), F.col("text").cast("string"))


def chunked(docs: DataFrame, total: int, *more, size: int = CHUNK, least: int = 48) -> DataFrame:
    """``chunk, doc_id, text`` and what ``more`` adds; every consumer shares one exchange of it. Rows of one doc_id, or
    without any, spread over the chunks by their texts."""
    count = max(least, -(-total // size))
    return docs.select(
        F.pmod(row_key(), F.lit(count)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        *more,
    )


def bucket_bits(total: int, size: int = BUCKET) -> int:
    """Leading bits of a key that name its bucket."""
    return max(6, int(np.ceil(np.log2(max(1, total / size)))))


def runs(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """``bucket, lo, hi`` for each bucket that has keys."""
    if len(sorted_keys):
        bucket = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64)
        found, lo = np.unique(bucket, return_index=True)
        yield from zip(found.tolist(), lo.tolist(), [*lo[1:].tolist(), len(bucket)])


def table(columns: dict[str, list], schema: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array(columns[name], kind) for name, kind in schema.items()})


def arrays(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    """The packed arrays of a binary column."""
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def first_value(column: pa.ChunkedArray) -> int:
    return column[0].as_py()


def batch_chunks(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[tuple[int, pa.RecordBatch]]:
    """``chunk, rows`` of a scanned batch: stretches of at most ``most`` bytes of text, named by a hash of their row_keys.

    How rows come in batches depends on their bytes and columns, so chunks are only named once, in ``blocks``.
    """
    for lo, hi in slices(as_array(batch.column("text")), most):
        rows = batch.slice(lo, hi - lo)
        yield xxhash.xxh3_64_intdigest(rows.column("row_key").to_numpy().tobytes()) - (1 << 63), rows


def packed_rows(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed block, about a third of their text."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked_rows(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def blocks(docs: DataFrame) -> DataFrame:
    """``chunk, block``: the rows of ``docs(row_key, text, …)`` as compressed blocks, one for each chunk, written once. All
    later steps read these, so that a chunk asks and is answered for the same rows whatever is lost or recomputed."""

    def pack(batches):
        for batch in batches:
            for chunk, rows in batch_chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed_rows(rows)], pa.binary())], ["chunk", "block"])

    return kept_by(docs.mapInArrow(pack, "chunk long, block binary"), "blocks", "chunk")


def answers_of(answers: pa.Table, name: str, kind: str, wanted: int) -> np.ndarray:
    """A chunk's packed answers in order of bucket; equal chunks ask alike, so one answer a bucket is taken."""
    got = arrays(answers[name], kind)
    _, first = np.unique(answers["bucket"].to_numpy(), return_index=True)
    flat = np.concatenate([np.empty(0, kind), *(got[i] for i in first)])
    if len(flat) != wanted:
        raise ValueError(f"{len(flat)} answers for {wanted} questions")
    return flat

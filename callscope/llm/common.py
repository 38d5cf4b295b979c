"""Helpers of the operators: scans, scratch tables, bounded Arrow blocks, words as codes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, small_batches

#: Bytes of text that are worked on at once inside a task; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(columns or ("doc_id", "text")))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has at most ``rows`` rows.

    A larger one is joined by a shuffle, with the same result.
    """
    return F.broadcast(df) if df.count() <= rows else df


def hashed_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo: the folds that decide which labels may be learned."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``size`` bytes of text each, and one row at least.

    After the last one the worker gives the memory of its arrays back: it may wait for its next
    task while other stages need that memory.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length.astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, length, ends
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.string())


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts and the last ends."""
    texts = texts if texts.offset == 0 else pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of byte flags for each text."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts in a row, and the text that each comes from."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False).astype(bool)
    return (flat, owner) if mask.all() else (flat.filter(full), owner[mask])


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z to a-z and nothing else."""
    raw, offsets = utf8_bytes(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def record(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

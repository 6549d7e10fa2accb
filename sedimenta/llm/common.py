"""What the operators of this folder share: the shared folder, written tables, Arrow text buffers, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.batches import BATCH_BYTES, BATCH_ROWS, SLICE_BYTES, batched, release  # noqa: F401
from sedimenta.plans import scratch

U64 = np.uint64

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that every executor sees."""
    return scratch.path(spark, tag)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


@F.arrow_udf(T.BinaryType())
def packed(text: pa.Array) -> pa.Array:
    """Texts compressed, before they are shuffled."""
    data, off = buffers(text)
    raw, z = data.tobytes(), zstandard.ZstdCompressor(level=1)
    return pa.array([z.compress(raw[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())


def unpacked(column: pa.Array | list[bytes]) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in (column if isinstance(column, list) else column.to_pylist())]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of about ``limit`` bytes of ``column`` (one longer row makes a run)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to
    release()


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i (mod 2^64) for i < n."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H of length n+1 so that span (s, e) hashes to (H[e] - H[s]) * B^-s."""
    p, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return fmix((h[end] - h[start]) * inv[start] + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each ``[^\\x20\\x09-\\x0D]+`` in the buffer, and of each row the number of its first word (n+1)."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= inside[1:-1][cut]
    last[cut - 1] |= inside[1:-1][cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]

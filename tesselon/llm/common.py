"""What the operators share: bounds, and word kernels over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.sources.scratch import Scratch, scratch_root

__all__ = ["Scratch", "scratch_root"]

#: The contract's word: a run of characters that are neither a space nor one of the five ASCII line and tab controls.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: No broadcast of ours exceeds this many bytes; beyond it the operators shuffle.
BROADCAST_BYTES = 48 << 20
#: Texts are worked on in slices of about as many bytes, as the kernels take some fifty times as much.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df, best on disk, marked for a broadcast if its rows, counted, make no more than BROADCAST_BYTES; else as it is, for a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df


def n_partitions(spark: SparkSession, rows: int, each: int) -> int:
    """As many partitions as hold `each` rows, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each), 1)


def word_count(text):
    """Number of WORD_RE matches in a column, null counting as 0, without regular-expression captures."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about `most` bytes at most, or are one text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within each text, and per text the index of its first run (n + 1 entries)."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    stops = np.zeros(n, bool)
    stops[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    stops[-1] = inside[-1]
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def is_word_byte() -> np.ndarray:
    """Table: whether a byte belongs to a WORD_RE word."""
    good = np.ones(256, bool)
    good[[9, 10, 11, 12, 13, 32]] = False
    return good


_WORD_BYTE = is_word_byte()


def words(raw: np.ndarray, offsets: np.ndarray):
    return runs(_WORD_BYTE[raw], offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes: differences of prefix sums of a keyed byte stream would depend on place, so bytes are weighed by powers within the word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    source = place + np.repeat(starts, lengths)
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15 | 1, np.uint64))
    keyed = _BYTE_KEYS[raw[source]] * powers[place]
    return mix64(np.add.reduceat(keyed, first) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))

"""What the corpus operators share: durable tables, bounded batches, word kernels.

The kernels work on the UTF-8 bytes of a whole Arrow column, in pieces of about
a megabyte, so the memory they take depends on the longest text alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 that a kernel handles at once, unless one text is longer.
PIECE_BYTES = 1 << 20
#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20
#: Rows and bytes of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder and
    a cluster an error: executors could not read a folder of this machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    It cuts the lineage: an executor that is lost later costs no work from
    before this point.  ``clear_tables`` deletes the tables of an application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables that this application made; results that read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/strandline-tables/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows of ``size`` bytes in all, else left to shuffle.

    Rows count 32 bytes and their strings, binaries and arrays.  ``df`` must be
    cheap to read: a stored table.
    """
    wide = [F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) for c, t in ((f"`{f.name}`", f.dataType.typeName()) for f in df.schema.fields) if t in ("string", "binary", "array", "struct", "map")]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(32))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= size else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin and end; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, past the last) of at most ``limit`` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte value, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between blanks: bytes other than 20 and 09 to 0D.
BLANK_WORDS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of digits, letters and all that isn't ASCII (after lower-casing).
TEXT_WORDS = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    size = max(n, PIECE_BYTES) + 1
    for i, base in enumerate((_BASE, _INVERSE)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[i] = np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of some rows: byte range, 64-bit hash of the bytes, row (from 0)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray


def word_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, sums, unshift) of the words of rows.

    ``(sums[b] - sums[a]) * unshift[a]`` is the polynomial of bytes a to b
    modulo 2**64, the same wherever those bytes stand.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(1, np.uint64), np.ones(1, np.uint64)
    if len(_powers[0]) <= n:
        _grow(n)
    inside = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row, sums, _powers[1]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """All words of rows; equal words have equal hashes wherever they stand."""
    start, end, row, sums, unshift = word_sums(data, offsets, table)
    return Words(start, end, mix((sums[end] - sums[start]) * unshift[start]), row)

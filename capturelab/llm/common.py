"""What the corpus operators share: reading tables, checkpoints, and word splitting on Arrow buffers.

Word splitting works on UTF-8 bytes in numpy. All separators are ASCII bytes, so
splitting bytes and splitting code points give the same words. A word's hash is a
64-bit polynomial over random byte values with a final mixing step; equal words have
equal hashes, and hashes are treated as the words' identities.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in one process may do without a setting; it gets a fresh folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """df, materialised in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A key's rows are dealt over so many tasks where its table is too large to broadcast.
SALTS = 32


def attached(rows: DataFrame, table: DataFrame, condition, most: int, by: str) -> DataFrame:
    """rows left-joined with a table that has few rows a key: by broadcast up to `most` rows, else by a shuffle in which a hot key's rows are dealt by the column `by`."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), condition, "left")
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_dealt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(table, condition & (F.col("_dealt") == F.col("_salt")), "left")


def crc_bucket(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def _table(separators) -> np.ndarray:
    out = np.ones(256, np.uint8)
    out[list(separators)] = 0
    return out


#: Byte classes; 0 separates. Words between white space.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and of everything beyond ASCII (after lower-casing).
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: As ALNUM, with runs of other visible characters as words of a second class.
MIXED = np.where(SPACED == 0, 0, np.where(ALNUM == 0, 2, 1)).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_VALUES = np.random.RandomState(20240607).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, U(_BASE)), np.full(size, U(_INVERSE))
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is an array of uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two uint64 arrays."""
    return mix(a * U(0xD6E8FEB86659FD93) + b + U(0x632BE59BD9B4E019))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


class Words:
    """The words of a run of rows: rows lo..hi, each word's hash, byte span and row, and the count per row."""

    __slots__ = ("lo", "hi", "hash", "start", "end", "first", "count", "kind")

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, classes: np.ndarray, lower: bool):
        self.lo, self.hi = lo, hi
        raw = data[at[lo] : at[hi]]
        raw = LOWER[raw] if lower else raw
        edges = at[lo : hi + 1] - at[lo]
        cls = np.zeros(len(raw) + 2, np.uint8)
        cls[1:-1] = classes[raw]
        change = cls[1:] != cls[:-1]
        change[edges] = True
        starts = np.flatnonzero(change[:-1] & (cls[1:-1] > 0))
        # a word ends at the next change after its start
        marks = np.flatnonzero(change)
        ends = marks[np.searchsorted(marks, starts, "right")] if len(starts) else starts
        up, down = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(_VALUES[raw] * up[: len(raw)], out=total[1:])
        self.hash = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
        self.start, self.end, self.kind = starts, ends, cls[1:-1][starts]
        self.first = np.searchsorted(starts, edges)  # n + 1 positions: words of row i are first[i] to first[i + 1]
        self.count = np.diff(self.first)


def word_chunks(column: pa.Array, classes: np.ndarray, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """Whole rows at a time, about `size` bytes of text each."""
    data, at = texts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Words(data, at, lo, min(hi, n), classes, lower)
        lo = min(hi, n)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the counts, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)

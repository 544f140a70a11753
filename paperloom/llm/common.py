"""What the operators of this subpackage share: tables in the shared folder, Arrow batches as bytes, words and shingles as hashes.

Words are hashed over the UTF-8 bytes of a whole Arrow batch at once, so no
per-word Python object is made. Batches are cut into slices of about
``SLICE_BYTES`` so that memory stays bounded; one text is never cut.
"""

from __future__ import annotations

import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: Separators of plain words: [\x20\x09-\x0D]. All are ASCII, so UTF-8 bytes can be tested one by one.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the benchmark words: ASCII but for digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "paperloom-shared")


#: The paths of the tables that the running ``settled`` has written so far; None outside one.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it again: later jobs, and retries after a lost executor, start from the files."""
    path = f"{shared_dir(df.sparkSession)}/paperloom/{label}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    # Once the table is written nothing reads the job's shuffle files again, so Spark may delete them.
    conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(key, before)
    if (written := _written.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()`` as a table of its own; those that ``materialise`` wrote for it on the way are deleted."""
    outer = _written.set([])
    try:
        made, passing = make(), _written.get()
    finally:
        _written.reset(outer)
    out = materialise(made, label)
    jvm, hadoop = out.sparkSession._jvm, out.sparkSession._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, passing):
        path.getFileSystem(hadoop).delete(path, True)
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a table from ``materialise`` that no later job reads."""
    jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for file in table.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(hadoop).delete(path, False)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: further columns of a caller's table, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = flat(column)
    row, end = 0, len(offsets) - 1
    while row < end:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, upto, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_P, _P_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a run of rows: where each starts and ends in the bytes, its row and its 64-bit hash; first[r]:first[r+1] are the words of row r."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes[start:end], from ``prefix_hash``."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    terms = out[1:]  # in place: a text's bytes take eight times their size once, not thrice
    terms[:] = data
    terms += np.uint64(1)
    terms *= powers(len(data) + 1)[0][:-1]
    np.cumsum(terms, out=terms)
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, prefix: np.ndarray | None = None) -> Words:
    """Lower-cases A-Z and takes the maximal runs of bytes that aren't separators; none crosses a row."""
    n, data = len(offsets) - 1, LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    start[heads] = inside[1:-1][heads]
    end[tails] = inside[1:-1][tails]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix = prefix_hash(data) if prefix is None else prefix
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(n), np.diff(first)), range_hash(prefix, start, end), first)


_FACTORS = [pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(64)]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words, in order; a row of fewer words, but not none, has its whole sequence as one."""
    n, h = len(w.row), w.hash
    long = np.zeros(0, np.int64)
    out = np.zeros(0, np.uint64)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total += h[j : n - size + 1 + j] * np.uint64(_FACTORS[j])
        keep = w.row[: n - size + 1] == w.row[size - 1 :]
        out, long = mix(total)[keep], w.row[: n - size + 1][keep]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = [mix(np.array([sum(int(x) * _FACTORS[j] for j, x in enumerate(h[w.first[r] : w.first[r + 1]])) + (int(counts[r]) << 1 | 1) & (1 << 64) - 1], np.uint64))[0] for r in short]
        out, long = np.concatenate([out, np.array(ends, np.uint64)]), np.concatenate([long, short])
        order = np.argsort(long, kind="stable")
        out, long = out[order], long[order]
    return out, long


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

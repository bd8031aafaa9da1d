"""Shared helpers: tables in the shared folder and vectorised text scans.

Texts are scanned as UTF-8 bytes straight from Arrow buffers.  Words are runs
of bytes other than space and 0x09-0x0D, which is the same set of runs as the
code-point pattern ``[^\\x20\\x09-\\x0D]+`` because those bytes never occur
inside a multi-byte sequence.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import cluster
from ..plans.cluster import shared_dir

#: Bytes of text handled at once; bounds the temporaries of a scan.
SLICE_BYTES = 2 << 20

#: Rows and bytes that a Python worker gets at once; a session may set less.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

_holder: list = ["", None]


def hold(name: str, drop: Callable[[], None] | None = None) -> None:
    """Says which operator works in this Python worker; the tables another one left are dropped.

    Workers outlive stages, so the tables of a pipeline's stages would add up.
    """
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        give_back()
        _holder[:] = [name, drop]


def give_back() -> None:
    """Returns to the system what this worker's allocators keep of freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def ship(spark: SparkSession) -> None:
    """Makes the package known to Python workers and bounds the batches that they get: texts may be long."""
    cluster.ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Tables written by this thread's operators and not yet discarded.
_mine = threading.local()


def stash(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executors.

    With ``keep`` the table outlives ``drop_tables``.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tv_path = path
    if not keep:
        _mine.__dict__.setdefault("paths", set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that no frame still to be computed reads."""
    for t in tables:
        _delete(t.sparkSession, t.tv_path)
        _mine.__dict__.setdefault("paths", set()).discard(t.tv_path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes what this thread's operators have stashed: for when all their results have been written."""
    for path in _mine.__dict__.pop("paths", set()):
        _delete(spark, path)


def whole_number_id(df: DataFrame, col: str) -> Column:
    """The id column as a long; ids of another kind are refused before any work starts."""
    kind = df.schema[col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{col} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{col}`").cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string array; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    valid = np.ones(n, bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    _, off_buf, data = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count and (np.diff(off)[~valid] > 0).any():
        return text_buffers(pa.array(["" if v is None else v for v in col.to_pylist()], pa.large_string()))
    return buf, off, valid


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def space_mask(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf - np.uint8(9)) < 5)


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``off`` starts at 0 and covers ``buf``."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~space_mask(buf)
    first = np.zeros(n + 1, bool)
    first[off] = True  # a word ends where its text does
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


#: Spans up to this many bytes are hashed eight bytes at a time in numpy, longer ones one by one.
NUMPY_SPAN = 96


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on as one integer; zeros follow its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def _piece(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, zeroed beyond the ``left`` ones that belong to the span."""
    short = np.minimum(left, 8).astype(np.uint64)
    return view[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - short) * np.uint64(8)))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: every eight bytes are mixed before the next ones join.

    Nothing is linear in the bytes, so no family of texts collides by construction;
    callers that need equality compare the bytes of what hashes alike.
    """
    size = np.asarray(ends - starts, np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view = eights(buf)
    todo = np.flatnonzero((size > 0) & (size <= NUMPY_SPAN))
    done = 0
    while len(todo):
        out[todo] = mix(out[todo] * np.uint64(0xD6E8FEB86659FD93) ^ _piece(view, starts[todo] + done, size[todo] - done))
        done += 8
        todo = todo[size[todo] > done]
    if len(long := np.flatnonzero(size > NUMPY_SPAN)):
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:e]) for a, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def spans_equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` in ``buf`` equal those from ``b`` (in ``other``, if given)."""
    left, right = eights(buf), eights(buf if other is None else other)
    same = np.ones(len(a), bool)
    todo, done = np.flatnonzero(size > 0), 0
    while len(todo):
        same[todo] = _piece(left, a[todo] + done, size[todo] - done) == _piece(right, b[todo] + done, size[todo] - done)
        done += 8
        todo = todo[same[todo] & (size[todo] > done)]
    return same


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf - np.uint8(65)) < 26, buf | np.uint8(32), buf)


def append_columns(batch: pa.RecordBatch, **cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *cols.values()], names=[*batch.schema.names, *cols])

"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step inside a Python worker holds at once. A single
#: longer text is a step of its own.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark whatever the store is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests), a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_folder()}"


@functools.cache
def _own_folder() -> str:
    """A folder of this process for local runs, gone when it ends."""
    path = tempfile.mkdtemp(prefix="veilspan-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there,
    and a lost executor costs only the tasks it ran. The files stay until
    ``drop_materialized``, as results are read from them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    wrote(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def wrote(path: str) -> None:
    """Remember a folder for ``drop_materialized``."""
    _WRITTEN.append(path)


def written() -> list[str]:
    """The folders that ``drop_materialized`` would delete, oldest first."""
    return list(_WRITTEN)


def drop_materialized(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete what ``materialize`` has written in this process, or those of it that
    ``paths`` names, through Spark's file systems; call it when all results that read
    them have been written. Returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _WRITTEN if paths is None or p in paths]
    for p in gone:
        _WRITTEN.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` and ``rows``
    rows at most, and one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over uint64, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words end at these bytes: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers_to(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers_to(64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers_to(2 * n)
    return _POWERS


def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(flat: np.ndarray, offsets: np.ndarray, fold: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, with the row of each word and its
    first byte. Words are runs without the bytes that ``space`` marks, by default
    space and 0x09 to 0x0D; ``fold`` lowers A-Z."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    inside = ~space[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(flat)]
    first[cuts] = inside[cuts]  # a word never spans two rows
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    where = np.flatnonzero(inside)
    word = np.cumsum(first)[where] - 1
    nth = where - starts[word]
    chars = LOWER[flat[where]] if fold else flat[where]
    each = _TABLE[chars] * _powers(int(nth.max()) + 1)[nth]
    head = np.flatnonzero(nth == 0)
    hashes = splitmix(np.add.reduceat(each, head))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts

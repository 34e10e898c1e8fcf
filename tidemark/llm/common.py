"""What the operators share: the words of a text, work tables, split keys and Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop), a temporary folder is set once. On a cluster executors
    couldn't see that folder, so there the setting must be given.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


#: Rows of an Arrow batch while a work table is written: workers hold a batch at a time, whole texts and all.
BATCH_ROWS = 1024
_ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Work tables and broadcasts made inside a ``with`` block; ``drop()`` deletes them, but for those to keep."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}
        self.shared: list = []

    def __enter__(self) -> Scratch:
        self._token = _scratch.set((*_scratch.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._token)

    def drop(self, *keep: DataFrame) -> None:
        """Delete what no table of `keep` reads."""
        read = "\n".join(f for df in keep for f in df.inputFiles())
        for path, spark in list(self.paths.items()):
            if path.rsplit("/", 1)[-1] not in read:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                del self.paths[path]
        for x in self.shared:
            x.destroy()
        self.shared.clear()


_scratch: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast, destroyed when the innermost Scratch drops what it holds."""
    out = spark.sparkContext.broadcast(value)
    for s in _scratch.get()[-1:]:
        s.shared.append(out)
    return out


def work_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: this cuts the lineage, so that a lost
    executor costs no recomputation, and later readers fetch only the columns they need. The files go
    with the Scratch that they were made in, or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    before = spark.conf.get(_ROWS_A_BATCH)
    spark.conf.set(_ROWS_A_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS_A_BATCH, before)
    for s in _scratch.get():
        s.paths[path] = spark
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], mark: str = "_q") -> str:
    """A beginning of names that no name of `taken` has, whatever its case."""
    while any(c.lower().startswith(mark) for c in taken):
        mark += "_"
    return mark


def slim(run):
    """A function of Arrow batches that gives freed memory back to the system when it ends, so that workers that
    wait for a next stage are small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string array without a copy; a null is an empty text."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, most: int):
    """(first, last) ranges of texts with about `most` bytes each; a longer text stands alone, whole."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, which holds texts cut at offsets (offsets[0] is 0)."""
    n = len(raw)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_IS_SPACE[raw], out=solid[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = solid[1:] & (~solid[:-1] | cut)
    end = solid[:-1] & (~solid[1:] | cut)
    return np.flatnonzero(start), np.flatnonzero(end)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: Rows and bytes per Arrow batch handed to Python; texts can be long, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 512, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (a session setting; results do not depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; where that is unset, a temporary one, with a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete the tables that :func:`saved` wrote; results that still read them must be consumed first."""
    while _written:
        own, path = _written.pop()
        try:
            _delete(spark or own, path)
        except Exception:  # the session may be gone at interpreter exit
            pass


atexit.register(cleanup)


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # what was shuffled on the way is not needed again
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(key, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete one table written by :func:`saved` as soon as nothing reads it any more."""
    files = df.inputFiles()
    for k, (spark, path) in enumerate(_written):
        if any(path.split(":", 1)[-1] in f for f in files[:1]):
            _delete(spark, path)
            del _written[k]
            return


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def to_batches(rows: dict[str, object], schema: pa.Schema, at_most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded length from columns."""
    arrays = []
    for f in schema:
        col = rows[f.name]
        if isinstance(col, (pa.Array, pa.ChunkedArray)):
            arrays.append(col)
        else:
            arrays.append(pa.array(col, type=f.type))
    table = pa.Table.from_arrays(arrays, schema=schema)
    yield from table.to_batches(max_chunksize=at_most)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; touching spans join."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case, everything else as it is."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z only), as bytes; bytes.split() cuts at exactly those six."""
    return ascii_lower(text).split()


def _trim() -> None:
    """Give freed memory back: workers are reused, and theirs adds up on an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A ``mapInArrow`` function that leaves no freed memory with its worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _trim()

    return run

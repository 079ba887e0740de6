"""Tables cut from their lineage, in the folder that executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def saved(df: DataFrame, name: str, compression: str = "snappy", lean: bool = False) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back; where that is unset, a temporary folder serves a local master only.

    ``lean``: what was shuffled on the way is deleted as soon as the table is written.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    try:
        if lean:
            spark.conf.set(key, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(key, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete one table written by :func:`saved` as soon as nothing reads it any more."""
    files = df.inputFiles()
    for k, (spark, path) in enumerate(_written):
        if any(path.split(":", 1)[-1] in f for f in files[:1]):
            _delete(spark, path)
            del _written[k]
            return


def cleanup() -> None:
    """Delete what :func:`saved` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            pass


atexit.register(cleanup)

"""Token-ID / binary output: Simple-8b coded ids in ascending document order.

Files are Parquet with one row per segment: the document ids and lengths, the coded
words and the per-block word offsets. Spark's writer commits them atomically, so a
lost executor leaves no half file, and any store that Spark can reach will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import lean, saved, small_batches, texts, to_batches
from .tokenizer import default_path, encoder

#: Ids after which a segment is closed; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 19

SEGMENTS = "part int, segment long, ids_before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, offsets binary, words binary"
_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])
_DOCS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of coded ids, documents in ascending doc_id over partitions and within them.

    Null text counts as empty (only the end id); rows with one doc_id keep a place each,
    a null doc_id comes first; other columns are ignored.
    """
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        state = {"n": 0, "before": 0, "segment": 0}

        def close() -> Iterator[pa.RecordBatch]:
            if names:
                words, offsets = simple8b.encode(np.concatenate(ids))
                row = {"part": [part], "segment": [state["segment"]], "ids_before": [state["before"]], "n_ids": [state["n"]], "doc_ids": [list(names)], "lengths": [[len(x) for x in ids]], "offsets": [offsets.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()]}
                yield from to_batches(row, _SEGMENTS)
                state.update(n=0, before=state["before"] + state["n"], segment=state["segment"] + 1)
                ids.clear()
                names.clear()

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), enc.encode(texts(b)), strict=True):
                ids.append(np.concatenate([x, end]))
                names.append(d)
                state["n"] += len(ids[-1])
                if state["n"] >= segment_ids:
                    yield from close()
        yield from close()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(lean(coded), SEGMENTS)


def write_ids(docs: DataFrame, path: str, **options) -> None:
    """Write the segments of :func:`encode_documents` under ``path``."""
    encode_documents(docs, **options).write.option("compression", "snappy").parquet(path)


def segment_ids(row) -> np.ndarray:
    """All ids of one segment row (or dict)."""
    words, offsets = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4")
    return simple8b.decode(words, offsets, row["n_ids"]).astype("<u4")


def decode_segment(row) -> list[np.ndarray]:
    """The ids of each document of one segment row (or dict)."""
    return np.split(segment_ids(row), np.cumsum(row["lengths"])[:-1])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The segment rows under ``path``."""
    return spark.read.parquet(path)


def document_ids(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from segment rows.

    The first id of each part follows from the parts' sizes, of which there are as many
    as written partitions.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = memoryview(segment_ids(row).tobytes())
                n = np.array(row["lengths"], np.int64)
                end = 4 * np.cumsum(n)
                yield from to_batches({"part": np.full(len(n), row["part"], np.int32), "doc_id": row["doc_ids"], "place": row["ids_before"] + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip((end - 4 * n).tolist(), end.tolist(), strict=True)]}, _DOCS)

    spark = segments.sparkSession
    sizes = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    bases = spark.createDataFrame(before, "part int, base long")
    docs = segments.mapInArrow(lean(decoded), "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, **options) -> DataFrame:
    """Encode, write to the shared folder, read back: one row per document."""
    return document_ids(saved(encode_documents(docs, **options), "token-ids", "snappy"))

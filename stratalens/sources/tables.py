"""Point tables from CSV, and tables of results to files."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, label: str | int | None = None, header: bool = True, delimiter: str = ",") -> DataFrame:
    """(id, features, label, label_name) from CSV; blank lines and ``#`` lines are skipped.

    The label column is given by name or index, or is the last. Every other field must be
    a number; ragged rows and other text fail. Integer labels stay as they are; others get
    codes in the order of their lower-cased names. Rows are numbered by position in the files.
    """
    raw = spark.read.csv(path, header=header, sep=delimiter, comment="#", mode="FAILFAST", inferSchema=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    name = raw.columns[-1] if label is None else raw.columns[label] if isinstance(label, int) else label
    if name not in raw.columns:
        raise ValueError(f"no column {name!r}")
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in raw.columns if c != name])
    rows = raw.select(F.monotonically_increasing_id().alias("id"), features.alias("features"), F.col(f"`{name}`").alias("label_name"))
    ints = rows.agg(F.every(F.col("label_name").rlike(r"^[+-]?[0-9]+$")).alias("all")).first()["all"]
    if ints or ints is None:
        return rows.withColumn("label", F.col("label_name").cast("int"))
    codes = rows.select(F.lower("label_name").alias("k")).distinct().rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex().toDF("k string, label long")
    return rows.withColumn("k", F.lower("label_name")).join(codes, "k").select("id", "features", F.col("label").cast("int").alias("label"), "label_name")


def write_table(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False) -> str:
    """Write as parquet, csv (header, quotes doubled, null empty) or json lines; Spark commits all files or none."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if form == "csv":
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    elif form == "json":
        w.json(path, ignoreNullFields=False)
    elif form == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")
    return path


def run_stamp(at: datetime | None = None) -> str:
    """A label for a run, to the second, in UTC."""
    return (at or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")


def artifact_path(base: str, family: str, stamp: str, *parts: str) -> str:
    """base/family/stamp/part/..."""
    return "/".join([base.rstrip("/"), family, stamp, *parts])


def partition_table(labels: DataFrame, points: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """(node_index, label[, x0, x1, ...][, true_label])."""
    out = labels.select(F.col("id").alias("node_index"), "label")
    if points is not None:
        n = len(points.select("features").first()["features"])
        out = out.join(points.select(F.col("id").alias("node_index"), *[F.col("features")[i].alias(f"x{i}") for i in range(n)]), "node_index")
    if truth is not None:
        out = out.join(truth.select(F.col("id").alias("node_index"), F.col("label").alias("true_label")), "node_index", "left")
    return out


def edge_currencies(edges: DataFrame, *currencies: DataFrame) -> DataFrame:
    """(src, dst, w, ...) with further per-edge columns joined on."""
    out = edges
    for c in currencies:
        out = out.join(c, ["src", "dst"], "left")
    return out


# Names and documents

@dataclass(frozen=True)
class Run:
    """What a run's tables are labelled with."""

    source: str
    stamp: str
    number: str

    @staticmethod
    def of(requested: str | None, caller: str, at: datetime | None = None) -> Run:
        """The requested name, made fit for a path, or the caller's."""
        name = re.sub(r"[^A-Za-z0-9._-]+", "-", (requested or "").strip()).strip("-") or caller
        return Run(name, run_stamp(at), uuid.uuid4().hex[:8])

    def label(self, df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.lit(self.source)).withColumn("run", F.lit(self.stamp))


def _plain(x):
    """Values that JSON can hold: names in snake case, floats that are no numbers by name."""
    if is_dataclass(x) and not isinstance(x, type):
        x = asdict(x)
    if isinstance(x, dict):
        return {re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", str(k)).lower(): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    return x


def document(x, indented: bool = True) -> str:
    """A record or nested values as JSON."""
    return json.dumps(_plain(x), indent=2 if indented else None, ensure_ascii=False, allow_nan=False)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """One file in any store Spark reaches, whole or not at all: written beside and renamed."""
    jvm = spark.sparkContext._jvm
    to, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not overwrite and fs.exists(to):
        raise FileExistsError(path)
    stream = fs.create(beside)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"{path} could not be put in place")


def write_document(spark: SparkSession, x, path: str) -> None:
    write_bytes(spark, path, document(x).encode())


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """JSON lines, nulls kept; returns how many."""
    write_table(df, path, "json", overwrite)
    return df.sparkSession.read.text(path).count()


# Projections

@dataclass
class Projection:
    """A named table as columns over another one's rows; a column may have a condition, and is left out where that is false."""

    name: str
    columns: list[tuple[str, Column]] = field(default_factory=list)

    def column(self, name: str, value: Column | str, when: bool = True) -> Projection:
        if any(n == name for n, _ in self.columns):
            raise ValueError(f"column {name!r} stands twice")
        if when:
            self.columns.append((name, F.col(value) if isinstance(value, str) else value))
        return self

    def entries(self, name: str, array: str, size: int) -> Projection:
        """A column for each place of an array: name0, name1, ..."""
        for k in range(size):
            self.column(f"{name}{k}", F.col(array)[k])
        return self

    def of(self, df: DataFrame) -> DataFrame:
        return df.select(*[c.alias(n) for n, c in self.columns])

    def write(self, df: DataFrame, folder: str, form: str = "csv", overwrite: bool = False) -> str:
        return write_table(self.of(df), f"{folder.rstrip('/')}/{self.name}", form, overwrite)


@dataclass
class Rows:
    """A table built row by row; every row has the columns' width."""

    names: list[str]
    rows: list[tuple] = field(default_factory=list)

    def add(self, *values) -> Rows:
        if len(values) != len(self.names):
            raise ValueError(f"{len(values)} values for {len(self.names)} columns")
        self.rows.append(values)
        return self

    def each(self, items, *selectors: Callable) -> Rows:
        for x in items:
            self.add(*[f(x) for f in selectors])
        return self

    def table(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, schema or self.names)

"""Names, documents, projections and rows."""

import json
import math
from dataclasses import dataclass
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stratalens.sources import tables as t


@dataclass
class Fit:
    logEvidence: float
    parts: tuple


def test_documents(spark, tmp_path):
    assert json.loads(t.document(Fit(math.inf, (1, float("nan"))))) == {"log_evidence": "Infinity", "parts": [1, "NaN"]}
    path = str(tmp_path / "a" / "fit.json")
    t.write_document(spark, {"meanValue": 1.5}, path)
    t.write_document(spark, {"meanValue": 2.5}, path)
    assert json.load(open(path)) == {"mean_value": 2.5} and [p.name for p in (tmp_path / "a").iterdir() if p.name.endswith(".part")] == []
    with pytest.raises(FileExistsError):
        t.write_bytes(spark, path, b"", overwrite=False)
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert t.write_records(df, str(tmp_path / "rows")) == 2
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "rows")).select("a", "b").collect())) == [(1, None), (2, "x")]


def test_runs(spark):
    at = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    r = t.Run.of(" my data/set ", "caller", at)
    assert (r.source, r.stamp, len(r.number)) == ("my-data-set", "20240506-070809", 8) and t.Run.of(None, "caller").source == "caller"
    assert r.label(spark.range(1)).first()["run"] == r.stamp


def test_projections(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [3.0, 4.0], 'say "so", then')], "id int, x array<double>, note string")
    p = t.Projection("points").column("point", "id").entries("x", "x", 2).column("note", "note").column("hidden", F.lit(1), when=False)
    assert p.of(df).columns == ["point", "x0", "x1", "note"]
    out = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(p.write(df, str(tmp_path)))
    assert sorted((r["point"], r["x1"], r["note"]) for r in out.collect()) == [("1", "2.0", None), ("2", "4.0", 'say "so", then')]
    with pytest.raises(ValueError):
        p.column("note", "id")
    rows = t.Rows(["a", "b"]).add(1, "x").each([2, 3], lambda v: v, str)
    assert [tuple(r) for r in rows.table(spark).collect()] == [(1, "x"), (2, "2"), (3, "3")]
    with pytest.raises(ValueError):
        rows.add(1)

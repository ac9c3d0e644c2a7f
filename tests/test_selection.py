"""Exact percentiles, running averages of large keys and file digests against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import golden, selection, telemetry
from placeloom.sources import readers


@pytest.mark.parametrize("few", [1, 4096])
def test_percentiles_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "RANGES", 16)
    rng = np.random.default_rng(1)
    sets = [rng.lognormal(3, 4, 700).tolist(), [5.0] * 300, [1.0], [-1e308, 1e308, 0.0, 1e-300], rng.integers(-3, 3, 400).astype(float).tolist() + [1e9], [0.1 + 1e-17, 0.1, 0.30000000000000004, 0.3]]
    shares = (0.0, 0.5, 0.95, 1.0)
    for values in sets:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        want = df.filter("not isnan(x)").agg(*[F.percentile("x", p) for p in shares]).first()
        assert selection.interpolated(df, "x", shares) == list(want)
        ranked = sorted(values)
        assert selection.nearest_rank(df, "x", shares) == [ranked[max(1, math.ceil(len(ranked) * p)) - 1] for p in shares]
    none = spark.createDataFrame([(None,)], "x double")
    assert selection.interpolated(none, "x", (0.5,)) == [None] and selection.nearest_rank(none, "x", (0.5,)) == [None]


def test_reports_of_no_rows(spark):
    traces = spark.createDataFrame([], "results_total int, coverage_gap boolean, latency_ms double")
    r = telemetry.trace_report(traces).first()
    assert (r.searches, r.p50, r.p95) == (0, None, None)
    empty = spark.createDataFrame([], "intent string, want_intent string, specialty string, want_specialty string, unit_ok boolean, places string, shown int, exact int, correct int, outside int, latency_ms long")
    assert golden.suite_metrics(empty).first().p95 is None


def test_averages_of_a_key_with_many_rows(spark):
    rng = np.random.default_rng(2)
    n = 200_000
    hot = rng.normal(size=n)
    rows = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.sin(F.col("id").cast("double") * 0.37) * 10).alias("v"))
    few = [("a", 3, 1.0), ("a", 1, 4.0), ("a", 2, None), ("b", 1, 2.0), ("c", 1, 5.0), ("c", 1, 3.0), (None, 1, 1.0), (None, 2, 2.0)]
    rows = rows.union(spark.createDataFrame(few, "k string, t long, v double"))
    got = {r.k: (r.ema, r.n) for r in selection.ema(rows, "k", "t", "v", 0.01).collect()}
    x = 0.0
    for i in range(n):
        v = math.sin(i * 0.37) * 10
        x = v if i == 0 else 0.01 * v + 0.99 * x
    assert math.isclose(got["hot"][0], x, abs_tol=1e-9) and got["hot"][1] == n
    plain = {"a": (0.99 * 4 + 0.01 * 1, 2), "b": (2.0, 1), "c": (0.99 * 3 + 0.01 * 5, 2), None: (0.99 + 0.02, 2)}
    assert all(math.isclose(got[k][0], e, abs_tol=1e-12) and got[k][1] == m for k, (e, m) in plain.items()) and len(hot) == n


def test_file_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    made = {"a b%.txt": b"x\r\ny", "long.bin": bytes(range(256)) * 100_000}
    for name, data in made.items():
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "empty.bin").write_bytes(b"")  # Spark lists no empty files
    got = {r.sha256: r.bytes for r in readers.fingerprint(spark, str(tmp_path / "in")).collect()}
    assert got == {hashlib.sha256(d).hexdigest(): len(d) for d in made.values()}

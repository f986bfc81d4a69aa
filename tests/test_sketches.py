"""Percentiles out of merged sketches against sorted values, and a stream in several batches."""

import random

import pytest
from pyspark.sql import functions as F

from tradebook.streaming import sketches
from tradebook.streaming import streams as st


def _points(spark, n, seed):
    r = random.Random(seed)
    draw = {"even": lambda: r.random(), "long": lambda: r.lognormvariate(0, 2), "same": lambda: 7.0}
    rows = [(m, "{}", draw[m](), 1_700_000_000 + r.randrange(86_400)) for m in draw for _ in range(n)] + [("none", "{}", None, 1_700_000_000)]
    return rows, spark.createDataFrame(rows, "metric string, tags_key string, value double, at long").select("metric", "tags_key", "value", F.timestamp_seconds("at").alias("ts"))


@pytest.mark.parametrize("size,off", [(1024, 0.01), (200, 0.03)])
def test_rank_error(spark, size, off):
    rows, points = _points(spark, 6_000, 1)
    got = {r["metric"]: r for r in sketches.merged(sketches.windowed_sketches(points, size=size)).collect()}
    assert set(got) == {"even", "long", "same"}
    for m, r in got.items():
        values = sorted(v for k, _, v, _ in rows if k == m)
        assert (r["n"], r["min"], r["max"]) == (len(values), values[0], values[-1]) and abs(r["mean"] - sum(values) / len(values)) < 1e-6
        for p, c in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            assert sum(v < r[c] for v in values) <= (p + off) * len(values) and sum(v <= r[c] for v in values) >= (p - off) * len(values)


def test_stream_in_batches(spark, tmp_path):
    rows, points = _points(spark, 500, 2)
    points.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = st.file_stream(spark, str(tmp_path / "in"), points.schema, files_per_batch=1)
    seen = {}

    def keep(df, _):
        for r in df.collect():  # a small test
            seen[r["window_start"], r["metric"]] = r

    st.run_to_end(sketches.windowed_sketches(stream, late="2 days").writeStream.outputMode("update").foreachBatch(keep), str(tmp_path / "checkpoint"))
    got = {r["metric"]: r for r in sketches.merged(spark.createDataFrame(list(seen.values()))).collect()}
    for m, r in got.items():
        values = sorted(v for k, _, v, _ in rows if k == m)
        assert r["n"] == 500 and abs(sum(v < r["p50"] for v in values) - 250) <= 10 or m == "same" and r["p50"] == 7.0
    assert sketches.merged(sketches.windowed_sketches(points.where(F.lit(False)))).count() == 0

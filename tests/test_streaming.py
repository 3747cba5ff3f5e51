"""The streaming forms give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators.stateful import Accumulator, Debounce, TokenBucket, accumulate, debounce, token_bucket
from opsloom.sources.catalog import Catalog
from opsloom.streaming import pipelines as S

SF = "/root/testdata/sf0.001"


def written(spark, tmp_path, df, files=1):
    path = str(tmp_path / "in")
    df.repartitionByRange(files, df.columns[0]).write.parquet(path)
    return path


def test_token_bucket_stream(spark, tmp_path):
    rows = Catalog(spark, SF).submissions.where("seq < 300").select("seq", "key", "at_ms")
    stream = S.file_stream(spark, written(spark, tmp_path, rows), rows.schema)
    S.run_available(S.token_bucket_stream(stream, TokenBucket(3.0, 0.0001)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in token_bucket(rows, 3.0, 0.0001).collect())


def test_metric_windows(spark, tmp_path):
    metrics = Catalog(spark, SF).task_metrics.select(F.timestamp_millis("recorded_at").alias("ts"), "task_name", "succeeded")
    stream = S.file_stream(spark, written(spark, tmp_path, metrics), metrics.schema)
    S.run_available(S.metric_windows(stream, "6 hours", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["start"], r["task_name"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["task_name"]): r["n"] for r in metrics.groupBy(F.window("ts", "6 hours").alias("w"), "task_name").agg(F.count(F.lit(1)).alias("n")).select("w.start", "task_name", "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_unique_within(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    stream = S.file_stream(spark, written(spark, tmp_path, rows), rows.schema)
    S.run_available(S.unique_within(stream, "k", "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


@pytest.mark.parametrize("kind", ["debounce", "accumulate"])
def test_bursts_end_by_timers(spark, tmp_path, kind):
    """What the watermark has passed is what the batch form gives; the rest is still open."""
    rows = Catalog(spark, SF).submissions.where("seq < 400").select("seq", "key", "at_ms")
    stream = S.file_stream(spark, written(spark, tmp_path, rows), rows.schema)
    if kind == "debounce":
        out, want, ends = S.debounce_stream(stream, Debounce(600_000, 1_800_000), "1 hour"), debounce(rows, 600_000, 1_800_000), "fires_at"
    else:
        out, want, ends = S.accumulate_stream(stream, Accumulator(4, 7_200_000), "1 hour"), accumulate(rows, 4, 7_200_000), "flushed_at"
    S.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    passed = rows.agg(F.max("at_ms")).first()[0] - 3_600_000
    closed = sorted(tuple(r) for r in want.where(F.col(ends) <= passed).collect())
    assert closed and set(closed) <= set(got) <= {tuple(r) for r in want.collect()}

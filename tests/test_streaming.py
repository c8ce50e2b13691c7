"""Streams against their batch forms."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessitura.streaming import chunks as R


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture
def folder(tmp_path):
    for part in range(3):
        rows = [{"key": k, "seq": part * 4 + i, "value": float(part * 4 + i), "prob": 0.5} for k in (1, 2) for i in range(4)]
        file = tmp_path / f"{part}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (1_700_000_000 + part,) * 2)  # a stream takes files by age
    return str(tmp_path)


def test_ring_buffer_keeps_the_last(spark, folder):
    s = spark.readStream.schema("key bigint, seq bigint, value double").option("maxFilesPerTrigger", 1).json(folder)
    rows = run(spark, R.ring_buffer_stream(s, 5), "ring", "update").collect()
    assert [7.0, 8.0, 9.0, 10.0, 11.0] in [r["values"] for r in rows if r["key"] == 1]


def test_smoothing_stream_equals_fold(spark, folder):
    s = spark.readStream.schema("key bigint, seq bigint, prob double").option("maxFilesPerTrigger", 1).json(folder)
    rows = run(spark, R.smooth_stream(s, 0.5), "smooth", "append").where("key = 2").orderBy("seq").collect()
    level = 0.0
    for r in rows:
        level += 0.5 * (0.5 - level)
        assert r["level"] == pytest.approx(level)
    assert len(rows) == 12


def test_note_stream_equals_batch(spark, tmp_path):
    frames = [(1, 60, f"2024-01-01T00:00:{i // 20:02d}.{i % 20 * 5:02d}0", 0.9 if (i // 10) % 2 == 0 else 0.0) for i in range(200)] + [(1, 61, "2024-01-01T00:01:00.000", 0.9)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"track_id": t, "pitch": p, "ts": ts, "prob": x}) for t, p, ts, x in frames))
    schema = "track_id bigint, pitch int, ts timestamp, prob double"
    batch = R.note_stream(spark.read.schema(schema).json(str(tmp_path)), 0.5, 0.05)
    stream = run(spark, R.note_stream(spark.readStream.schema(schema).json(str(tmp_path)), 0.5, 0.05), "notes", "append")
    closed = lambda df: sorted(tuple(r) for r in df.where("pitch = 60").collect())
    assert closed(batch) == closed(stream) and len(closed(batch)) == 10


def test_timing_classes(spark):
    rows = spark.createDataFrame([(0, 30_000), (0, -5_000), (50_000, 0), (0, 500_000)], "pts bigint, clock bigint")
    assert [r[0] for r in rows.select(R.timing_class(F.col("pts"), F.col("clock"))).collect()] == ["drop", "show", "hold", "seek"]


def test_debounce_keeps_the_last_of_a_burst(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.000", 1.0), (1, "2024-01-01 00:00:00.100", 2.0), (1, "2024-01-01 00:00:01.000", 3.0)], "key bigint, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["value"] for r in R.debounce(rows).collect()) == [2.0, 3.0]

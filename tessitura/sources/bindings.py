"""The driver's tables bound to the engine's entities: deterministic stand-ins, as there is no audio here.

note events from ``events`` (a track per user, 30 days as about a minute), note frames and signal blocks from ``embeddings``
(a track per label), beats and downbeats as a jittered grid over the note tracks, three tempo segments for each track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timejoin import spread_out

STEMS = ("drums", "bass", "other", "vocals", "guitar", "piano")
STEP_SEC = 0.05
SAMPLE_RATE = 441
#: (start, end, bpm, seconds a beat, beats before it)
TEMPO_SEGMENTS = ((0.0, 20.0, 120.0, 0.5, 0.0), (20.0, 40.0, 150.0, 0.4, 40.0), (40.0, 70.0, 100.0, 0.6, 90.0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by_user = Window.partitionBy("user_id")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), "event_id", "value", us.alias("us"), F.min(us).over(by_user).alias("us0"), F.row_number().over(by_user.orderBy("ts", "event_id")).alias("id")
    )
    start = (F.col("us") - F.col("us0")).cast("double") / F.lit(43200000000.0)
    return rows.select(
        "track_id", F.col("id").cast("int").alias("id"), (F.lit(21) + (F.col("event_id") * 7) % 88).cast("int").alias("pitch"),
        start.alias("start_time"), (start + F.lit(0.05) + F.col("value") / F.lit(200.0)).alias("end_time"), (F.lit(1) + (F.col("event_id") * 13) % 127).cast("int").alias("velocity"),
    )


def frame_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("track_id"), (F.row_number().over(order) - 1).cast("int").alias("frame"), "embedding")


def note_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame, pitch, prob: one row per frame and key."""
    rows = frame_arrays(spark, sf_dir).select("track_id", "frame", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("track_id", "frame", (F.col("pos") + 21).cast("int").alias("pitch"), F.least(F.lit(1.0), F.abs(F.col("v").cast("double")) * 4).alias("prob"))


def prob_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame, probs: one row per frame."""
    return frame_arrays(spark, sf_dir).select("track_id", "frame", F.transform("embedding", lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) * 4)).alias("probs"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, i, x: one row per sample."""
    rows = frame_arrays(spark, sf_dir).select("track_id", "frame", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("track_id", (F.col("frame").cast("bigint") * 64 + F.col("pos")).alias("i"), F.col("x").cast("double").alias("x"))


def signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_arrays(spark, sf_dir).select("track_id", F.col("frame").alias("block_no"), F.col("embedding").cast("array<double>").alias("samples"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = spread_out(read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct())
    i = F.col("beat_idx")
    t = i * F.lit(0.5) + ((i * 7) % 5 - 2) / F.lit(100.0) + F.lit(0.02)
    return tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(130))).alias("beat_idx")).select("track_id", F.col("beat_idx").cast("int").alias("beat_idx"), t.alias("t"))


def downbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats(spark, sf_dir).where("beat_idx % 4 = 0").select("track_id", F.floor(F.col("beat_idx") / 4).cast("int").alias("db_idx"), "t")


def tempo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, *s) for n, s in enumerate(TEMPO_SEGMENTS)], "seg_no int, start_time_sec double, end_time_sec double, bpm double, beat_duration_sec double, beat_offset double")
    tracks = read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()
    return tracks.crossJoin(F.broadcast(rows))  # three rows


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, arrival and clock in microseconds, kind and size of each chunk."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("user_id", "event_id", us.alias("us"), F.col("value").alias("size"), F.col("event_type").alias("kind"), (us + ((F.col("event_id") * 13) % 60 - 30) * 1000).alias("clock"))

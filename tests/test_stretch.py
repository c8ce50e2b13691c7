"""Stretch in pieces against stretch of the whole."""

import numpy as np
import pytest

from tessitura.operators import signal as A
from tessitura.streaming.stretch import BLOCK_OUT, Stretcher, stretch_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def song(n, seed):
    rng = np.random.default_rng(seed)
    return np.sin(np.arange(n) / (7 + seed)) + 0.1 * rng.standard_normal(n)


def whole(spark, x, speed, semitones=0.0, frame=256):
    rows = spark.createDataFrame([(1, x.tolist())], "track_id bigint, samples array<double>")
    return np.array(A.stretch(rows, speed, semitones, frame).first()["samples"])


@pytest.mark.parametrize("speed", [0.5, 1.0, 1.25, 2.0, 9.0])
@pytest.mark.parametrize("semitones", [0.0, 3.0, -5.0])
def test_pieces_of_any_size_make_the_whole(spark, speed, semitones):
    for n, sizes in ((5000, (1000,)), (5003, (1, 700, 33)), (90, (10,)), (1, (1,))):
        x = song(n, 1)
        want = whole(spark, x, speed, semitones)
        work, out, at, k = Stretcher(speed, semitones, 1, 256), [], 0, 0
        while at < n:
            size = sizes[k % len(sizes)]
            out.append(work.feed(x[None, at : at + size], at + size >= n))
            at, k = at + size, k + 1
        got = np.concatenate(out, axis=1)[0]
        assert len(got) == len(want) == max(1, int(np.floor(n / min(4.0, speed) + 0.5))) and np.allclose(got, want, atol=1e-8), (n, sizes)


def test_state_stays_small():
    work = Stretcher(0.5, 3.0, 1, 256)
    for n in range(50):
        work.feed(song(1000, n)[None], False)
    assert work.buffer.shape[1] < 1500 and work.raw.shape[1] < 20


def run(spark, tmp_path, batches, **options):
    source = str(tmp_path / "in")
    schema = "track_id bigint, chunk_no bigint, samples array<double>, last boolean"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = stretch_stream(spark.readStream.schema(schema).parquet(source), frame=256, **options)
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).start()
            q.processAllAvailable()  # each batch in a query that starts again from the checkpoint
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("track_id", "block_no").collect():
        out.setdefault(r["track_id"], []).append(r["samples"])
    return out


def chunked(track, x, size):
    starts = range(0, len(x), size)
    return [(track, n, x[a : a + size].reshape(-1).tolist(), a + size >= len(x)) for n, a in enumerate(starts)]


@pytest.mark.parametrize("speed", [0.5, 1.25, 2.0])
def test_the_stream_equals_the_batch(spark, tmp_path, speed):
    songs = {1: song(9000, 1), 2: song(4000, 2)}
    rows = [c for t, x in songs.items() for c in chunked(t, x, 900)]
    out = run(spark, tmp_path, [rows[3:1:-1] + rows[10:12], rows[:2] + rows[4:9], rows[9:10] + rows[12:] + rows[3:4]], speed=speed)  # out of order, one twice
    assert sorted(out) == [1, 2]
    for t, x in songs.items():
        assert all(len(b) == BLOCK_OUT for b in out[t][:-1])
        assert np.allclose(np.concatenate(out[t]), whole(spark, x, speed), atol=1e-8)


def test_channels_keep_together_and_start_frames_are_skipped(spark, tmp_path):
    x = np.stack([song(3000, 1), song(3000, 5)], axis=1)
    out = run(spark, tmp_path, [chunked(1, x, 700)], speed=1.25, semitones=2.0, channels=2, start_frame=500)
    got = np.concatenate(out[1]).reshape(-1, 2)
    for c in (0, 1):
        assert np.allclose(got[:, c], whole(spark, x[500:, c], 1.25, 2.0), atol=1e-8)

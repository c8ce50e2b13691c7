"""The ranged audio source: what it reads, what it gives, FLAC against WAV, damage, streams that start again."""

import numpy as np
import pytest
from flac_writer import write
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tessitura.sources import flac, listing, ranged, wav


def tone(n, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return np.stack([8000 * np.sin(t / 20) + rng.normal(0, 50, n), 6000 * np.sin(t / 17) + rng.normal(0, 300, n)], 1).round().astype("int64")


def pcm16(x, rate=8000):
    return wav.encode(np.zeros((0, x.shape[1])), rate)[:40] + (2 * x.size).to_bytes(4, "little") + x.astype("<i2").tobytes()


def blocks_of(rows):
    return {(r["block_no"], r["start_frame"]): (r["sample_rate"], r["channels"], tuple(r["samples"])) for r in rows if r["error"] is None}


@pytest.mark.parametrize("kinds", [[("fixed", n) for n in range(5)], [("lpc", 1), ("lpc", 4), ("lpc", 12)], [("verbatim", 0), ("constant", 0)]])
@pytest.mark.parametrize("modes", [(1,), (8, 9, 10)])
@pytest.mark.parametrize("bits,wide", [(16, False), (24, True)])
def test_flac_gives_its_samples(kinds, modes, bits, wide):
    x = tone(3000)
    x[1024:1536] = 7
    x[1536:2048] &= ~3
    data, places = write(x, bits=bits, kinds=kinds, modes=modes, wide=wide, tags={"TITLE": "Song"})
    read = lambda at, n: data[at : at + n]
    info = flac.read_info(read)
    assert (info.frames, info.channels, info.bits, info.begin, info.tags) == (3000, 2, bits, places[0], {"title": "Song"})
    got = list(flac.decode_range(read, len(data), info, 0, 3000))
    assert [e for *_, e in got] == [None] * 6 and (np.concatenate([g[2] for g in got]) == x).all()
    (one,) = flac.decode_range(read, len(data), info, 2600, 2700)
    assert one[0] == 2560 and (one[2] == x[2560:]).all()


def test_mono_flac_of_many_frames_is_found_by_bisection():
    x = tone(120_000)[:, :1]
    data, places = write(x, block=256, kinds=[("fixed", 2)])
    asked = []
    read = lambda at, n: (asked.append(len(data[at : at + n])), data[at : at + n])[1]
    info = flac.read_info(read)
    for sample in (0, 255, 256, 77_777, 119_999):
        assert flac.find_frame(read, len(data), info, sample, 1 << 12) in [p for n, p in enumerate(places) if n * 256 <= sample]
    asked.clear()
    (got,) = flac.decode_range(read, len(data), info, 77_777, 77_778)
    assert got[0] == 77_568 and (got[2] == x[77_568:77_824]).all()


def test_wav_and_flac_of_one_signal_give_equal_blocks(spark, tmp_path):
    x = tone(20_000)
    (tmp_path / "a.wav").write_bytes(pcm16(x))
    (tmp_path / "b.flac").write_bytes(write(x, kinds=[("fixed", 2), ("lpc", 4)], modes=(1, 10))[0])
    for mono in (True, False):
        rows = listing.read_audio(spark, str(tmp_path), block=3000, mono=mono).collect()
        a, b = (blocks_of(r for r in rows if r["path"].endswith(s)) for s in (".wav", ".flac"))
        assert a == b and [len(v[2]) for _, v in sorted(a.items())] == [3000 * (2 - mono)] * 6 + [2000 * (2 - mono)]
        flat = np.concatenate([v[2] for _, v in sorted(a.items())])
        assert np.allclose(flat, (x / 32768).mean(1) if mono else (x / 32768).reshape(-1), atol=1e-6)


def test_partitions_of_any_size_give_the_same_blocks(spark, tmp_path):
    x = tone(20_000)
    (tmp_path / "a.wav").write_bytes(pcm16(x))
    (tmp_path / "b.flac").write_bytes(write(x)[0])
    read = lambda size: spark.read.format("audio_blocks").option("block", 1000).option("partitionBytes", size).load(str(tmp_path))
    ranged.register_audio(spark)
    whole, parts = read(1 << 30), read(5_000)
    assert parts.rdd.getNumPartitions() > 15
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 40


def test_damaged_frames_become_error_rows(spark, tmp_path):
    x = tone(10 * 512)
    data, places = write(x)
    hurt = bytearray(data)
    hurt[places[3] + 400] ^= 0xFF  # in the body of the fourth frame
    hurt[places[6] + 1] ^= 0xFF  # the sync word of the seventh
    (tmp_path / "b.flac").write_bytes(bytes(hurt))
    (tmp_path / "cut.flac").write_bytes(data[: places[4] + 100])
    rows = listing.read_audio(spark, str(tmp_path), block=512).collect()
    good = {r["block_no"]: np.array(r["samples"]) for r in rows if r["path"].endswith("b.flac") and r["error"] is None}
    assert sorted(good) == list(range(10))
    want = (x / 32768).mean(1).reshape(10, 512)
    for n in range(10):
        assert np.allclose(good[n], want[n] if n not in (3, 6) else 0, atol=1e-6), n
    bad = sorted((r["start_frame"], r["samples"]) for r in rows if r["path"].endswith("b.flac") and r["error"])
    assert bad == [(3 * 512, None), (6 * 512, None)]
    cut = {r["block_no"]: r["samples"] for r in rows if r["path"].endswith("cut.flac") and r["error"] is None}
    assert np.allclose(cut[3], want[3], atol=1e-6) and not any(cut[9])
    assert [r["start_frame"] for r in rows if r["path"].endswith("cut.flac") and r["error"]] == [4 * 512, 5 * 512]


def test_a_preview_of_a_long_file_reads_the_preview(tmp_path):
    path = tmp_path / "long.wav"
    frames = (1 << 30) // 4
    with open(path, "wb") as f:  # a sparse file of a gigabyte
        f.write(wav.encode(np.zeros((0, 2)), 44_100)[:40] + (frames * 4).to_bytes(4, "little"))
        f.seek(44 + 4 * 44_100 * 3000)
        f.write(np.full(2 * 44_100, 1000, "<i2").tobytes())
        f.truncate(44 + frames * 4)
    reader = ranged.AudioBlocks({"path": str(path), "block": "16384"}).reader(None)
    kept = reader.pushFilters([GreaterThanOrEqual(("start_sec",), 3000.0), LessThan(("start_sec",), 3001.0)])
    assert len(kept) == 2
    before, rows = ranged.Ranges.bytes_read, []
    for part in reader.partitions():
        for batch in reader.read(part):
            rows += batch.to_pylist()
    assert ranged.Ranges.bytes_read - before < 1_000_000
    assert len(reader.partitions()) == 17 and 3 <= len(rows) <= 6 and any(np.allclose(r["samples"][8000:9000], 1000 / 32768) for r in rows)
    before = ranged.Ranges.bytes_read
    probe = ranged.AudioProbe({"path": str(path)}).reader(None)
    assert [list(probe.read(p)) for p in probe.partitions()] == [[(str(path), 44_100, 2, frames, frames / 44_100, {}, None)]]
    assert ranged.Ranges.bytes_read - before <= 8192


def test_filters_reach_the_source_and_change_nothing(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.wav").write_bytes(pcm16(tone(5000, n)))
    ranged.register_audio(spark)
    df = spark.read.format("audio_blocks").option("block", 100).load(str(tmp_path))
    everything = df.collect()
    for where, keep in (
        (F.col("path") == f"{tmp_path}/1.wav", lambda r: r["path"].endswith("1.wav")),
        (F.col("start_frame").between(1234, 2000), lambda r: 1234 <= r["start_frame"] <= 2000),
        ((F.col("start_sec") > 0.1) & (F.col("block_no") < 12), lambda r: r["start_sec"] > 0.1 and r["block_no"] < 12),
        (F.col("path").isin(f"{tmp_path}/0.wav", f"{tmp_path}/2.wav") & (F.col("block_no") == 7), lambda r: not r["path"].endswith("1.wav") and r["block_no"] == 7),
    ):
        assert sorted(df.where(where).collect()) == sorted(r for r in everything if keep(r))
    reader = ranged.AudioBlocks({"path": str(tmp_path)}).reader(None)
    reader.pushFilters([In(("path",), (f"{tmp_path}/0.wav",)), EqualTo(("block_no",), 0)])
    assert [p.value[0] for p in reader.partitions()] == [f"{tmp_path}/0.wav"]


def test_preview_is_clamped_and_cut(spark, tmp_path):
    x = tone(8000 * 3)
    (tmp_path / "a.wav").write_bytes(pcm16(x))
    blocks = listing.read_audio(spark, str(tmp_path), block=1000)
    want = (x / 32768).mean(1)
    for start, seconds, low, high in ((0.5, 1.0, 4000, 12_000), (0.51, 0.01, 4080, 6080), (2.5, 99.0, 20_000, 24_000), (-1.0, 0.3, 0, 2400)):
        (row,) = ranged.preview(blocks, start, seconds, block=1000).collect()
        assert np.allclose(row["samples"], want[low:high], atol=1e-6)
    assert ranged.preview(blocks, 5.0, 1.0, block=1000).collect() == []


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "none.wav").write_bytes(pcm16(tone(0)))
    (tmp_path / "text.flac").write_bytes(b"fLaC")
    (tmp_path / "eight.wav").write_bytes(wav.encode(np.zeros((9, 1)), 8000).replace(b"\x10\x00data", b"\x08\x00data"))
    (tmp_path / "skip.txt").write_bytes(b"x")
    (tmp_path / "many.wav").write_bytes(pcm16(np.arange(40).reshape(10, 4)))
    rows = {r["path"].rpartition("/")[2]: r for r in listing.read_audio(spark, str(tmp_path), mono=False).collect()}
    assert sorted(rows) == ["eight.wav", "empty.wav", "many.wav", "text.flac"] and all(rows[n]["error"] for n in ("eight.wav", "empty.wav", "text.flac"))
    assert np.allclose(rows["many.wav"]["samples"][:2], [1 / 32768, 2 / 32768])  # even channels left, odd ones right
    probes = {r["path"].rpartition("/")[2]: r["n_frames"] for r in listing.probe_audio(spark, str(tmp_path)).collect()}
    assert probes == {"empty.wav": None, "none.wav": 0, "text.flac": None, "eight.wav": None, "many.wav": 10}


def run_stream(df, checkpoint, out):
    q = df.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).start()
    q.processAllAvailable()
    q.stop()
    return len([p for p in q.recentProgress if p["numInputRows"]])


def test_a_long_file_is_many_batches_and_goes_on_after_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    x = tone(16_384 * 12 + 500)
    (source / "a.wav").write_bytes(pcm16(x))
    stream = lambda: listing.stream_audio(spark, str(source), 16_384, per_trigger=3, tasks=2)
    q = stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(out)).start()
    while not [p for p in q.recentProgress if p["numInputRows"]]:  # stop somewhere within the file
        q.awaitTermination(0.2)
    q.stop()
    seen = spark.read.parquet(str(out)).where("event = 'chunk'").count()
    assert 3 <= seen
    (source / "b.flac").write_bytes(write(tone(20_000, 2))[0])
    (source / "c.wav").write_bytes(b"broken")
    batches = run_stream(stream(), tmp_path / "ck", out)
    rows = spark.read.parquet(str(out)).collect()
    chunks = sorted((r for r in rows if r["path"].endswith("a.wav") and r["event"] == "chunk"), key=lambda r: r["start_frame"])
    assert [r["start_frame"] for r in chunks] == [16_384 * n for n in range(13)] and batches >= 2
    assert np.allclose(np.concatenate([r["samples"] for r in chunks]), (x / 32768).mean(1), atol=1e-6)
    events = {n: sorted(r["event"] for r in rows if r["path"].endswith(n) and r["event"] != "chunk") for n in ("a.wav", "b.flac", "c.wav")}
    assert events == {"a.wav": ["finished", "source_hash", "started"], "b.flac": ["finished", "source_hash", "started"], "c.wav": ["error"]}


def test_cancelled_files_get_no_more_chunks(spark, tmp_path):
    source, cancel = tmp_path / "in", tmp_path / "cancel"
    source.mkdir()
    cancel.mkdir()
    (source / "a.wav").write_bytes(pcm16(tone(16_384 * 4)))
    (source / "b.wav").write_bytes(pcm16(tone(16_384 * 2)))
    plan = ranged.ChunkPlan({"path": str(source), "chunk": "16384", "chunksPerTrigger": "2", "cancel": str(cancel)})
    rows, at = plan.read(plan.initialOffset())
    first = [r[1] for r in rows]
    (cancel / "a.wav").write_bytes(b"")
    rest, offsets = [], [at]
    while True:
        rows, after = plan.read(at)
        if after == at:
            break
        rest += [(r[0].rpartition("/")[2], r[1]) for r in rows]
        at = after
        offsets.append(at)
    assert first == ["started", "chunk", "chunk"] and {n for n, _ in rest} == {"b.wav"} and [e for _, e in rest] == ["started", "chunk", "chunk", "finished", "source_hash"]

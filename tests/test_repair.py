"""Beats from audio, agreement of sources, bars without gaps, and what is known of media before it is decoded."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import engraving as G
from tessitura.operators import mixing as K
from tessitura.operators import repair as W
from tessitura.sources import listing as L
from tessitura.sources import wav


def clicks(bpm, seconds, rate=4410):
    x = np.zeros(int(seconds * rate))
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate)
        x[at : at + 40] = np.linspace(1, 0, 40)[: len(x[at : at + 40])]
    return x


@pytest.mark.parametrize("bpm", [90.0, 120.0, 150.0])
def test_tempo_of_clicks(spark, bpm):
    found = W.tempo_of_audio(clicks(bpm, 12), 4410)
    assert any(abs(found[0] / bpm - f) < 0.02 for f in (0.5, 1, 2)) and 0 <= found[1] <= 1
    assert W.tempo_of_audio(np.zeros(100), 4410) is None and W.tempo_of_audio(np.zeros(9000), 4410) is None


def test_beat_model_by_track(spark):
    blocks = spark.createDataFrame([(1, i, clicks(120, 12)[i * 8820 : (i + 1) * 8820].tolist()) for i in range(6)] + [(2, 0, [0.0] * 9000)], "track_id bigint, block_no int, samples array<double>")
    rows = W.track_beats(blocks, W.PulseModel(), 4410).collect()
    beats, downs = ([r["t"] for r in rows if r["kind"] == k and r["track_id"] == 1] for k in ("beat", "downbeat"))
    assert len(beats) >= 10 and downs == beats[::4] and not [r for r in rows if r["track_id"] == 2]
    assert {r["track_id"] for r in W.bpm_from_audio(blocks, 4410).collect()} == {1}


def test_bars_are_filled():
    beats, downs = W.whole_bars([2.0 + 0.5 * i for i in range(13)], [2.0, 4.0, 8.0], 4)
    assert downs == [0.0, 2.0, 4.0, 6.0, 8.0] and beats[:4] == [0.5, 1.0, 1.5, 2.0]
    beats, downs = W.whole_bars([0.0, 0.5, 1.0, 1.5, 2.0, 6.0, 6.5], [0.0, 2.0, 6.0], 4)
    assert downs == [0.0, 2.0, 4.0, 6.0] and [4.5, 5.0, 5.5] == [b for b in beats if 4.0 < b < 6.0]
    assert W.whole_bars([0.0, 1.0], [0.0], 4) == ([0.0, 1.0], [0.0])


def test_agreement_of_sources(spark):
    grid = [(1, s, 0.5 * i + d) for s, d in (("combined", 0.0), ("drums", 0.03), ("bass", 0.2)) for i in range(17)]
    downs = [(1, s, 2.0 * i + d) for s, d in (("combined", 0.0), ("drums", 0.03), ("bass", 0.2)) for i in range(5)]
    shape = "track_id bigint, source string, t double"
    facts, rows = W.agreed_beats(spark.createDataFrame(grid, shape), spark.createDataFrame(downs, shape))
    r = facts.first()
    assert (r["beats_per_bar"], r["sources"]) == (4, 3) and r["bpm"] == pytest.approx(120) and r["confidence"] == pytest.approx(0.5)
    assert [x["t"] for x in rows.where("kind = 'downbeat'").orderBy("idx").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_metric_levels(spark):
    beats = spark.createDataFrame([(1, i, i * 2.0) for i in range(8)] + [(2, i, i * 0.25) for i in range(33)] + [(3, i, i * 0.5) for i in range(9)], "track_id bigint, beat_idx int, t double")
    downs = spark.createDataFrame([(1, i, i * 4.0) for i in range(4)] + [(2, i, i * 2.0) for i in range(5)] + [(3, i, i * 2.0) for i in range(3)], "track_id bigint, db_idx int, t double")
    assert {r["track_id"]: r["level"] for r in W.metric_level(beats, downs).collect()} == {1: "double", 2: "halve", 3: "keep"}
    n = {r["track_id"]: r["count"] for r in W.with_metric_level(beats, downs).groupBy("track_id").count().collect()}
    assert n == {1: 15, 2: 17, 3: 9}


def test_positions_on_a_page():
    page = '''<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 50"><g class="page-margin" transform="translate(10, 5)">
      <g id="n7_60_480_240" data-bounding-box="20 10 4 2"/><g id="x-n8_61_0_1"><rect x="0" y="0" width="5" height="5"/></g>
      <g id="n62_0_120"><use transform="translate(30,20)"/></g><g id="n9_10_0_0"><use x="1" y="1"/></g><g id="note"/></g></svg>'''
    assert G.read_positions(page) == [(7, 60, 480, 240, 0.3, 0.3, 0.04, 0.04), (8, 61, 0, 1, 0.1, 0.1, 0.05, 0.1), (0, 62, 0, 120, 0.4, 0.5, 0.0, 0.0)]
    assert G.read_positions("<svg") == [] and G.read_positions("<svg/>") == []


def wav_file(path, seconds=1.0, rate=8000, tags=None):
    data = wav.encode(np.sin(np.arange(int(seconds * rate)))[:, None] * 0.5, rate)
    if tags:
        body = b"INFO" + b"".join(k + struct.pack("<I", len(v) + 1) + v + b"\0" + b"\0" * ((len(v) + 1) % 2) for k, v in tags.items())
        data += b"LIST" + struct.pack("<I", len(body)) + body
    path.write_bytes(data)


def test_probe_and_tags(spark, tmp_path):
    wav_file(tmp_path / "a.wav", tags={b"INAM": b"Song", b"IART": b" "})
    (tmp_path / "b.wav").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = {r["path"].rpartition("/")[2]: r for r in L.probe_audio(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.wav", "b.wav"} and rows["b.wav"]["error"] and (rows["a.wav"]["sample_rate"], rows["a.wav"]["n_frames"], rows["a.wav"]["tags"]["title"]) == (8000, 8000, "Song")
    facts = spark.createDataFrame([({"Title": " ", "sort-title": "T", "Performer": "P"},)], "tags map<string, string>").select(L.song_facts(F.col("tags")).alias("f")).first()["f"]
    assert (facts["title"], facts["artist"], facts["album"]) == ("T", "P", None)


def test_choice_of_a_track(spark):
    rows = [("a", 0, None, 2500, 0.04), ("a", 1, 48000, 48000 * 5, None), ("a", 2, 48000, 48000 * 99, None), ("b", 0, 44100, 44100, None), ("b", 1, 44100, 88200, None), ("c", 0, None, 2500, 0.04), ("c", 1, 48000, 48000 * 5, None), ("c", 2, 48000, None, None)]
    got = {r["path"]: r["track_no"] for r in L.choose_track(spark.createDataFrame(rows, "path string, track_no int, sample_rate int, n_frames bigint, time_base double")).collect()}
    assert got == {"a": 2, "b": 1, "c": 2}


def test_safe_paths_and_stems(spark):
    rows = spark.createDataFrame([("/m/x.wav", 5, True), ("rel/x.wav", 5, True), (r"\\\\host\\x.wav", 5, True), ("/m/x.exe", 5, True), ("/m/y.wav", 11 << 30, True), ("/m/d.wav", 5, False)], "path string, length bigint, file boolean")
    assert [r["path"] for r in rows.where(L.is_safe_path(F.col("path"), F.col("length"), F.col("file"))).collect()] == ["/m/x.wav"]
    stems = L.stems_in_folder(spark.createDataFrame([("/s/bass.wav",), ("/s/drums.mp3",), ("/s/notes.txt",)], "path string")).orderBy("place").collect()
    assert [r["path"] for r in stems] == ["/s/drums.mp3", "/s/bass.wav"] and stems[0]["confidence"] == 0.9


def test_audio_as_a_stream(spark, tmp_path):
    wav_file(tmp_path / "a.wav", seconds=5.0)
    (tmp_path / "b.wav").write_bytes(b"broken")
    q = L.stream_audio(spark, str(tmp_path), 16_384).writeStream.format("memory").queryName("audio_events").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("audio_events").collect()
    events = [r["event"] for r in rows if r["path"].endswith("a.wav")]
    assert sorted(events) == ["chunk", "chunk", "chunk", "finished", "source_hash", "started"] and sum(len(r["samples"]) for r in rows if r["event"] == "chunk") == 40_000
    assert [r["event"] for r in rows if r["path"].endswith("b.wav")] == ["error"]


def test_stereo_at_another_rate_equals_numpy(spark):
    x = np.random.default_rng(1).standard_normal((100, 2))
    frames = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "track_id bigint, i bigint, samples array<double>")
    got = np.array([(r["l"], r["r"]) for r in K.stereo_at_rate(frames, 441, 600).orderBy("i").collect()])
    at = np.arange(len(got)) / (600 / 441)
    want = np.stack([np.interp(at, np.arange(100), x[:, c]) for c in (0, 1)], axis=1)
    assert len(got) == round(100 * 600 / 441) and np.allclose(got, want)

"""Registered queries that SQL cannot say, against plain Python over the same tables."""

import json
import math
import os
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest

from tessitura.operators import repair as W
from tessitura.operators import score as E
from tessitura.operators import tempo as T
from tessitura.plans import catalog as Q
from tessitura.sources import bindings as D
from tessitura.streaming import chunks as R

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_track(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["track_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_highlight_decay(spark):
    want, alpha = {}, min(1.0, max(0.02, 1 - math.exp(-1.0)))
    rows = defaultdict(list)
    for r in D.note_frames(spark, SF).collect():
        rows[r["track_id"], r["pitch"]].append((r["frame"], r["prob"]))
    for key, xs in rows.items():
        level = 0.0
        for frame, p in sorted(xs):
            level += alpha * (p - level)
            want[(*key, frame)] = level
    got = {(r["track_id"], r["pitch"], r["frame"]): r["level"] for r in Q.highlight_decay(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_chunk_rebuild_trigger_and_its_stream(spark, tmp_path):
    want = set()
    rows = defaultdict(list)
    for r in D.chunk_log(spark, SF).collect():
        rows[r["user_id"]].append((r["us"], r["event_id"], r["size"]))
    for user, xs in rows.items():
        held, last = 0.0, None
        for us, event, size in sorted(xs):
            held += size
            if last is None or held >= 500.0 or us - last >= 1_000_000:
                want.add((user, event))
                held, last = 0.0, us
    assert {tuple(r) for r in Q.chunk_rebuild_trigger(spark, SF).select("user_id", "event_id").collect()} == want
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"user_id": 1, "us": 100 * (3 * k + i), "event_id": 3 * k + i, "size": 200.0}) for i in range(3)))
        os.utime(tmp_path / f"{k}.json", (1_700_000_000 + k,) * 2)  # a stream takes files by age
    stream = spark.readStream.schema("user_id bigint, us bigint, event_id bigint, size double").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = R.rebuild_stream(stream, 500.0).writeStream.format("memory").queryName("rebuilds").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event_id"] for r in spark.table("rebuilds").collect()) == [0, 3]


def test_tempo_of_tracks_and_their_maps(spark):
    notes = by_track(D.note_events(spark, SF), "start_time", "end_time")
    tempi = {r["track_id"]: r["bpm"] for r in Q.bpm_octave_resolved(spark, SF).collect()}
    maps = by_track(Q.windowed_tempo_map(spark, SF), "seg_no", "start_time_sec", "end_time_sec", "bpm", "beat_duration_sec", "beat_offset")
    for track, rows in notes.items():
        starts = [s for s, _ in rows]
        assert abs(tempi[track] - T.tempo_of(starts)) < 1e-5
        end = max(max(r) for r in rows)
        segments = maps[track]
        assert segments[0][1] == 0.0 and abs(segments[-1][2] - end) < 1e-6 and all(40 <= s[3] <= 260 for s in segments)
        for a, b in zip(segments, segments[1:]):
            assert a[2] == b[1] and abs(b[5] - a[5] - (a[2] - a[1]) / a[4]) < 1e-3


def test_finished_grids(spark):
    beats, downs = (by_track(d.where("source = 'combined'"), "t") for d in Q.beat_sources(spark, SF))
    facts = {r["track_id"]: r["beats_per_bar"] for r in Q.beat_agreement(spark, SF).collect()}
    got = by_track(Q.beat_grid_finished(spark, SF), "kind", "idx", "t")
    for track, per in facts.items():
        grid, marks = W.whole_bars([t for t, in beats[track]], [t for t, in downs[track]], per)
        assert got[track] == sorted([("beat", i, round(t, 6)) for i, t in enumerate(grid)] + [("downbeat", i, round(t, 6)) for i, t in enumerate(marks)])


def test_chord_debug_json(spark):
    rows = by_track(Q.C.bar_candidates(Q.quantised(spark, SF)), "half", "found_at", "n_pcs", "symbol")
    for r in Q.chord_debug_json(spark, SF).collect():
        found = json.loads(r["json"])["candidates"]
        assert [(c["half"], c["found_at"], c["n_pcs"], c.get("symbol")) for c in found] == rows[r["track_id"]] and r["n"] == len(found)


def test_scores_hold_every_piece(spark):
    pieces = Counter()
    spans = E.note_spans(Q.quantised(spark, SF))
    bars = E.measure_boundaries(Q.signatures(spark, SF), spans.groupBy("track_id").agg(Q.F.max("end_tick").alias("end_tick")))
    sounds = by_track(E.split_into_measures(spans, bars), "measure", "id", "pitch")
    widths = {(r["track_id"], r["measure"]): r["end_tick"] - r["start_tick"] for r in bars.collect()}
    for r in Q.musicxml_document(spark, SF).collect():
        for m in ET.fromstring(r["xml"].encode()).findall("part/measure"):
            number, at, most = int(m.get("number")), 0, 0
            for x in m:
                if x.tag in ("note", "forward", "backup"):
                    n = int(x.find("duration").text) * (-1 if x.tag == "backup" else 1)
                    at += 0 if x.find("chord") is not None else n
                    most = max(most, at)
                    assert 0 <= at
            assert most == widths[r["track_id"], number]
            ids = {x.get("id").split("_")[0] for x in m.findall("note") if x.get("id")}
            assert ids <= {f"n{i}" for k, i, _ in sounds[r["track_id"]] if k == number}
            pieces[r["track_id"]] += len(ids)
    assert sum(pieces.values()) >= 0.9 * sum(len({(m, i) for m, i, _ in v}) for v in sounds.values())  # what begins where a voice has ended its measure is cut


def test_stretched_signals(spark):
    before = Counter(r["track_id"] for r in D.signal(spark, SF).select("track_id").collect())
    after = by_track(Q.time_stretch(spark, SF), "i", "x")
    for track, n in before.items():
        assert abs(len(after[track]) - n / 1.25) <= 2048 and all(math.isfinite(x) for _, x in after[track])


def test_midi_files_say_the_notes(spark):
    notes = by_track(D.note_events(spark, SF), "pitch", "velocity")
    for r in Q.midi_files(spark, SF).collect():
        content = next(bytes(r[c]) for c in r.__fields__ if isinstance(r[c], (bytes, bytearray)))
        on = sorted((p, v) for _, kind, p, v in E.parse_midi(content) if kind == 1 and v > 0)
        assert on == notes[r["track_id"]]

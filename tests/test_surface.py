"""What SQL and streams offer, against the DataFrame forms."""

import json
import os
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import functions as F

from tessitura.functions import surface
from tessitura.functions import text as X
from tessitura.operators import cache as H
from tessitura.operators import chords as C
from tessitura.operators import engraving as G
from tessitura.operators import frames as N
from tessitura.operators import quantize as Q
from tessitura.operators import repair as W
from tessitura.operators import score as E
from tessitura.operators import tempo as T
from tessitura.plans import catalog
from tessitura.plans import lead_sheet as Z
from tessitura.sources import bindings as D
from tessitura.streaming import chunks as R

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_scalar_functions_equal_the_column_forms(spark):
    surface.register_functions(spark)
    notes = D.note_events(spark, SF).select((F.col("start_time") * 2 - 3).alias("x"), ((F.col("pitch") * 37) % 4096).alias("mask"), (F.col("pitch") % 13 - 1).cast("int").alias("bass"))
    notes.union(spark.createDataFrame([(None, None, None), (0.0, 0, -1), (0.125, 4095, 11)], notes.schema)).createOrReplaceTempView("sql_notes")
    df = spark.table("sql_notes")
    assert same(spark.sql("SELECT x, snap_beat(x), snap_length(x) FROM sql_notes"), df.select("x", Q.snap_start(F.col("x")), Q.snap_duration(F.col("x"))))
    named = C.symbols(df)
    named.createOrReplaceTempView("sql_chords")
    assert same(spark.sql("SELECT mask, bass, chord_symbol(mask, bass) FROM sql_notes"), named.select("mask", "bass", "symbol")) and named.where("symbol is not null").count() > 100
    parsed = named.select("symbol", X.parse_chord(F.col("symbol")).alias("p")).select("symbol", "p.root", "p.suffix", "p.bass", X.chord_kind(F.col("p.suffix")).alias("kind"), X.pitch_class(F.col("symbol")).alias("pc"))
    assert same(spark.sql("SELECT symbol, p.root, p.suffix, p.bass, chord_kind(p.suffix), pitch_class(symbol) FROM (SELECT symbol, parse_chord(symbol) AS p FROM sql_chords)"), parsed)
    plan = spark.sql("SELECT snap_beat(x) FROM sql_notes")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_a_chord_of_unknown_mask_or_bass_has_no_symbol(spark):
    surface.register_functions(spark)
    sets = spark.createDataFrame([(None, None), (None, 3), (7, None), (-1, 0), (4096, 11), (0, -1), (145, 0), (4095, 11)], "mask int, bass int").repartition(1)
    sets.createOrReplaceTempView("sql_sets")
    found = spark.sql("SELECT mask, bass, chord_symbol(mask, bass) AS symbol FROM sql_sets")
    assert same(found, C.symbols(sets)) and [r[:2] for r in found.where("symbol is not null").collect()] == [(145, 0), (4095, 11)]


def test_note_positions_by_lateral(spark):
    surface.register_functions(spark)
    page = "<svg viewBox='0 0 100 50'><g id='n3_60_480_240'><rect x='10' y='5' width='4' height='2'/></g><g id='n60_0_120'><rect x='1' y='1' width='1' height='1'/></g></svg>"
    pages = spark.createDataFrame([(1, page), (2, "<svg"), (3, None), (4, "")], "page_id bigint, svg string")
    pages.createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT page_id, n.* FROM sql_pages, LATERAL note_positions(svg) n")
    assert same(got, G.note_positions(pages)) and got.count() == 2


def test_tied_pieces_by_lateral(spark):
    surface.register_functions(spark)
    notes, segments, meters = D.note_events(spark, SF), D.tempo_segments(spark, SF), catalog.signatures(spark, SF)
    ends = Q.beat_ends(notes, segments, meters).select("track_id", "id", "b0", "b1")
    bars = Q.barline_positions(meters).groupBy("track_id").agg(F.collect_set("beat").alias("bars"))
    ends.join(bars, "track_id").createOrReplaceTempView("sql_ends")
    got = spark.sql("SELECT track_id, id, t.* FROM sql_ends, LATERAL tied_pieces(b0, b1, bars) t").select("track_id", "id", "seg_no", "beat_start", "beat_duration", "tie_start", "tie_stop")
    want = Q.tied_notes(notes, segments, meters).select(*got.columns)
    assert same(got, want) and got.where("tie_stop").count() > 10


def test_whole_bars_by_lateral(spark):
    surface.register_functions(spark)
    beats = [0.5 * k for k in range(8)] + [0.5 * k for k in range(30, 40)]
    tracks = spark.createDataFrame([(1, beats, [0.0, 2.0, 16.0, 18.0], 4), (2, [], [], 4), (3, None, None, None)], "track_id bigint, beats array<double>, downs array<double>, bpb int")
    tracks.createOrReplaceTempView("sql_tracks")
    got = {(r["track_id"], r["kind"], r["idx"]): r["t"] for r in spark.sql("SELECT track_id, b.* FROM sql_tracks, LATERAL whole_bars(beats, downs, bpb) b").collect()}
    grid, downs = W.whole_bars(beats, [0.0, 2.0, 16.0, 18.0], 4)
    assert got == {(1, kind, n): t for kind, ts in (("beat", grid), ("downbeat", downs)) for n, t in enumerate(ts)} and len(grid) > len(beats)


def write(folder, n, rows):
    file = folder / f"{n}.json"
    file.write_text("\n".join(map(json.dumps, rows)))
    os.utime(file, (1_700_000_000 + n,) * 2)


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(out)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def at(ms):
    return f"2024-01-01T00:{ms // 60000:02d}:{ms % 60000 // 1000:02d}.{ms % 1000:03d}"


def test_frames_meet_the_clock_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    for name in ("frames", "clock"):
        (tmp_path / name).mkdir()
    for part in range(3):
        base = part * 10_000
        write(tmp_path / "frames", part, [{"stream_id": s, "frame": part * 50 + n, "ts": at(base + n * 200), "pts": int((base + n * 200 + rng.choice([-700, -30, 0, 8, 60])) * 1000)} for s in (1, 2) for n in range(50)])
        write(tmp_path / "clock", part, [{"stream_id": s, "ts": at(base + n * 400), "clock": (base + n * 400) * 1000} for s in (1, 2) for n in range(25)])
    late = {"stream_id": 1, "frame": 999, "ts": at(100), "pts": 100_000}  # twenty seconds behind what came before
    write(tmp_path / "frames", 3, [late, {"stream_id": 1, "frame": 1000, "ts": at(31_000), "pts": 31_000_000}])
    write(tmp_path / "clock", 3, [{"stream_id": 1, "ts": at(31_000), "clock": 31_000_000}])
    f, c = "stream_id bigint, frame bigint, ts timestamp, pts bigint", "stream_id bigint, ts timestamp, clock bigint"
    batch = R.timed_frames(spark.read.schema(f).json(str(tmp_path / "frames")), spark.read.schema(c).json(str(tmp_path / "clock")))
    read = lambda kind, name: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    run(R.timed_frames(read(f, "frames"), read(c, "clock")), tmp_path / "out", tmp_path / "ck")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert same(got, batch.where("frame != 999")) and {r["class"] for r in got.collect()} == {"drop", "show", "hold", "seek"} and batch.where("frame = 999").count() > 0


def test_highlights_hold_fall_and_expire(spark, tmp_path):
    rng = np.random.default_rng(6)
    probs = {k: [float(x) for x in rng.random(60) ** 2] for k in (1, 2)}
    source = tmp_path / "in"
    source.mkdir()
    row = lambda k, n, ms: {"key": k, "seq": n, "ts": at(ms), "prob": probs[k][n]}
    write(source, 0, [row(k, n, n * 50) for k in (1, 2) for n in range(20)])
    write(source, 1, [row(k, n, n * 50) for k in (1, 2) for n in range(20, 40)])
    write(source, 2, [row(1, n, n * 50 + 5000) for n in range(40, 45)])  # both were silent for over two seconds
    write(source, 3, [row(1, n, n * 50 + 9000) for n in range(45, 50)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema("key bigint, seq bigint, ts timestamp, prob double").option("maxFilesPerTrigger", 1).json(str(source))
        run(R.highlight_stream(stream, 0.05, hold=0.15), tmp_path / "out", tmp_path / "ck")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    levels = {(r["key"], r["seq"]): r["level"] for r in rows if not r["expired"]}
    frames = spark.createDataFrame([(k, 60, n, p) for k, ps in probs.items() for n, p in enumerate(ps[:40])], "track_id bigint, pitch int, frame int, prob double")
    want = {(r["track_id"], r["frame"]): r["level"] for r in N.highlight_decay(frames, 0.05, hold=0.15).collect()}
    assert all(abs(levels[k] - v) < 1e-12 for k, v in want.items())
    assert {r["key"] for r in rows if r["expired"]} == {1, 2} and len([r for r in rows if r["key"] == 2 and r["expired"]]) == 1
    plain, level, left = {}, 0.0, 0
    for n, p in enumerate(probs[1][:40]):  # three frames of hold
        if p >= level:
            left = 3
        elif left > 0:
            left -= 1
            plain[n] = level
            continue
        level += min(1.0, max(0.02, 1 - np.exp(-1.0))) * (p - level)
        plain[n] = level
    assert all(abs(levels[1, n] - v) < 1e-12 for n, v in plain.items())


def test_score_with_slash_chords_degrees_and_clefs(spark):
    """Bass and degrees of chord symbols, the clef of a single staff, and no empty measures at the end."""
    notes = spark.createDataFrame([(1, 1, 40, 0.0, 4.0), (1, 2, 41, 4.0, 4.0), (1, 3, 72, 12.0, 4.0), (2, 1, 72, 0.0, 1.0)], "track_id bigint, id int, pitch int, beat_start double, beat_duration double").withColumn("velocity", F.lit(90))
    chords = spark.createDataFrame([(1, 0.0, "C7b9/E"), (1, 5.0, "Bb-7b5"), (1, 12.0, "D13#11")], "track_id bigint, beat double, symbol string")
    meters = spark.createDataFrame([(1, 0.0, 40.0, 4, 4), (2, 0.0, 40.0, 4, 4)], "track_id bigint, start_beat double, end_beat double, numerator int, denominator int")
    trees = {r["track_id"]: ElementTree.fromstring(r["xml"]) for r in E.musicxml(notes, chords, signatures=meters, single_staff=True).collect()}
    measures = trees[1].findall("part/measure")
    assert len(measures) == 4 and len(trees[2].findall("part/measure")) == 1
    texts = [[(h.findtext("root/root-step"), h.findtext("root/root-alter"), h.findtext("kind"), h.findtext("bass/bass-step"), [(d.findtext("degree-value"), d.findtext("degree-alter"), d.findtext("degree-type")) for d in h.findall("degree")]) for h in m.findall("harmony")] for m in measures]
    assert texts[0] == [("C", None, "dominant", "E", [("9", "-1", "alter")])] and texts[1] == [("B", "-1", "minor-seventh", None, [("5", "-1", "alter")])]
    assert texts[3] == [("D", None, "dominant-13th", None, [("11", "1", "add")])]
    assert [m.findtext("attributes/clef/sign") for m in measures] == ["F", None, None, "G"]  # the third measure is empty and repeats
    assert [m.find("attributes/staves") is None for m in measures[:1]] == [True]
    two = ElementTree.fromstring(E.musicxml(notes.where("track_id = 2"), signatures=meters).first()["xml"])
    assert [c.findtext("sign") for c in two.findall("part/measure/attributes/clef")] == ["G", "F"]


def test_altered_degrees(spark):
    rows = spark.createDataFrame([("7b9b5",), ("7b9#9b5",), ("7#11",), ("Δ7",), ("-7b5",), ("b13#5",)], "s string").select("s", X.alterations(F.col("s")).alias("a"), X.unaltered(F.col("s")).alias("u"), X.degrees(F.col("s")).alias("d")).collect()
    assert [(r["a"], r["u"]) for r in rows] == [(["b9", "b5"], "7"), (["b9", "b5", "#9"], "7"), (["#11"], "7"), ([], "Δ7"), (["b5"], "-7"), (["#5", "b13"], "")]
    assert [tuple(d) for d in rows[0]["d"]] == [(9, -1, "alter"), (5, -1, "alter")]


def test_lead_sheet_with_a_given_tempo_map(spark):
    notes, segments = D.note_events(spark, SF), D.tempo_segments(spark, SF)
    some = [r["track_id"] for r in notes.select("track_id").distinct().orderBy("track_id").limit(3).collect()]
    tempo = spark.createDataFrame([(t, 120.0, 0.5) for t in some], "track_id bigint, bpm double, confidence double")
    sheet = Z.lead_sheet_with_tempo_map(notes.where(F.col("track_id").isin(some)), tempo, segments.where(F.col("track_id").isin(some[:2])))
    assert set(sheet) == {"tempo", "tempo_segments", "time_signatures", "quantized_notes", "tied_notes", "melody", "chord_changes", "confidence"}
    for name, table in sheet.items():
        assert {r["track_id"] for r in table.select("track_id").distinct().collect()} == set(some[:2]), name
    own = notes.where(F.col("track_id") == some[0])
    meter = T.infer_meter(own, segments.where(F.col("track_id") == some[0]))
    assert same(sheet["quantized_notes"].where(F.col("track_id") == some[0]), Q.quantize_tempo_map(own, segments.where(F.col("track_id") == some[0]), meter))
    assert sheet["melody"].count() <= sheet["quantized_notes"].count()


def test_cache_diagnostics_tell_every_reason(spark):
    good = dict(content_hash="s", entry=1, variant_key=7, sample_rate=100, quality=1, speed=1.0, pitch=0.0, use_cqt=True, preprocess=True, n_samples=1000, version=H.VERSION, step_sec=0.1, timeline=[[0.5, 0.25]] * 100)
    cases = {
        "other_version": good | {"version": 3}, "other_parameters": good | {"quality": 2}, "other_length": good | {"n_samples": 5000, "timeline": [[0.5, 0.25]] * 500}, "invalid_timeline": good | {"timeline": [[0.5]]}, "ok": good,
    }
    kind = "content_hash string, entry int, variant_key bigint, sample_rate int, quality int, speed double, pitch double, use_cqt boolean, preprocess boolean, n_samples bigint, version int, step_sec double, timeline array<array<double>>"
    columns = [c.split()[0] for c in kind.split(", ")]
    entries = spark.createDataFrame([tuple((row | {"entry": n + 5})[c] for c in columns) for n, row in enumerate(cases.values())], kind)
    packed = {r["entry"]: bytes(r["content"]) for r in H.pack_entries(entries).collect()}
    import zstandard

    files = [("s", 1, 7, None, False), ("s", 2, 7, None, True), ("s", 3, 7, b"rubbish", True), ("s", 4, 7, zstandard.compress(b"{nothing"), True), *(("s", n, 7, packed[n], True) for n in range(5, 10)), ("s", 99, 8, packed[9], True)]
    blobs = spark.createDataFrame(files, "content_hash string, entry int, variant_key bigint, content binary, exists boolean")
    wanted = spark.createDataFrame([("s", 7, 100, 1, 1.0, 0.0, True, True, 1000), ("none", 7, 100, 1, 1.0, 0.0, True, True, 1000)], "content_hash string, variant_key bigint, sample_rate int, quality int, speed double, pitch double, use_cqt boolean, preprocess boolean, n_samples bigint")
    facts = H.open_entries(blobs, width=2)
    assert {r["entry"]: r["opened"] for r in facts.collect()} == {1: "no_file", 2: "unreadable", 3: "not_decompressed", 4: "not_parsed", **{n: "ok" for n in (5, 6, 7, 8, 9, 99)}}
    rows = {r["content_hash"]: r.asDict() for r in H.diagnosed(wanted, facts, width=2).collect()}
    assert all(rows["s"][r] == 1 for r in (*H.UNREAD, *H.REASONS)) and (rows["s"]["candidates"], rows["s"]["files"], rows["s"]["parsed"], rows["s"]["entry"]) == (10, 8, 5, 9)
    assert rows["none"]["candidates"] == 0 and rows["none"]["entry"] is None
    other = H.diagnosed(wanted.withColumn("variant_key", F.lit(8).cast("bigint")), facts, width=2).where("content_hash = 's'").first()
    assert (other["entry"], other["files"], other["other_version"]) == (99, 1, 0)  # its own variant's entry serves at once
    plan = H.judged(wanted, entries, width=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "timeline#" not in plan.split("Join")[0]

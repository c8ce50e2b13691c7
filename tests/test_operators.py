"""Operators on small inputs with known results, and folds against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import text as X
from tessitura.operators import beats as B
from tessitura.operators import chords as C
from tessitura.operators import frames as N
from tessitura.operators import hmm as V
from tessitura.operators import melody as P
from tessitura.operators import models as M
from tessitura.operators import quantize as Q
from tessitura.operators import score as E
from tessitura.operators import signal as A
from tessitura.operators import spectral as S
from tessitura.operators import tempo as T
from tessitura.operators import timejoin as J
from tessitura.sources import listing, wav

NOTE = "track_id bigint, id int, pitch int, start_time double, end_time double, velocity int"


def notes(spark, rows):
    return spark.createDataFrame([(1, i, p, s, e, v) for i, (p, s, e, v) in enumerate(rows)], NOTE)


def metronome(spark, n=64, gap=0.5):
    return notes(spark, [(60, i * gap, i * gap + 0.1, 100) for i in range(n)])


def test_bpm_of_a_metronome(spark):
    assert abs(T.resolve_octave(metronome(spark)).first()["bpm"] - 120) < 1.5
    assert T.bpm_autocorrelation(metronome(spark, 2)).count() == 0


def test_chained_dedup_is_not_a_lag(spark):
    assert B.chain_kept([0.0, 0.004, 0.008, 0.012, 0.1], 0.005) == [0.0, 0.008, 0.1] and B.chain_kept([0.0, 0.005], 0.005) == [0.0]
    got = T.onset_lists(notes(spark, [(60, x, x + 1, 90) for x in (0.1, 0.0, 0.004, 0.008, 0.012)])).first()["onsets"]
    assert got == [0.0, 0.008, 0.1]


def test_tempo_change_gives_two_segments(spark):
    rows = [(64, i * 0.5, i * 0.5 + 0.1, 100) for i in range(16)] + [(67, 8 + i * 0.4, 8.1 + i * 0.4, 100) for i in range(16)]
    found = T.tempo_segments(notes(spark, rows)).orderBy("seg_no").collect()
    assert len(found) >= 2 and found[0]["start_time_sec"] == 0.0 and abs(found[-1]["end_time_sec"] - 14.1) < 1e-9
    for a, b in zip(found, found[1:]):
        assert a["end_time_sec"] == b["start_time_sec"] and b["beat_offset"] == pytest.approx(a["beat_offset"] + (a["end_time_sec"] - a["start_time_sec"]) / a["beat_duration_sec"])


def test_time_to_beat_over_two_segments(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 8.0, 120.0, 0.5, 0.0), (1, 1, 8.0, 16.0, 150.0, 0.4, 16.0)], "track_id bigint, seg_no int, start_time_sec double, end_time_sec double, bpm double, beat_duration_sec double, beat_offset double")
    points = spark.createDataFrame([(1, 9.2), (1, -1.0), (1, 20.0)], "track_id bigint, t double")
    got = {r["t"]: r["beat"] for r in J.time_to_beat(points, seg).collect()}
    assert got[9.2] == pytest.approx(19.0) and got[-1.0] == pytest.approx(-2.0) and got[20.0] == pytest.approx(46.0)


@pytest.mark.parametrize("value,margin,want", [(1.48, 0.03, 1.5), (1.04, 0.05, 1.0)])
def test_snap(spark, value, margin, want):
    assert spark.range(1).select(Q.snap_start(F.lit(value), margin=margin).alias("x")).first()["x"] == want


def test_quantise_one_note(spark):
    row = Q.quantize_constant(notes(spark, [(60, 0.49, 1.01, 90)]), 120.0).first()
    assert (row["beat_start"], row["beat_duration"]) == (1.0, 1.0)


def rhythm(spark, segments=((0, 0.0, 20.0, 120.0, 0.5, 0.0),), signatures=((0.0, 8.0, 4, 4, 1.0),)):
    seg = spark.createDataFrame([(1, *s) for s in segments], "track_id bigint, seg_no int, start_time_sec double, end_time_sec double, bpm double, beat_duration_sec double, beat_offset double")
    return seg, spark.createDataFrame([(1, *s) for s in signatures], "track_id bigint, start_beat double, end_beat double, numerator int, denominator int, confidence double")


def test_ties_at_a_barline(spark):
    pieces = Q.tied_notes(notes(spark, [(60, 1.4, 2.6, 90), (62, 0.1, 0.4, 90)]), *rhythm(spark)).collect()
    long = sorted((p for p in pieces if p["pitch"] == 60), key=lambda p: p["seg_no"])
    assert [(p["beat_start"], p["beat_duration"], p["tie_start"], p["tie_stop"]) for p in long] == [(2.75, 1.25, True, False), (4.0, 1.25, False, True)]
    short = [p for p in pieces if p["pitch"] == 62]
    assert len(short) == 1 and not short[0]["tie_start"] and not short[0]["tie_stop"]


def test_barlines_do_not_lie_where_a_signature_begins(spark):
    _, signatures = rhythm(spark, signatures=[(0.0, 8.0, 4, 4, 1.0), (8.0, 14.0, 3, 4, 1.0)])
    assert sorted(r["beat"] for r in Q.barline_positions(signatures).collect()) == [4.0, 11.0]


def test_compound_meter_has_thirds(spark):
    segments, signatures = rhythm(spark, signatures=[(0.0, 8.0, 6, 8, 1.0)])
    row = Q.quantize_tempo_map(notes(spark, [(60, 0.0, 0.165, 90)]), segments, signatures).first()
    assert abs(row["beat_duration"] - 1 / 3) < 0.06
    assert Q.quantize_tempo_map(notes(spark, [(60, 0.0, 0.165, 90)]), segments).first()["beat_duration"] == 0.25
    late = Q.quantize_tempo_map(notes(spark, [(60, 5.0, 5.165, 90)]), segments, signatures).first()
    assert late["beat_duration"] == 0.25  # no signature holds beat 10


def test_notes_across_two_segments(spark):
    segments, _ = rhythm(spark, segments=[(0, 0.0, 8.0, 120.0, 0.5, 0.0), (1, 8.0, 16.0, 150.0, 0.4, 16.0)])
    assert Q.quantize_tempo_map(notes(spark, [(60, 7.9, 8.4, 90)]), segments).first()["beat_start"] >= 15.5


def test_beat_to_time_keeps_to_the_first_segment_at_its_end(spark):
    segments, _ = rhythm(spark, segments=[(0, 0.0, 8.0, 120.0, 0.5, 0.0), (1, 9.0, 16.0, 150.0, 0.4, 16.0)])
    points = spark.createDataFrame([(1, b) for b in (-1.0, 0.0, 16.0, 16.5, 99.0)], "track_id bigint, beat double")
    got = {r["beat"]: r["t"] for r in J.beat_to_time(points, segments).collect()}
    assert got[0.0] == 0.0 and got[16.0] == 8.0 and got[16.5] == pytest.approx(9.2) and got[99.0] == 16.0


def test_accents_of_three_give_a_meter_of_three(spark):
    segments, _ = rhythm(spark, segments=[(0, 0.0, 18.0, 120.0, 0.5, 0.0)])
    rows = notes(spark, [(60, i * 1.5, i * 1.5 + 0.2, 118) for i in range(12)])
    found = T.infer_meter(rows, segments, least=4).collect()
    assert [(r["numerator"], r["denominator"]) for r in found] in ([(3, 4)], [(6, 8)]) and found[0]["end_beat"] == 36.0
    few = T.infer_meter(notes(spark, [(60, 0.0, 0.2, 118)]), segments).first()
    assert (few["numerator"], few["denominator"], few["confidence"]) == (4, 4, 0.2)


def test_meter_scores_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(60, t := rng.random() * 30, t + 0.2, rng.randrange(1, 128)) for _ in range(60)]
    segments, _ = rhythm(spark, segments=[(0, 0.0, 12.0, 120.0, 0.5, 0.0), (1, 12.0, 40.0, 100.0, 0.6, 24.0)])
    got = {(r["seg_no"], r["numerator"], r["denominator"]): r["score"] for r in T.meter_scores(notes(spark, rows), segments).collect()}
    for seg, a, z, beat in ((0, 0.0, 12.0, 0.5), (1, 12.0, 40.0, 0.6)):
        for n, d, prior in ((2, 4, 0.92), (3, 4, 0.94), (4, 4, 1.0), (6, 8, 0.90), (12, 8, 0.86)):
            h = [0.0] * n
            for _, t, _, v in rows:
                if a <= t < z:
                    phase = (t - a) / beat % n
                    k = int(np.floor(phase + 0.5)) % n
                    h[k] += min(1, max(0.2, v / 127)) * min(1, max(0.15, 1 - 0.7 * abs(phase - k)))
            best = max(h[r] * 1.35 - (sum(h) - h[r]) / (n - 1) + sum(h) / n for r in range(n)) / max(sum(h), 1)
            assert got[seg, n, d] == pytest.approx(best + prior)


def test_window_tempo_equals_the_relational_one(spark):
    rng = random.Random(7)
    for gap in (0.31, 0.5, 0.66, 0.9):
        starts = [max(0.0, i * gap + rng.uniform(-0.02, 0.02)) for i in range(24)] + [3.3, 4.7]
        row = T.resolve_octave(notes(spark, [(60, t, t + 0.1, 90) for t in starts])).first()
        assert T.tempo_of(starts) == pytest.approx(row["bpm"])
    assert T.tempo_of([0.0, 1.0]) is None


def test_subdivisions_reach_twelfths(spark):
    row = spark.range(1).select(*(T.subdivision_error(F.lit(x), F.lit(1.0)).alias(f"e{i}") for i, x in enumerate((1.125, 5 / 12, 0.0625, 2.0)))).first()
    assert [round(x, 9) for x in row] == [0.0, 0.0, round(1 / 12 - 1 / 16, 9), 0.0]


def test_joins_in_time_carry_a_bucket(spark):
    beats = spark.createDataFrame([(1, 0, 0.0)], "track_id bigint, beat_idx int, t double")
    plan = B.bar_counts(beats, beats.withColumnRenamed("beat_idx", "db_idx"))._jdf.queryExecution().executedPlan().toString()
    assert "__b" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    segments, _ = rhythm(spark)
    plan = J.segment_at_time(beats, segments, "t")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") <= 1


def test_styles_by_bar(spark):
    aligned = spark.createDataFrame([(1, i, 60 + i, i * 0.5, i * 0.5 + 0.1, 90, i, i // 2, pos, 0.5) for i, pos in enumerate((0.65, 0.0, 0.65, 0.3))], NOTE + ", beat_index int, bar_index int, intra_beat_pos double, beat_duration_sec double")
    sections = spark.createDataFrame([(1, 0, 1, "Swing"), (1, 1, 2, "Straight")], "track_id bigint, bar_start int, bar_end int, style string")
    got = {r["id"]: (round(r["beat_start"], 3), r["swing_style"]) for r in Q.quantize_aligned(aligned, sections).collect()}
    assert got == {0: (0.667, "Swing"), 1: (1.0, "Swing"), 2: (2.5, "Straight"), 3: (3.5, "Straight")}
    many = spark.createDataFrame([(1, 0, 4, "Swing"), (1, 4, 12, "Straight"), (2, 0, 4, "Swing")], "track_id bigint, bar_start int, bar_end int, style string")
    assert {r["track_id"]: r["style"] for r in Q.majority_sections(many).collect()} == {1: "Straight", 2: "Swing"}


def test_association(spark):
    beats = spark.createDataFrame([(1, i, i * 0.5) for i in range(5)], "track_id bigint, beat_idx int, t double")
    downs = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0)], "track_id bigint, db_idx int, t double")
    rows = {r["id"]: r for r in Q.associate(notes(spark, [(60, 0.25, 0.4, 90), (60, 0.0, 0.1, 90), (60, 9.0, 9.1, 90)]), beats, downs).collect()}
    assert rows[0]["intra_beat_pos"] == pytest.approx(0.5) and rows[0]["beat_index"] == 0
    assert rows[1]["intra_beat_pos"] == 0 and rows[2]["beat_index"] == 3
    assert B.beats_per_bar(beats, downs).first()["beats_per_bar"] == 4


def test_aligned_quantise_equals_brute_force(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(60, 63), round(rng.randrange(80) * 0.25, 3), 0.0, 90) for _ in range(120))
    rows = [(p, s, s + rng.choice([0.02, 0.2, 0.7]), v) for p, s, _, v in rows]
    beats = spark.createDataFrame([(1, i, i * 0.5) for i in range(45)], "track_id bigint, beat_idx int, t double")
    downs = spark.createDataFrame([(1, i, i * 2.0) for i in range(12)], "track_id bigint, db_idx int, t double")
    aligned = Q.associate(notes(spark, rows), beats, downs)
    got = {r["id"]: r["beat_duration"] for r in Q.quantize_aligned(aligned).collect()}
    ordered = sorted(((s, i, p, e) for i, (p, s, e, _) in enumerate(rows)))
    facts = {r["id"]: r for r in aligned.collect()}
    for k, (s, i, p, e) in enumerate(ordered):
        later = [t for t, _, q, _ in ordered[k + 1 :] if q != p or t > s + 0.001]
        raw = (min(later) - s if later and min(later) > s else max(0.05, e - s)) / facts[i]["beat_duration_sec"]
        pos = min((0.0, 0.5, 1.0), key=lambda x: abs(facts[i]["intra_beat_pos"] - x))
        grid = max(pos, 0.25)
        assert got[i] == pytest.approx(max(grid, np.floor(raw / grid + 0.5) * grid)), i


def test_straight_sections(spark):
    rows = [(1, i, 60, i * 0.5, i * 0.5 + 0.1, 90, i % 4, i // 4, 0.0) for i in range(16)]
    aligned = spark.createDataFrame(rows, NOTE + ", beat_index int, bar_index int, intra_beat_pos double")
    assert Q.swing_sections(aligned).first()["style"] == "Straight"


def test_two_chords(spark):
    rows = [(1, i, p, b, 2.0) for i, (p, b) in enumerate([(60, 0.0), (64, 0.0), (67, 0.0), (62, 2.0), (65, 2.0), (69, 2.0)])]
    q = spark.createDataFrame(rows, "track_id bigint, id int, pitch int, beat_start double, beat_duration double")
    found = [r["symbol"] for r in C.chord_scan(q).orderBy("beat").collect()]
    assert found[0] == "C" and len(found) >= 2 and found[1].startswith("D-")
    assert [r["symbol"] for r in C.chords_per_bar(q).orderBy("beat").collect()][0] == "C"


@pytest.mark.parametrize("root,bass,want", [("A", 1, "C#"), ("C", 3, "Eb"), ("D", 6, "F#"), ("E", 8, "G#"), ("Bb", 2, "D"), ("Gb", 10, "Bb"), ("Ab", 11, "B"), ("Db", 5, "F"), ("B", 3, "D#")])
def test_bass_is_spelled_by_its_interval(root, bass, want):
    assert C.bass_name(C.FLATS.index(root), bass) == want


def test_where_chords_of_a_bar_lie():
    choose = lambda *bars: C.bar_choices(list(bars), 4.0)
    assert choose((0, (1.75, 3, "C"), None, None)) == [(0.0, "C")]  # near the half bar: at the beginning
    assert choose((0, (1.0, 3, "C"), None, None)) == [(1.0, "C")]  # off both
    assert choose((1, (4.0, 3, "C"), (6.25, 3, "G"), None)) == [(4.0, "C"), (6.0, "G")]
    assert choose((0, (0.5, 2, "C5"), None, (2, "C5"))) == [(0.0, "C5")]  # two classes count on the downbeat alone
    assert choose((0, (0.0, 3, "C"), None, None), (1, (4.0, 3, "C"), None, (2, "C5")), (2, (8.0, 3, "C"), None, None)) == [(0.0, "C"), (4.0, "C5"), (8.0, "C")]


def test_chords_per_bar_equal_a_plain_scan(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.randrange(48, 72), rng.randrange(60) * 0.25, rng.choice([0.25, 0.5, 1.0, 2.0])) for i in range(90)]
    q = spark.createDataFrame(rows, "track_id bigint, id int, pitch int, beat_start double, beat_duration double")
    names = {(r["mask"], r["bass"]): r["symbol"] for r in C.chord_table(spark).collect()}

    def heard(at):
        on = [(p, d) for _, _, p, s, d in rows if s - 1e-5 <= at < s + d]
        pcs = {p % 12 for p, _ in on}
        return (len(pcs), round(len(pcs) * 5 + sum(d for _, d in on) * 2 + len(on), 6), names.get((sum(1 << p for p in pcs), min(p for p, _ in on) % 12))) if on else None

    bars = []
    for bar in range(int(max(s + d for *_, s, d in rows) // 4) + 1):
        halves = []
        for start in (bar * 4.0, bar * 4.0 + 2):
            best = None
            for k in range(8):
                h = heard(start + k * 0.25)
                if h and (best is None or h[:2] > best[1]):
                    best = (start + k * 0.25, h[:2], h[2])
            halves.append(best and (best[0], best[1][0], best[2]))
        down = heard(bar * 4.0)
        bars.append((bar, *halves, down and (down[0], down[2])))
    assert [(r["beat"], r["symbol"]) for r in C.chords_per_bar(q).orderBy("beat").collect()] == C.bar_choices(bars, 4.0)


def test_merge_equals_plain_python(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60, 63), s := rng.random() * 10, s + rng.random(), 90) for _ in range(200)]
    got = sorted((r["pitch"], r["start_time"], r["end_time"]) for r in N.merge_adjacent(notes(spark, rows), 0.1).collect())
    want = []
    for pitch in (60, 61, 62):
        run = None
        for s, e in sorted((s, e) for p, s, e, _ in rows if p == pitch):
            if run and s - run[1] < 0.1:
                run[1] = max(run[1], e)
            else:
                run and want.append((pitch, *run))
                run = [s, e]
        run and want.append((pitch, *run))
    assert got == sorted(want)


def test_viterbi_drops_flicker_and_stays_in_mask():
    rng = np.random.default_rng(3)
    p = rng.random((40, 5))
    path = V.binary_path(p)
    assert path.shape == p.shape and not (path & (p < 0.6)).any()
    assert not V.binary_path(np.array([[0.1], [0.7], [0.1]]), switch=2.0).any()


def test_joint_path_equals_dense_search(spark):
    states = V.rhythm_states(spark).orderBy("state_idx").collect()
    assert len(states) == 61 * 27
    rng = np.random.default_rng(1)
    obs = rng.random((4, len(states)))
    path = V.joint_path(obs)

    def cost(a, b):
        a, b = states[a], states[b]
        beats = V.METER_BEATS
        c = 0.3 * abs(a["tempo_bin"] - b["tempo_bin"]) + (1.5 if a["meter_class"] != b["meter_class"] else 0)
        d = b["phase"] - a["phase"]
        near = d == 1 or (b["phase"] == 0 and a["phase"] == beats[a["meter_class"]] - 1) or (a["phase"] == 0 and b["phase"] == beats[b["meter_class"]] - 1)
        return c + (0 if d == 0 else 0.1 if near else 0.5)

    def value(p):
        return obs[0, p[0]] + 10 * (states[p[0]]["phase"] == 0) + sum(obs[t, p[t]] - cost(p[t - 1], p[t]) for t in range(1, len(p)))

    best = value(path)
    for _ in range(300):
        other = path.copy()
        other[rng.integers(4)] = rng.integers(len(states))
        assert value(other) <= best + 1e-9


def test_downbeats_of_a_path(spark):
    path = spark.createDataFrame([(1, i, i % 4 + 5) for i in range(5)], "track_id bigint, frame int, state_idx int")
    assert [r["frame"] for r in V.path_downbeats(path, V.rhythm_states(spark)).orderBy("frame").collect()] == [0, 4]


def test_onsets(spark):
    cells = {1: [0, 1, 1, 0, 1], 2: [0, 0, 0, 1, 1]}
    rows = [(1, f, p, bool(on)) for p, xs in cells.items() for f, on in enumerate(xs)]
    got = {}
    for r in N.onsets(spark.createDataFrame(rows, "track_id bigint, frame int, pitch int, active boolean")).collect():
        got.setdefault(r["pitch"], []).append(r["frame"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 4], 2: [3]}


def test_pad_trim_threshold(spark):
    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    row = spark.range(1).select(A.pad_or_trim(x, 6).alias("a"), A.pad_or_trim(x, 2).alias("b"), N.threshold(F.array(F.lit(0.1), F.lit(0.7)), 0.5).alias("c")).first()
    assert row["a"] == [1, 2, 3, 0, 0, 0] and row["b"] == [1, 2] and row["c"] == [False, True]


@pytest.mark.parametrize("src,dst", [(441, 882), (441, 147), (441, 300), (300, 441)])
def test_resample_by_blocks_equals_whole(spark, src, dst):
    rng = np.random.default_rng(5)
    x = rng.random(512)
    blocks = spark.createDataFrame([(1, i, x[64 * i : 64 * i + 64].tolist()) for i in range(8)], "track_id bigint, block_no int, samples array<double>")
    got = np.array([r["x"] for r in A.resample(blocks, src, dst).orderBy("i").collect()])
    np.testing.assert_allclose(got, A.resampled(x, src, dst), atol=1e-9)
    assert len(got) == max(1, int(np.floor(512 * dst / src + 0.5)))


def test_overlap_add_of_ones(spark):
    ones = spark.range(600).select(F.lit(1).cast("bigint").alias("track_id"), F.col("id").alias("i"), F.lit(1.0).alias("x"))
    rows = A.overlap_add(A.cut_chunks(ones, 64, 48), 48).collect()
    assert len(rows) == 600 and all(abs(r["x"] - 1) < 1e-9 for r in rows)


def test_hann_and_stft():
    h = S.hann(101)
    assert h[0] >= 0 and h[50] > 0.99
    assert len(np.fft.rfft(np.zeros(2048))) == 1025


def test_octave_doubles_cqt_frequency():
    kernels = S.cqt_kernels(8000, 110.0, 880.0)
    peak = lambda k: abs(np.fft.rfftfreq(8000, 1 / 8000)[np.abs(np.fft.fft(np.real(k), 8000))[:4001].argmax()])
    assert peak(kernels[12]) / peak(kernels[0]) == pytest.approx(2, rel=0.05)


def test_stretch_length(spark):
    x = np.sin(np.arange(2000) / 10).tolist()
    rows = spark.createDataFrame([(1, x)], "track_id bigint, samples array<double>")
    assert len(A.stretch(rows, 1.5).first()["samples"]) == round(2000 / 1.5)
    assert A.stretch(rows, 1.0).first()["samples"] == x


def test_stems_sum_to_the_input():
    rng = np.random.default_rng(6)
    x = rng.standard_normal(512)
    stems = M.MaskStemModel().predict(x)
    assert len(stems) == 6 and np.allclose(sum(stems.values()), x) and all(np.isfinite(v).all() for v in stems.values())


def test_note_pipeline_is_88_wide(spark):
    blocks = spark.createDataFrame([(1, i, [0.1] * 64) for i in range(3)], "track_id bigint, block_no int, samples array<double>")
    rows = M.note_pipeline(blocks, M.DetectorNoteModel(441.0, 8), 128, 8).collect()
    assert sorted(r["frame"] for r in rows) == list(range(16)) and all(len(r["probs"]) == 88 for r in rows)


@pytest.mark.parametrize("float32", [False, True])
def test_wav_round_trip(spark, tmp_path, float32):
    x = np.stack([np.sin(np.arange(500) / 9), np.cos(np.arange(500) / 7)], axis=1) * 0.5
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000, float32))
    (tmp_path / "bad.wav").write_bytes(b"nonsense")
    rows = listing.read_audio(spark, str(tmp_path), block=200).collect()
    good = sorted((r for r in rows if r["error"] is None), key=lambda r: r["block_no"])
    assert [len(r["samples"]) for r in good] == [200, 200, 100] and sum(r["error"] is not None for r in rows) == 1
    np.testing.assert_allclose(np.concatenate([r["samples"] for r in good]), x.mean(1), atol=1e-4)


def test_midi_round_trip(spark):
    events = [(0, 1, 60, 90), (480, 0, 60, 0), (200, 1, 64, 80)]
    assert E.parse_midi(E.midi_file(events)) == events


def test_beams_rests_and_tokens():
    assert E.beams_of([240, 240, 480, 120, 240, 240, 240]) == ["begin", "end", None, "begin", "continue", "continue", "end"] and E.beams_of([240, 480]) == [None, None]
    # an eighth, a gap of a sixteenth, a quarter tied over the barline; then a rest
    xml = E.voice_xml([(0, 60, 240, False, False, 1, "Staccato"), (360, 62, 840, False, True, 2, "Normal")], 0, 1440, 1, 1)
    assert xml.count("<note id=") == 2 and "<staccato/>" in xml and 'id="n2_62_360_480"' in xml and '<tied type="start"/>' in xml
    assert xml.count("<rest/>") == 2 and "<forward><duration>120</duration></forward>" in xml
    long = E.voice_xml([(0, 60, 600, False, False, 1, "Normal")], 0, 600, 1, 1)  # a quarter and a sixteenth, tied
    assert [t for t in ("n1_60_0_480", "n1_60_480_120") if t in long] == ["n1_60_0_480", "n1_60_480_120"] and long.count('<tied type="start"/>') == 1
    late = E.voice_xml([(0, 60, 480, False, False, 1, "Normal"), (240, 64, 480, False, False, 2, "Normal")], 0, 1920, 1, 1)
    assert "n2_64_240_240" in late and late.index("n1_60") < late.index("n2_64")


def test_measures_follow_the_signatures(spark):
    _, signatures = rhythm(spark, signatures=[(0.0, 8.0, 4, 4, 1.0), (8.0, 14.0, 3, 4, 1.0)])
    until = spark.createDataFrame([(1, 16 * 480)], "track_id bigint, end_tick bigint")
    got = [(r["measure"], r["start_tick"] // 480, r["end_tick"] // 480) for r in E.measure_boundaries(signatures, until).orderBy("measure").collect()]
    assert got == [(1, 0, 4), (2, 4, 8), (3, 8, 11), (4, 11, 14), (5, 14, 16)]
    spans = spark.createDataFrame([(1, 0, 60, 90, 7 * 480, 15 * 480, 1)], "track_id bigint, id int, pitch int, velocity int, start_tick int, end_tick int, staff int")
    pieces = E.split_into_measures(spans, E.measure_boundaries(signatures, until)).orderBy("measure").collect()
    assert [(p["measure"], p["start_tick"] // 480, p["end_tick"] // 480, p["tie_start"], p["tie_stop"]) for p in pieces] == [(2, 7, 8, True, False), (3, 8, 11, True, True), (4, 11, 14, True, True), (5, 14, 15, False, True)]


def test_score_says_meter_changes_swing_and_empty_measures(spark):
    q = spark.createDataFrame([(1, 0, 60, 90, 0.0, 1.0), (1, 1, 64, 90, 9.0, 1.0)], "track_id bigint, id int, pitch int, velocity int, beat_start double, beat_duration double")
    _, signatures = rhythm(spark, signatures=[(0.0, 8.0, 4, 4, 1.0), (8.0, 11.0, 3, 4, 1.0)])
    sections = spark.createDataFrame([(1, 1, 2, "Swing"), (1, 2, 9, "Straight")], "track_id bigint, bar_start int, bar_end int, style string")
    xml = E.musicxml(q, None, 120.0, signatures, sections).first()["xml"]
    import xml.etree.ElementTree as ET

    measures = ET.fromstring(xml.encode()).findall("part/measure")
    assert [m.get("number") for m in measures] == ["1", "2", "3"] and [len(m.findall("attributes/time")) for m in measures] == [1, 0, 1]
    assert measures[2].find("attributes/time/beats").text == "3" and [w.text for m in measures for w in m.iter("words")] == ["Swing", "Straight"]
    assert measures[1].findall("note/rest") and not measures[1].findall("note/pitch")


def test_musicxml_document(spark):
    q = Q.quantize_constant(notes(spark, [(60, 0.0, 0.5, 90), (40, 1.9, 2.4, 90), (64, 0.0, 0.5, 90), (67, 0.0, 0.5, 90)]), 120.0)
    xml = E.musicxml(q, C.chord_scan(q), 120.0).first()["xml"]
    for part in ("<score-partwise", '<measure number="1">', "<harmony>", "<staves>2</staves>", "<backup>"):
        assert part in xml


@pytest.mark.parametrize("fold", [P.continuity_fold, P.skyline_fold])
def test_melody_has_no_overlap(fold):
    import pandas as pd

    rng = random.Random(8)
    rows = [(1, i, rng.randrange(50, 80), s := i * 0.3, s + rng.random(), rng.randrange(40, 127)) for i in range(60)]
    out = fold(pd.DataFrame(rows, columns=["track_id", "id", "pitch", "start_time", "end_time", "velocity"]))
    assert len(out) and (out.end_time > out.start_time).all()
    empty = fold(pd.DataFrame([(1, 1, 60, 1.0, 1.0, 9)], columns=["track_id", "id", "pitch", "start_time", "end_time", "velocity"]))
    assert empty.empty


def test_text_functions(spark):
    row = spark.range(1).select(
        X.parse_chord(F.lit("Bb-7/F")).alias("p"), X.alterations(F.lit("7b9b5#11")).alias("a"), X.clock_text(F.lit(3661.0)).alias("c"), X.parse_clock(F.lit("1:01:01")).alias("s"), X.parse_colour(F.lit("#ff8000")).alias("k"),
        X.colour_hex(F.lit(255), F.lit(128), F.lit(0)).alias("h"), X.frame_rate(F.lit("30000/1001")).alias("f"), X.frame_rate(F.lit("1/0")).alias("z"), X.xml_escape(F.lit("<a&'\">")).alias("x"), X.stem_of(F.lit("Lead Vocals")).alias("v"),
    ).first()
    assert tuple(row["p"]) == (10, "-7", 5) and row["a"] == ["b9", "b5", "#11"] and row["c"] == "1:01:01" and row["s"] == 3661
    assert tuple(row["k"]) == (255, 128, 0) and row["h"] == "#ff8000" and abs(row["f"] - 29.97) < 0.01 and row["z"] is None
    assert row["x"] == "&lt;a&amp;&apos;&quot;&gt;" and row["v"] == "vocals"


def test_interval_join_uses_no_nested_loop(spark):
    a = spark.range(10).select(F.lit(1).alias("track_id"), F.col("id").cast("double").alias("t"))
    b = spark.createDataFrame([(1, 0.0, 4.5), (1, 4.5, 20.0)], "track_id int, s double, e double")
    plan = J.interval_join(a, b, "t", "s", "e", 4.0)
    assert plan.count() == 10
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()

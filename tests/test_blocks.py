"""Operators that cut tracks into blocks, against the same work over whole tracks."""

import numpy as np
import pytest

from tessitura.operators import hmm as V
from tessitura.operators import models as M
from tessitura.operators import repair as W
from tessitura.operators import spectral as S


def plain_viterbi(probs, switch=0.2, scale=1.0, confidence=0.6):
    """Two scores a frame in floats, with back-pointers: strict comparisons, off at a final tie."""
    n, width = probs.shape
    out = np.zeros((n, width), bool)
    for k in range(width):
        on, off = np.log(np.clip(probs[:, k] * scale, 1e-10, 1)), np.log(np.clip((1 - probs[:, k]) * scale, 1e-10, 1))
        score, back = [off[0], on[0]], []
        for t in range(1, n):
            from_off = (score[0], 0) if score[0] > score[1] - switch else (score[1] - switch, 1)
            from_on = (score[0] - switch, 0) if score[0] - switch > score[1] else (score[1], 1)
            back.append((from_off[1], from_on[1]))
            score = [from_off[0] + off[t], from_on[0] + on[t]]
        state = int(score[1] > score[0])
        for t in range(n - 1, -1, -1):
            out[t, k] = state
            if t:
                state = back[t - 1][state]
    return out & (probs >= confidence)


def cells(path):
    return {(int(t), int(p) + 21) for t, p in zip(*np.nonzero(path))}


def test_one_track_path_equals_two_scores_with_pointers():
    rng = np.random.default_rng(2)
    for width, switch in ((1, 0.2), (5, 1.0), (88, 3.0)):
        p = rng.random((200, width)) ** rng.uniform(0.2, 3)
        assert (V.binary_path(p, switch) == plain_viterbi(p, switch)).all()
    half = np.full((30, 2), 0.5)  # ties all the way: what the rules for ties say, then the confidence
    assert (V.binary_path(half, confidence=0.5) == plain_viterbi(half, confidence=0.5)).all()


@pytest.mark.parametrize("block,fan", [(1, 4), (7, 2), (64, 1024)])
def test_viterbi_by_blocks_equals_the_whole_track(spark, block, fan):
    rng = np.random.default_rng(block)
    tracks = {1: rng.random((60, 6)), 2: np.clip(rng.normal(0.55, 0.05, (45, 6)), 0, 1), 3: np.full((20, 6), 0.5), 4: rng.random((1, 6)), 5: np.repeat(rng.random((9, 6)), 6, axis=0)}
    rows = [(t, 3 * n + 11, p.tolist()) for t, probs in tracks.items() for n, p in enumerate(probs)]  # frames with gaps
    rng.shuffle(rows)
    frames = spark.createDataFrame([(int(t), int(n), [float(x) for x in p]) for t, n, p in rows], "track_id bigint, frame int, probs array<double>")
    for options in ({}, {"switch": 2.0, "confidence": 0.3}):
        got = {}
        for r in V.viterbi(frames, block, fan, **options).collect():
            got.setdefault(r["track_id"], set()).add(((r["frame"] - 11) // 3, r["pitch"]))
        for t, probs in tracks.items():
            assert got.get(t, set()) == cells(plain_viterbi(probs, **options)), (t, options)


def test_one_long_track_is_many_groups(spark):
    frames = spark.range(2000).selectExpr("1L as track_id", "cast(id as int) as frame", "array(rand(1), rand(2)) as probs")
    plan = V.viterbi(frames, 8, 16)._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "InPandas [" in line]
    assert groups and all("," in g for g in groups)  # never the track alone
    assert V.viterbi(frames.limit(0)).collect() == []


# separation


def stereo(n, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, 2)) * [1.0, 0.3] + [5.0, -2.0]


def cut(track, x, sizes):
    """Blocks of these sizes in turn."""
    out, at, k = [], 0, 0
    while at < len(x):
        size = sizes[k % len(sizes)]
        out.append((track, at, x[at : at + size].reshape(-1).tolist()))
        at, k = at + size, k + 1
    return out


def whole_separation(x, model, segment, stride):
    """The same over a whole track at once."""
    mean, deviation = x.mean(1).mean(), max(x.mean(1).std(), 1e-8)
    y, out, weights = (x - mean) / deviation, np.zeros((len(model.stems), len(x), 2)), np.zeros(len(x))
    w = np.array([min(i + 1, segment - i) if segment % 2 == 0 else min(i + 1, segment - i) for i in range(segment)], float)
    w /= w.max()
    for a in range(0, len(x), stride):
        part = np.zeros((segment, 2))
        part[: len(y[a : a + segment])] = y[a : a + segment]
        heard = model.infer(part.T)
        n = len(y[a : a + segment])
        for s in range(len(model.stems)):
            out[s, a : a + n] += heard[s].T[:n] * w[:n, None]
        weights[a : a + n] += w[:n]
    return out / weights[None, :, None] * deviation + mean


def gathered(df):
    parts = {}
    for r in df.collect():
        parts.setdefault((r["track_id"], r["stem"]), []).append((r["start_frame"], np.reshape(r["samples"], (-1, 2)), np.array(r["mono"])))
    return {k: (np.concatenate([y for _, y, _ in sorted(v, key=lambda t: t[0])]), np.concatenate([m for *_, m in sorted(v, key=lambda t: t[0])])) for k, v in parts.items()}


@pytest.mark.parametrize("segment,stride", [(100, None), (101, 75), (64, 20), (5000, None)])
def test_separation_around_an_identity_gives_the_input(spark, segment, stride):
    tracks = {1: stereo(1000, 1), 2: stereo(75, 2), 3: stereo(1, 3), 4: np.full((130, 2), 7.5)}
    rows = [b for t, x in tracks.items() for b in cut(t, x, (64, 1, 333))] + [(9, 0, [])]
    got = gathered(M.separate(spark.createDataFrame(rows, "track_id bigint, start_frame bigint, samples array<double>").repartition(3), M.IdentityStereoModel(("a", "b")), segment, stride))
    assert sorted(got) == [(t, s) for t in tracks for s in "ab"]
    for (t, _), (y, mono) in got.items():
        assert y.shape == tracks[t].shape and np.allclose(y, tracks[t], atol=1e-9) and np.allclose(mono, tracks[t].mean(1), atol=1e-9)


def test_separation_by_segments_equals_the_whole_track(spark):
    x, model = stereo(700, 4), M.MaskStereoModel()
    got = gathered(M.separate(spark.createDataFrame(cut(1, x, (50, 7)), "track_id bigint, start_frame bigint, samples array<double>"), model, 256, 192))
    want = whole_separation(x, model, 256, 192)
    for n, stem in enumerate(model.stems):
        assert np.allclose(got[1, stem][0], want[n], atol=1e-9)


def test_level_of_a_track_that_stands_far_off_zero(spark):
    x = stereo(4000, 5) * 1e-4 + 1e4
    (row,) = M.level_of(spark.createDataFrame(cut(1, x, (100,)), "track_id bigint, start_frame bigint, samples array<double>")).collect()
    assert row["frames"] == 4000 and np.isclose(row["mean"], x.mean()) and np.isclose(row["deviation"], x.mean(1).std(), rtol=1e-6)


def test_triangle():
    assert M.triangle(4).tolist() == [0.5, 1.0, 1.0, 0.5] and np.allclose(M.triangle(5), [1 / 3, 2 / 3, 1, 2 / 3, 1 / 3]) and M.triangle(1).tolist() == [1.0]


# medians, constant Q, tempo


@pytest.mark.parametrize("block", [1, 7, 40, 1000])
def test_hpss_by_blocks_equals_the_whole_track(spark, block):
    rng = np.random.default_rng(3)
    tracks = {1: rng.random((90, 20)) ** 3, 2: rng.random((1, 20)), 3: rng.random((33, 20))}
    rows = [(t, n, m.tolist()) for t, ms in tracks.items() for n, m in enumerate(ms)]
    frames = spark.createDataFrame(rows, "track_id bigint, frame bigint, magnitudes array<double>").repartition(3)
    got = {(r["track_id"], r["frame"]): (r["harmonic"], r["percussive"]) for r in S.hpss(frames, block).collect()}
    assert len(got) == len(rows)
    for t, ms in tracks.items():
        h, p = S.hpss_masks(ms)
        for n in range(len(ms)):
            assert (np.array(got[t, n][0]) == h[n]).all() and (np.array(got[t, n][1]) == p[n]).all()


@pytest.mark.parametrize("tile,hop,sizes", [(50, 1, (64,)), (64, 3, (7, 100)), (4096, 1, (1000,))])
def test_constant_q_over_tiles_equals_direct_correlation(spark, tile, hop, sizes):
    rng = np.random.default_rng(5)
    kernels = S.cqt_kernels(441.0, 27.5, 200.0)
    longest = max(map(len, kernels))
    tracks = {1: rng.standard_normal(500), 2: rng.standard_normal(longest), 3: rng.standard_normal(longest - 1)}
    rows = []
    for t, x in tracks.items():
        at = k = 0
        while at < len(x):
            rows.append((t, at, x[at : at + sizes[k % len(sizes)]].tolist()))
            at, k = at + sizes[k % len(sizes)], k + 1
    blocks = spark.createDataFrame([*rows, (1, 500, [])], "track_id bigint, start_frame bigint, samples array<double>")
    got = {(r["track_id"], r["frame"]): r["magnitudes"] for r in S.cqt_all(blocks, 441.0, 27.5, 200.0, hop, tile).collect()}
    want = {(t, n // hop): [abs(x[n : n + len(k)] @ k) for k in kernels] for t, x in tracks.items() for n in range(0, len(x) - longest + 1, hop)}
    assert got.keys() == want.keys() and not any(t == 3 for t, _ in got)
    for key, m in want.items():
        assert np.allclose(got[key], m, atol=1e-9)


def clicks(bpm, seconds, rate, seed):
    rng = np.random.default_rng(seed)
    x = 0.01 * rng.standard_normal(int(seconds * rate))
    for k in range(int(seconds * bpm / 60)):
        a = int((0.1 + k * 60 / bpm) * rate)
        x[a : a + rate // 50] += 0.8
    return x


@pytest.mark.parametrize("tile,size", [(256, 1000), (1 << 15, 777), (1000, 1 << 20)])
def test_tempo_by_tiles_equals_the_whole_track(spark, tile, size):
    rate = 4410
    tracks = {1: clicks(120, 9, rate, 1), 2: clicks(93, 14, rate, 2), 3: np.zeros(rate * 3), 4: clicks(100, 0.5, rate, 4), 5: clicks(70, 6.3, rate, 5)}
    rows = [(t, n, x[a : a + size].tolist()) for t, x in tracks.items() for n, a in enumerate(range(0, len(x), size))]
    blocks = spark.createDataFrame(rows, "track_id bigint, block_no int, samples array<double>").repartition(3)
    got = {r["track_id"]: r for r in W.audio_pulse(blocks, rate, tile=tile).collect()}
    want = {t: f for t, x in tracks.items() if (f := W.tempo_of_audio(x, rate))}
    assert got.keys() == want.keys() and {1, 2, 5} <= got.keys() and not {3, 4} & got.keys()
    for t, (bpm, confidence, onsets) in want.items():
        assert np.allclose([got[t]["bpm"], got[t]["confidence"], got[t]["first_onset"], got[t]["seconds"]], [bpm, confidence, onsets[0], len(tracks[t]) / rate])
    assert abs(want[1][0] - 120) < 3 or abs(want[1][0] - 60) < 2
    grid = {}
    for r in W.pulse_beats(blocks, rate, tile=tile).collect():
        grid.setdefault((r["track_id"], r["kind"]), []).append((r["idx"], r["t"]))
    for t in want:
        beats, downbeats = W.PulseModel().beats(tracks[t], rate)
        for kind, ts in (("beat", beats), ("downbeat", downbeats)):
            assert [i for i, _ in sorted(grid[t, kind])] == list(range(len(ts))) and np.allclose([x for _, x in sorted(grid[t, kind])], ts)


def test_beats_from_stems(spark):
    rate = 4410
    songs = {1: {"Bass": clicks(120, 9, rate, 1), "drums": 0.2 * clicks(120, 8, rate, 2), "vocals": clicks(77, 9, rate, 3)}, 2: {"drums": clicks(93, 14, rate, 4)}, 3: {"vocals": clicks(70, 6.3, rate, 5)}}
    rows = [(s, name, i, float(v)) for s, stems in songs.items() for name, x in stems.items() for i, v in enumerate(x)]
    stems = spark.createDataFrame(rows, "song bigint, stem string, i bigint, x double")
    got = W.beats_from_stems(stems, stems.where("song = 3").select("song", "i", "x"), rate, block=5000).collect()
    low = {1: songs[1]["Bass"] + np.pad(songs[1]["drums"], (0, rate)), 2: songs[2]["drums"], 3: songs[3]["vocals"]}
    labels = {1: "Bass + Drums", 2: "Drums", 3: "Full mix"}
    for s, x in low.items():
        bpm = W.tempo_of_audio(x, rate)[0]
        own = sorted((r["beat_idx"], r["t"], r["downbeat"], r["source"]) for r in got if r["track_id"] == s)
        want = [k * 60 / bpm for k in range(int((max(10.0, len(x) / rate) + 2.0) * bpm / 60) + 1)]
        assert [k for k, *_ in own] == list(range(len(want))) and np.allclose([t for _, t, _, _ in own], want)
        assert all(d == (k % 4 == 0) and label == labels[s] for k, _, d, label in own)


def test_sources_agree_at_their_metric_level(spark):
    """The drums are heard at half time and corrected before tempos are compared; short grids without tempo stay."""
    beats = [(1, "combined", 0.5 * k) for k in range(32)] + [(1, "drums", 1.0 * k) for k in range(16)] + [(1, "bass", 1.0 * k) for k in range(16)] + [(2, "combined", 3.0)]
    downs = [(1, s, 2.0 * k) for s in ("combined", "drums", "bass") for k in range(8)]
    facts, grid = W.agreed_beats(spark.createDataFrame(beats, "track_id bigint, source string, t double"), spark.createDataFrame(downs, "track_id bigint, source string, t double"))
    rows = {r["track_id"]: r for r in facts.collect()}
    assert (rows[1]["bpm"], rows[1]["beats_per_bar"], rows[1]["sources"], rows[1]["confidence"]) == (120.0, 4, 3, 1.0)
    assert [(r["kind"], r["t"]) for r in grid.where("track_id = 2").collect()] == [("beat", 3.0)] and rows[2]["bpm"] == 120.0

"""Beat tracking made whole: beats from audio, agreement of sources, metric level, and bars without gaps."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .beats import double_beats, downbeat_consensus, grid_from_bpm, halve_beats
from .spectral import in_tiles, laid
from .tempo import BIN, HIGH_BPM, LOW_BPM, SUBDIVISIONS, TOLERANCE
from .folds import fold_tracks
from .timejoin import by_sort

GRID = "track_id bigint, kind string, idx int, t double"


def moving_average(signal: DataFrame, k: int) -> DataFrame:
    """The mean of the last k samples; the divisor is k from the first sample on."""
    w = Window.partitionBy("track_id").orderBy("i").rowsBetween(-(k - 1), 0)
    return signal.select("track_id", "i", (F.sum("x").over(w) / k).alias("x"))


def low_stems(stems: DataFrame, mix: DataFrame) -> DataFrame:
    """(song, i, x): bass and drums summed to the longer, or the one there is, or the mix of songs that have neither.

    stems: (song, stem, i, x); mix: (song, i, x). Songs with none of them have no rows."""
    low = stems.where(F.lower("stem").isin("bass", "drums")).groupBy("song", "i").agg(F.sum("x").alias("x"))
    return low.unionByName(mix.join(low.select("song").distinct(), "song", "left_anti").select("song", "i", "x"))


def _pace(rate: int) -> tuple[int, int, int, int, int]:
    """How audio is thinned: every so many samples, samples a second then, those of 30 ms, and the shortest and longest beat."""
    thin = max(1, rate // 2205)
    pace = rate // thin
    return thin, pace, max(1, int(pace * 0.030)), round(60 / HIGH_BPM * pace), round(60 / LOW_BPM * pace)


def _rises(x: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """Rises of the mean over width places: what enters it less what leaves it, where that is more. before: the width places
    ahead of x, zeros at a track's start."""
    return np.maximum(x - np.concatenate([before, x])[: len(x)], 0.0) / width


def _settled(best: int, top: float, pace: int, onsets: np.ndarray, share: float) -> tuple[float, float]:
    """Tempo and confidence of the best lag; half or double tempo where the onsets fit it better."""
    bpm = min(HIGH_BPM, max(LOW_BPM, 60.0 * pace / best))
    if len(onsets) >= 3:
        bins = np.floor(onsets / BIN + 0.5).astype(int)
        marked = np.unique(bins)

        def credit(tempo: float) -> float:
            want = bins + int(60.0 / tempo / BIN + 0.5)
            k = np.searchsorted(marked, want)
            gap = np.minimum(np.abs(marked[np.minimum(k, len(marked) - 1)] - want), np.abs(want - marked[np.maximum(k - 1, 0)]))
            return float(np.where(gap <= 2, 1 - gap / 3.0, 0.0).sum())

        def fit(tempo: float) -> float:
            beats = onsets * tempo / 60.0
            err = np.min([np.abs(beats - np.floor(beats / s + 0.5) * s) for s in SUBDIVISIONS], axis=0)
            return float(np.where(err <= TOLERANCE, 1 - err / TOLERANCE, 0.0).mean())

        chosen, fitted, score = bpm, fit(bpm), top
        for other in (bpm / 2, bpm * 2):
            if LOW_BPM <= other <= HIGH_BPM and credit(other) >= share * top and fit(other) > fitted:
                chosen, fitted, score = other, fit(other), credit(other)
        bpm, top = chosen, score
    return bpm, min(1.0, top * 10)


def tempo_of_audio(samples: np.ndarray, rate: int, share: float = 0.7) -> tuple[float, float, np.ndarray] | None:
    """(tempo, confidence, onset times) of mono samples, or None under a second or without a pulse.

    Samples are thinned to about 2205 a second, cut at 0 and averaged over 30 ms; rises of that envelope are correlated with
    themselves, as the mean over pairs that both rise. Half or double tempo is taken where the rises fit it better."""
    if len(samples) < rate:
        return None
    thin, pace, width, shortest, longest = _pace(rate)
    x = np.maximum(np.asarray(samples, np.float64)[::thin], 0.0)
    rise = _rises(x, np.zeros(width), width)
    rise[0] = 0.0
    longest = min(longest, len(rise) // 2)
    if shortest >= longest or longest < 2:
        return None
    best, top = shortest, 0.0
    for lag in range(shortest, longest + 1):
        both = rise[:-lag] * rise[lag:]
        n = np.count_nonzero(both)
        if n and both.sum() / n > top:
            best, top = lag, both.sum() / n
    if top <= 0:
        return None
    onsets = np.flatnonzero((rise > 0.3 * rise.max()) & (rise > np.concatenate([[0.0], rise[:-1]]))) / pace
    return *_settled(best, top, pace, onsets, share), onsets


class BeatModel(Protocol):
    """What finds beats and downbeats (seconds) in mono samples."""

    def beats(self, samples: np.ndarray, rate: int) -> tuple[list[float], list[float]]: ...


class PulseModel:
    """The stand-in: an even grid at the audio's tempo through its first strong onset, every fourth beat a downbeat."""

    def __init__(self, bpb: int = 4):
        self.bpb = bpb

    def beats(self, samples: np.ndarray, rate: int) -> tuple[list[float], list[float]]:
        found = tempo_of_audio(samples, rate)
        if found is None:
            return [], []
        beat = 60.0 / found[0]
        start = float(found[2][0]) % beat if len(found[2]) else 0.0
        n = int((len(samples) / rate - start) / beat) + 1
        grid = [start + k * beat for k in range(n)]
        return grid, grid[:: self.bpb]


def _whole_tracks(blocks: DataFrame, run, schema: str) -> DataFrame:
    """run(track_id, samples) by track over (track_id, block_no, samples): one track's audio is one group."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        samples = np.concatenate([np.asarray(x, np.float64) for x in rows["samples"]])
        return pd.DataFrame(run(rows["track_id"].iloc[0], samples), columns=names)

    return blocks.select("track_id", "block_no", "samples").groupBy("track_id").applyInPandas(fold, schema)


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """(track_id, start_frame, samples) of blocks (track_id, block_no, samples): places come from the blocks' sizes alone."""
    before = Window.partitionBy("track_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("track_id", "block_no", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)).cast("long").alias("start_frame"))
    return blocks.select("track_id", "block_no", "samples").join(starts, ["track_id", "block_no"]).select("track_id", "start_frame", "samples")


def audio_pulse(blocks: DataFrame, rate: int, share: float = 0.7, tile: int = 1 << 15) -> DataFrame:
    """track_id, seconds, bpm, confidence, first_onset of tracks of mono blocks, as tempo_of_audio finds them; no row for a track without
    a pulse.

    Blocks are thinned where they lie. Tiles of thinned places, with 30 ms before and the longest beat behind them, give sums for
    each lag and the places that rise most; sums meet by track and lag, and one group a track settles its onsets alone."""
    import pandas as pd

    thin, pace, width, shortest, longest = _pace(rate)
    placed = placed_blocks(blocks)

    def thinned(batches):
        for b in batches:
            firsts = [-s % thin for s in b["start_frame"]]
            yield pd.DataFrame({"track_id": b["track_id"], "start_frame": [(s + f) // thin for s, f in zip(b["start_frame"], firsts)], "samples": [np.maximum(np.asarray(x, float)[f::thin], 0.0) for x, f in zip(b["samples"], firsts)]})

    few = placed.mapInPandas(thinned, "track_id bigint, start_frame bigint, samples array<double>")

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["tile"].iloc[0])
        low = number * tile
        x, end = laid(rows, low - width - 1, low + tile + longest)
        rise = _rises(x[width:], x[:width], width)  # from the place before the tile on
        rise[max(0, end - low + 1) :] = 0.0  # behind the track's end
        if number == 0:
            rise[:2] = 0.0
        own, lags = rise[1 : tile + 1], np.arange(shortest, longest + 1)
        sums, counts = np.zeros(len(lags)), np.zeros(len(lags), np.int64)
        for n, lag in enumerate(lags):
            both = own * rise[1 + lag : 1 + lag + tile]
            sums[n], counts[n] = both.sum(), np.count_nonzero(both)
        peaks = np.flatnonzero((own > 0.3 * own.max()) & (own > rise[:tile]))  # 0.3 of the track's most is no less
        return pd.DataFrame({"track_id": [rows["track_id"].iloc[0]], "most": [own.max()], "sums": [sums], "counts": [counts], "places": [peaks + low], "heights": [own[peaks]]})

    parts = in_tiles(few, tile, width + 1, tile + longest - 1).groupBy("track_id", "tile").applyInPandas(correlate, "track_id bigint, most double, sums array<double>, counts array<bigint>, places array<bigint>, heights array<double>")
    size = placed.groupBy("track_id").agg(F.max(F.col("start_frame") + F.size("samples")).alias("n"))
    lags = parts.select("track_id", F.posexplode(F.arrays_zip("sums", "counts")).alias("k", "z")).groupBy("track_id", "k").agg(F.sum("z.sums").alias("s"), F.sum("z.counts").alias("c"))
    reach = F.least(F.lit(longest), F.floor(F.ceil(F.col("n") / thin) / 2))
    lag = F.col("k") + shortest
    able = lags.join(size, "track_id").where((F.col("n") >= rate) & (reach > shortest) & (reach >= 2) & (lag <= reach) & (F.col("s") > 0))
    best = able.groupBy("track_id", "n").agg(F.max(F.struct((F.col("s") / F.col("c")).alias("top"), (-lag).alias("lag"))).alias("b")).select("track_id", "n", "b.top", (-F.col("b.lag")).alias("lag"))
    most = parts.groupBy("track_id").agg(F.max("most").alias("most"))
    onsets = parts.select("track_id", F.explode(F.arrays_zip("places", "heights")).alias("z")).join(most, "track_id").where(F.col("z.heights") > 0.3 * F.col("most")).groupBy("track_id").agg(F.array_sort(F.collect_list("z.places")).alias("places"))

    def settle(batches):
        for b in batches:
            rows = []
            for track, n, top, k, places in zip(b["track_id"], b["n"], b["top"], b["lag"], b["places"], strict=True):
                at = np.asarray(places if places is not None else [], float) / pace
                rows.append((track, n / rate, *_settled(int(k), top, pace, at, share), float(at[0]) if len(at) else None))
            yield pd.DataFrame(rows, columns=["track_id", "seconds", "bpm", "confidence", "first_onset"])

    return best.join(onsets, "track_id", "left").mapInPandas(settle, "track_id bigint, seconds double, bpm double, confidence double, first_onset double")


def bpm_from_audio(blocks: DataFrame, rate: int, **options) -> DataFrame:
    """track_id, bpm, beat_duration_sec, confidence of blocks of mono samples; no row for a track without a pulse."""
    return audio_pulse(blocks, rate, **options).select("track_id", "bpm", (60.0 / F.col("bpm")).alias("beat_duration_sec"), "confidence")


def beats_from_stems(stems: DataFrame, mix: DataFrame, rate: int, block: int = 65_536) -> DataFrame:
    """(track_id, beat_idx, t, downbeat, source): an even grid at the tempo of each song's bass and drums, or of what there is of
    them, or of the mix; no rows for a song without a pulse. stems: (song, stem, i, x); mix: (song, i, x)."""
    low = low_stems(stems, mix)
    cut = low.groupBy(F.col("song").alias("track_id"), F.floor(F.col("i") / block).cast("int").alias("block_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("samples"))
    has = lambda name: F.max(F.when(F.lower("stem") == name, 1).otherwise(0)) == 1
    label = stems.groupBy(F.col("song").alias("track_id")).agg(F.when(has("bass") & has("drums"), "Bass + Drums").when(has("bass"), "Bass").when(has("drums"), "Drums").otherwise("Full mix").alias("source"))
    grid = grid_from_bpm(audio_pulse(cut, rate).select("track_id", "bpm", F.col("seconds").alias("duration")))
    return grid.join(label, "track_id", "left").withColumn("source", F.coalesce("source", F.lit("Full mix")))


def pulse_beats(blocks: DataFrame, rate: int, bpb: int = 4, **options) -> DataFrame:
    """PulseModel's beats and downbeats of each track, (track_id, kind, idx, t), without bringing a track together."""
    beat = 60.0 / F.col("bpm")
    start = F.coalesce(F.col("first_onset") % beat, F.lit(0.0))
    count = F.floor((F.col("seconds") - start) / beat).cast("int") + 1
    grid = audio_pulse(blocks, rate, **options).select("track_id", start.alias("start"), beat.alias("beat"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    rows = grid.select("track_id", "k", (F.col("start") + F.col("k") * F.col("beat")).alias("t"))
    beats = rows.select("track_id", F.lit("beat").alias("kind"), F.col("k").alias("idx"), "t")
    return beats.unionByName(rows.where(F.col("k") % bpb == 0).select("track_id", F.lit("downbeat").alias("kind"), F.floor(F.col("k") / bpb).cast("int").alias("idx"), "t"))


def track_beats(blocks: DataFrame, model: BeatModel, rate: int) -> DataFrame:
    """Beats and downbeats of each track by a model: (track_id, kind, idx, t)."""

    def run(track_id, samples):
        beats, downbeats = model.beats(samples, rate)
        return [(track_id, kind, i, t) for kind, ts in (("beat", beats), ("downbeat", downbeats)) for i, t in enumerate(ts)]

    return _whole_tracks(blocks, run, GRID)


def metric_level(beats: DataFrame, downbeats: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """double, halve or keep for each track with four beats: by beats of the median bar and tempo, or by tempo without downbeats.

    Under 2.5 beats a bar below 70 BPM is half time, over 6 above 160 is double time; without two downbeats below 50 or above 200."""
    gaps = lambda rows, by: rows.withColumn("g", F.lead("t").over(Window.partitionBy(*keys).orderBy(by)) - F.col("t")).where("g > 0.001")
    beat = gaps(beats, "beat_idx").groupBy(*keys).agg(F.median("g").alias("beat"), F.count("*").alias("gaps"))
    bar = gaps(downbeats, "db_idx").groupBy(*keys).agg(F.median("g").alias("bar"))
    facts = beat.join(bar, list(keys), "left").where("gaps >= 3").withColumn("bpm", 60.0 / F.col("beat")).withColumn("per", F.round(F.col("bar") / F.col("beat")))
    free = F.when(F.col("bpm") < 50, "double").when(F.col("bpm") > 200, "halve").otherwise("keep")
    held = F.when((F.col("per") < 2.5) & (F.col("bpm") < 70), "double").when((F.col("per") > 6) & (F.col("bpm") > 160), "halve").otherwise("keep")
    return facts.select(*keys, "bpm", F.when(F.col("per").isNull(), free).otherwise(held).alias("level"))


def with_metric_level(beats: DataFrame, downbeats: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The beats at their track's metric level: midpoints added, every second one taken, or as they are."""
    level = metric_level(beats, downbeats, keys).select(*keys, "level")
    rows = beats.join(by_sort(level), list(keys), "left").select(*keys, "beat_idx", "t", F.coalesce("level", F.lit("keep")).alias("level"))
    of = lambda name: rows.where(F.col("level") == name).select(*keys, "beat_idx", "t")
    return double_beats(of("double"), keys).unionByName(halve_beats(of("halve"), keys)).unionByName(of("keep"))


def _apart(values: list[float], least: float) -> list[float]:
    """Sorted values, each at least least after the last one kept."""
    out: list[float] = []
    for x in sorted(values):
        if not out or x - out[-1] >= least:
            out.append(x)
    return out


def whole_bars(beats: list[float], downbeats: list[float], bpb: int) -> tuple[list[float], list[float]]:
    """Beats and downbeats with gaps of over one and a half bars filled by even bars and their beats.

    A first downbeat over half a bar late gets one at 0, and beats up to it. Marks within 0.3 of the (upper) median beat of
    another are one."""
    gaps = sorted(b - a for a, b in zip(beats, beats[1:]) if b - a > 0.001)
    if len(downbeats) < 2 or len(beats) < 4 or not gaps:
        return beats, downbeats
    beat = gaps[len(gaps) // 2]
    bar, near, grid = bpb * beat, 0.3 * beat, list(beats)
    close = lambda t: any(abs(x - t) < near for x in grid)
    marks = [0.0] if downbeats[0] > bar / 2 else []
    for here, then in zip(downbeats, [*downbeats[1:], None]):
        marks.append(here)
        if then is None or then - here <= 1.5 * bar:
            continue
        t = here + bar
        while t + beat < then:
            marks.append(t)
            grid += [u for k in range(1, bpb) if (u := t + k * beat) < then and not close(u)]
            t += bar
    marks = _apart(marks, near)
    if len(marks) >= 2 and marks[0] < 0.001:
        t = beat
        while t < marks[1] - near:
            if not close(t):
                grid.append(t)
            t += beat
    return _apart(grid, near), marks


def agreed_beats(beats: DataFrame, downbeats: DataFrame, primary: str = "combined", tolerance: float = 0.070) -> tuple[DataFrame, DataFrame]:
    """(track_id, bpm, beats_per_bar, confidence, sources) and the finished grid (track_id, kind, idx, t).

    beats, downbeats: (track_id, source, t). Each source's beats come to their metric level first. The tempo is the median of the
    sources' (120 without any), beats a bar follow from the median bar, and confidence from how many sources have each primary
    downbeat. The primary's grid is made whole, or one at the tempo where it has under four beats and some source has a tempo;
    that is a fold, by track."""
    sourced = lambda rows, idx: rows.select("track_id", "source", (F.row_number().over(Window.partitionBy("track_id", "source").orderBy("t")) - 1).cast("int").alias(idx), "t")
    beats = with_metric_level(sourced(beats, "beat_idx"), sourced(downbeats, "db_idx"), ("track_id", "source")).select("track_id", "source", "t")
    w = Window.partitionBy("track_id", "source").orderBy("t")
    gaps = beats.withColumn("g", F.lead("t").over(w) - F.col("t")).groupBy("track_id", "source").agg(F.median("g").alias("g"))
    sources = gaps.groupBy("track_id").agg(F.count("*").alias("sources"), F.median(F.when(F.col("g") > 0.001, 60.0 / F.col("g"))).alias("bpm"))  # one plan: levels are costly
    own = downbeats.where(F.col("source") == primary).select("track_id", "t", (F.row_number().over(Window.partitionBy("track_id").orderBy("t")) - 1).cast("int").alias("db_idx"))
    hits = downbeat_consensus(own, downbeats.where(F.col("source") != primary), tolerance).groupBy("track_id").agg(F.avg(1 + F.col("hits")).alias("hits"))
    bars = own.withColumn("g", F.lead("t").over(Window.partitionBy("track_id").orderBy("t")) - F.col("t")).groupBy("track_id").agg(F.median("g").alias("bar"))
    bpm = F.coalesce("bpm", F.lit(120.0))
    per = F.coalesce(F.greatest(F.lit(2), F.least(F.lit(8), F.round(F.col("bar") * F.greatest(bpm, F.lit(1.0)) / 60.0))), F.lit(4)).cast("int")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("hits", F.lit(1.0)) - 1) / F.greatest(F.col("sources") - 1, F.lit(1))))
    known = sources.join(hits, "track_id", "left").join(bars, "track_id", "left").select("track_id", bpm.alias("bpm"), per.alias("beats_per_bar"), confidence.alias("confidence"), "sources", F.col("bpm").isNotNull().alias("paced"))
    facts = known.drop("paced")
    marks = beats.where(F.col("source") == primary).select("track_id", F.lit("beat").alias("kind"), "t").unionByName(downbeats.where(F.col("source") == primary).select("track_id", F.lit("downbeat").alias("kind"), "t"))
    rows = known.select("track_id", "bpm", "beats_per_bar", "paced").join(by_sort(marks), "track_id", "left")

    def fold(track, part: list[tuple]):
        bpm, bpb, paced = part[0][:3]
        grid, downs = (sorted(t for *_, kind, t in part if kind == k) for k in ("beat", "downbeat"))
        if len(grid) < 4 and paced:
            step, until = 60.0 / max(bpm, 1.0), (grid[-1] if grid else 30.0) + 2.0
            grid = _apart([*grid, *(k * step for k in range(int(until / step) + 1))], 0.001)
        grid, downs = whole_bars(grid, downs, bpb)
        return [(track, kind, i, t) for kind, ts in (("beat", grid), ("downbeat", downs)) for i, t in enumerate(ts)]

    return facts, fold_tracks(rows, fold, GRID)


def single_source(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(track_id, bpm, beats_per_bar, confidence, sources) of one tracker's result: within 40-260 BPM and 2-8 beats, confidence 0.5."""
    w = Window.partitionBy("track_id").orderBy("t")
    gap = lambda rows: rows.withColumn("g", F.lead("t").over(w) - F.col("t")).groupBy("track_id").agg(F.median("g").alias("g"))
    rows = gap(beats).join(gap(downbeats).withColumnRenamed("g", "bar"), "track_id", "left")
    return rows.select(
        "track_id", F.greatest(F.lit(40.0), F.least(F.lit(260.0), F.coalesce(60.0 / F.col("g"), F.lit(120.0)))).alias("bpm"),
        F.greatest(F.lit(2), F.least(F.lit(8), F.coalesce(F.round(F.col("bar") / F.col("g")), F.lit(4)))).cast("int").alias("beats_per_bar"), F.lit(0.5).alias("confidence"), F.lit(1).alias("sources"),
    )

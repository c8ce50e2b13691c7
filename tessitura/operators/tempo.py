"""Tempo and meter from note onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .beats import chain_dedup, chain_kept
from .folds import fold_tracks
from .timejoin import by_sort, interval_join

LOW_BPM, HIGH_BPM, BIN, TOLERANCE = 40, 200, 0.01, 0.07
# The subdivisions of a beat, and the candidate meters (numerator, denominator, prior).
SUBDIVISIONS = (1.0, 0.5, 0.25, 0.125, 1.0 / 3, 1.0 / 6, 1.0 / 12)
METERS = [(2, 4, 0.92), (3, 4, 0.94), (4, 4, 1.0), (6, 8, 0.90), (12, 8, 0.86)]


def onset_lists(notes: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Sorted onsets of each track, each more than the tolerance after the last one kept."""
    ok = notes.where(F.col("start_time").isNotNull() & ~F.isnan("start_time") & (F.col("start_time") >= 0))
    return chain_dedup(ok, "start_time", tolerance, "onsets")


def onset_bins(onsets: DataFrame) -> DataFrame:
    return onsets.select("track_id", F.explode("onsets").alias("t")).groupBy("track_id", F.round(F.col("t") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("m"))


def lag_scores(onsets: DataFrame, tolerance: int = 2) -> DataFrame:
    """track_id, lag (in bins), score: each onset's nearest onset within the tolerance of one lag later adds 1 - d / (tol + 1).

    Pairs of onsets are joined by the bucket of the largest lag, so a track's cost is its density, not its square; lags of
    40 to 200 BPM are at most 150 bins."""
    longest, shortest = round(60 / LOW_BPM / BIN), round(60 / HIGH_BPM / BIN)
    bins = onset_bins(onsets)
    size = longest + tolerance
    left = bins.withColumn("b", F.floor(F.col("bin") / size))
    right = bins.select("track_id", F.col("bin").alias("other"), F.floor(F.col("bin") / size).alias("ob"))
    near = left.select("track_id", "bin", "m", F.explode(F.array("b", F.col("b") + 1)).alias("ob")).join(by_sort(right), ["track_id", "ob"])
    gap = F.col("other") - F.col("bin")
    pairs = near.where(gap.between(shortest - tolerance, longest + tolerance)).select("track_id", "bin", "m", gap.alias("gap"))
    spread = pairs.select("track_id", "bin", "m", "gap", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("d")).select("track_id", "bin", "m", (F.col("gap") + F.col("d")).alias("lag"), F.abs("d").alias("d"))
    credit = spread.where(F.col("lag").between(shortest, longest)).groupBy("track_id", "bin", "m", "lag").agg(F.min("d").alias("d"))
    return credit.groupBy("track_id", "lag").agg(F.round(F.sum(F.col("m") * (1 - F.col("d") / (tolerance + 1.0))), 6).alias("score"))


def bpm_autocorrelation(notes: DataFrame) -> DataFrame:
    """The tempo of the best lag, the shortest of equals; at least three onsets."""
    onsets = onset_lists(notes).where(F.size("onsets") >= 3)
    best = lag_scores(onsets).groupBy("track_id").agg(F.max(F.struct("score", (-F.col("lag")).alias("l"))).alias("b"))
    n = onsets.select("track_id", F.size("onsets").alias("n"))
    return best.join(n, "track_id").select("track_id", (-F.col("b.l")).alias("lag"), F.col("b.score").alias("score"), (F.lit(60.0) / (-F.col("b.l") * BIN)).alias("bpm"), F.least(F.lit(1.0), F.col("b.score") / F.col("n")).alias("confidence"))


def subdivision_error(t: Column, beat: Column) -> Column:
    """Distance in beats from the nearest multiple of a subdivision."""
    x = t / beat
    return F.least(*(F.abs(x - F.round(x / s) * s) for s in SUBDIVISIONS))


def alignment(onsets: DataFrame, tempi: DataFrame) -> DataFrame:
    """The mean of 1 - error / tolerance over the onsets within the tolerance of a subdivision; tempi: (track_id, bpm)."""
    rows = onsets.select("track_id", F.explode("onsets").alias("t")).join(by_sort(tempi), "track_id")
    err = subdivision_error(F.col("t"), F.lit(60.0) / F.col("bpm"))
    return rows.groupBy("track_id", "bpm").agg(F.avg(F.when(err <= TOLERANCE, 1 - err / TOLERANCE).otherwise(0.0)).alias("alignment"))


def resolve_octave(notes: DataFrame, share: float = 0.7) -> DataFrame:
    """The best lag's tempo, or its half or double where that scores share of it at least and fits subdivisions better.

    Of equal fits the best lag's tempo stays, and half comes before double."""
    onsets = onset_lists(notes).where(F.size("onsets") >= 3)
    scores = lag_scores(onsets)
    first = scores.groupBy("track_id").agg(F.max(F.struct("score", (-F.col("lag")).alias("l"))).alias("b")).select("track_id", F.col("b.score").alias("top"), (-F.col("b.l")).alias("best"))
    bpm = F.lit(60.0) / (F.col("best") * BIN)
    option = lambda x: F.struct(x.alias("bpm"), F.round(F.lit(60.0) / x / BIN).cast("int").alias("lag"))
    options = first.select("track_id", "top", F.posexplode(F.array(option(bpm), option(bpm / 2), option(bpm * 2))).alias("rank", "o")).select("track_id", "top", "rank", "o.bpm", "o.lag")
    within = (F.col("rank") == 0) | ((F.col("bpm") >= LOW_BPM - 1e-9) & (F.col("bpm") <= HIGH_BPM + 1e-9) & (F.col("score") >= share * F.col("top")))
    held = options.where(F.col("bpm").between(LOW_BPM - 1e-9, HIGH_BPM + 1e-9)).join(scores, ["track_id", "lag"]).where(within)
    fits = alignment(onsets, held.select("track_id", "bpm").distinct())
    best = held.join(fits, ["track_id", "bpm"]).groupBy("track_id").agg(F.max_by(F.struct("bpm", "lag", "score"), F.struct(F.round("alignment", 9), -F.col("rank"))).alias("x"))
    n = onsets.select("track_id", F.size("onsets").alias("n"))
    return best.join(n, "track_id").select("track_id", "x.bpm", "x.lag", "x.score", F.least(F.lit(1.0), F.col("x.score") / F.col("n")).alias("confidence"))


def sliding_windows(notes: DataFrame, width: int = 8, step: int = 2, least: int = 5) -> DataFrame:
    """Notes and mean gap of each window of some seconds; a note lies in width / step windows."""
    first = F.floor(F.col("start_time") / step)
    spread = notes.withColumn("w", F.explode(F.sequence(first - (width // step - 1), first))).where("w >= 0").withColumn("window_start", (F.col("w") * step).cast("double"))
    facts = spread.groupBy("track_id", "window_start").agg(F.count("*").alias("n"), F.min("start_time").alias("a"), F.max("start_time").alias("b"))
    return facts.where(F.col("n") >= least).select("track_id", "window_start", "n", ((F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("mean_gap"))


def tempo_of(starts: list[float], share: float = 0.7) -> float | None:
    """What resolve_octave() says of one short list of note starts, for windows inside a fold; None under three onsets."""
    return tempi_of([starts], share)[0]


def tempi_of(lists: list[list[float]], share: float = 0.7, onsets_each: int = 4096) -> list[float | None]:
    """tempo_of() of several lists, about onsets_each onsets at once: their bins lie apart on one line, so that one search finds all."""
    kept = [chain_kept(sorted(x for x in starts if x >= 0), 0.005) for starts in lists]
    out: list[float | None] = [None] * len(lists)
    live, n = [], 0
    for i, x in enumerate(kept):
        if len(x) >= 3 and x[-1] > 0:
            live.append(i)
            n += len(x)
        if live and (n >= onsets_each or i == len(kept) - 1):
            for k, bpm in zip(live, _tempi([kept[j] for j in live], share), strict=True):
                out[k] = bpm
            live, n = [], 0
    return out


def _tempi(lists: list[list[float]], share: float) -> list[float]:
    """The tempi of sorted lists of three onsets and more."""
    import numpy as np

    sizes = np.array([len(x) for x in lists])
    of, ends = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes)
    first = ends - sizes
    onsets = np.concatenate([np.asarray(x, float) for x in lists])
    bins = np.floor(onsets / BIN + 0.5).astype(int)
    lags = np.arange(round(60 / HIGH_BPM / BIN), round(60 / LOW_BPM / BIN) + 1)
    room = bins[ends - 1] + 4 * lags[-1]  # no lag reaches from one list to another
    bins = bins + np.repeat(np.cumsum(room) - room, sizes)
    marked = np.unique(bins)
    parts = list(zip(first.tolist(), ends.tolist(), strict=True))

    def credit(lags: np.ndarray) -> np.ndarray:
        want = bins[:, None] + lags
        at = np.searchsorted(marked, want)
        gap = np.minimum(np.abs(marked[np.minimum(at, len(marked) - 1)] - want), np.abs(want - marked[np.maximum(at - 1, 0)]))
        return np.where(gap <= 2, 1 - gap / 3.0, 0.0)

    def fits(bpm: np.ndarray) -> np.ndarray:
        x = onsets * bpm[of] / 60.0
        err = np.min([np.abs(x - np.floor(x / s + 0.5) * s) for s in SUBDIVISIONS], axis=0)
        near = np.where(err <= TOLERANCE, 1 - err / TOLERANCE, 0.0)
        return np.array([round(float(near[a:z].mean()), 9) for a, z in parts])

    scores = np.round(np.add.reduceat(credit(lags[None, :]), first, axis=0), 6)
    best = scores.argmax(1)
    bpm, top = 60.0 / (lags[best] * BIN), scores[np.arange(len(lists)), best]
    chosen, fitted = bpm.copy(), fits(bpm)
    for other in (bpm / 2, bpm * 2):
        within = (LOW_BPM - 1e-9 <= other) & (other <= HIGH_BPM + 1e-9)
        lag = np.floor(60.0 / other / BIN + 0.5).astype(int)
        held = credit(np.where(within, lag, 0)[of][:, None])
        score, fit = np.array([held[a:z].sum(0)[0] for a, z in parts]), fits(other)
        better = within & (score >= share * top) & (fit > fitted)
        chosen, fitted = np.where(better, other, chosen), np.where(better, fit, fitted)
    return chosen.tolist()


def window_tempi(starts: list[float], duration: float, whole: float, window: float = 8.0, step: float = 2.0, least: int = 5) -> list[tuple[float, float]]:
    """(start, tempo) of windows from 0 to the end of a track; the whole track's tempo where a window has too few notes."""
    import bisect

    starts, out, t = sorted(starts), [], 0.0
    while t <= duration:
        out.append((t, starts[bisect.bisect_left(starts, t) : bisect.bisect_left(starts, min(t + window, duration + 0.001))]))
        t += step
    found = iter(tempi_of([inside for _, inside in out if len(inside) >= least]))
    return [(t, (next(found) or whole) if len(inside) >= least else whole) for t, inside in out]


def segments_of(samples: list[tuple[float, float]], duration: float, change: float = 0.12, least_sec: float = 4.0) -> list[tuple[float, float, float, float, float]]:
    """(start, end, bpm, beat seconds, first beat) of the stretches of about one tempo; samples: (start, bpm).

    Samples are smoothed by a median of three that uses its own left result; a new stretch begins where the tempo changes and
    the last one is long enough, otherwise the tempo moves a quarter of the way. A short last stretch takes the mean of its
    own and the tempo before."""
    bpm = [x for _, x in samples]
    for i in range(1, len(bpm) - 1):
        bpm[i] = sorted(bpm[i - 1 : i + 2])[1]
    clamp = lambda x: min(260.0, max(40.0, x))
    begun, tempo, found = 0.0, bpm[0], []
    for (t, _), x in zip(samples[1:], bpm[1:], strict=True):
        if abs(x - tempo) / max(tempo, 1.0) >= change and t - begun >= least_sec:
            found.append([begun, t, clamp(tempo)])
            begun, tempo = t, x
        else:
            tempo = 0.75 * tempo + 0.25 * x
    found.append([begun, max(duration, begun + 0.001), clamp(tempo)])
    for i in range(1, len(found)):
        if found[i][1] - found[i][0] < least_sec:
            found[i][2] = (found[i][2] + found[i - 1][2]) / 2
    out, offset = [], 0.0
    for a, b, x in found:
        out.append((a, b, x, 60.0 / x, offset))
        offset += (b - a) * x / 60.0
    return out


def tempo_segments(notes: DataFrame) -> DataFrame:
    """The tempo map of each track from its windows' tempi; tracks without a tempo have none. A fold by track."""

    def fold(track, rows: list[tuple]):
        rows = [r for r in rows if r[0] is not None and r[0] == r[0]]
        starts = [r[0] for r in rows]
        whole = tempo_of(starts)
        if whole is None:
            return []
        duration = max(0.01, *starts, *(e for _, e in rows if e is not None and e == e))
        return [(track, n, *s) for n, s in enumerate(segments_of(window_tempi(starts, duration, whole), duration))]

    return fold_tracks(notes.select("track_id", "start_time", "end_time"), fold, "track_id bigint, seg_no int, start_time_sec double, end_time_sec double, bpm double, beat_duration_sec double, beat_offset double")


def meter_scores(notes: DataFrame, segments: DataFrame, emphasis: float = 1.35) -> DataFrame:
    """Score of each candidate meter in each tempo segment: how far the weight on the best downbeat lies over the others' mean.

    A note's weight is its velocity and how near it lies to a beat of the bar; of all rotations the heaviest beat's is best."""
    rows = [(n, d, prior, i) for i, (n, d, prior) in enumerate(METERS)]
    meters = F.broadcast(notes.sparkSession.createDataFrame(rows, "numerator int, denominator int, prior double, rank int"))
    spans = segments.select("track_id", "seg_no", "start_time_sec", "end_time_sec", "beat_duration_sec")
    inside = interval_join(notes.select("track_id", "start_time", "velocity"), spans, "start_time", "start_time_sec", "end_time_sec", 8.0)
    beat = (F.col("start_time") - F.col("start_time_sec")) / F.col("beat_duration_sec")
    phase = F.pmod(F.col("beat"), F.col("numerator").cast("double"))
    bin_ = F.pmod(F.round("phase").cast("int"), F.col("numerator"))
    clamp = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    weight = clamp(F.col("velocity") / 127.0, 0.2) * clamp(1 - 0.7 * F.abs(F.col("phase") - F.col("bin")), 0.15)
    placed = inside.withColumn("beat", beat).crossJoin(meters).withColumn("phase", phase).withColumn("bin", bin_).withColumn("w", weight)
    keys = ["track_id", "seg_no", "numerator", "denominator", "prior", "rank"]
    best = placed.groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.count("*").alias("n")).groupBy(*keys).agg(F.max("w").alias("top"), F.sum("w").alias("total"), F.sum("n").alias("n"))
    n = F.col("numerator")
    raw = (F.col("top") * emphasis - (F.col("total") - F.col("top")) / (n - 1) + F.col("total") / n) / F.greatest(F.col("total"), F.lit(1.0))
    return best.select("track_id", "seg_no", "numerator", "denominator", "rank", "n", (F.when(F.col("total") > 1e-5, raw).otherwise(0.0) + F.col("prior")).alias("score"))


def infer_meter(notes: DataFrame, segments: DataFrame, least: int = 8) -> DataFrame:
    """The best meter of each tempo segment, the first of equals, with its beats and a confidence; equal neighbours become one.

    4/4 with confidence 0.2 where a segment has under eight notes."""
    best = meter_scores(notes, segments).groupBy("track_id", "seg_no").agg(F.max_by(F.struct("numerator", "denominator", "score", "n"), F.struct(F.round("score", 9), -F.col("rank"))).alias("x"))
    length = F.greatest(F.lit(0.0), F.col("end_time_sec") - F.col("start_time_sec")) / F.greatest(F.col("beat_duration_sec"), F.lit(0.001))
    rows = segments.join(best, ["track_id", "seg_no"], "left")
    known = F.coalesce(F.col("x.n"), F.lit(0)) >= least
    pick = lambda c, other: F.when(known, F.col(f"x.{c}")).otherwise(other)
    confidence = F.when(known, F.greatest(F.lit(0.05), F.least(F.lit(0.99), (F.col("x.score") - 0.2) / 3))).otherwise(0.2)
    found = rows.select("track_id", F.col("beat_offset").alias("start_beat"), (F.col("beat_offset") + length).alias("end_beat"), pick("numerator", 4).cast("int").alias("numerator"), pick("denominator", 4).cast("int").alias("denominator"), confidence.alias("confidence"))
    return merge_equal_neighbours(found)


def merge_equal_neighbours(signatures: DataFrame) -> DataFrame:
    """Neighbouring segments of one signature become one: last end, highest confidence."""
    w = Window.partitionBy("track_id").orderBy("start_beat")
    same = (F.lag("numerator").over(w) == F.col("numerator")) & (F.lag("denominator").over(w) == F.col("denominator"))
    rows = signatures.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("track_id", "grp").agg(F.min("start_beat").alias("start_beat"), F.max_by("end_beat", "start_beat").alias("end_beat"), F.first("numerator").alias("numerator"), F.first("denominator").alias("denominator"), F.max("confidence").alias("confidence")).drop("grp")


def rhythm_confidence(segments: DataFrame, signatures: DataFrame, estimate: DataFrame) -> DataFrame:
    """Mean of the signatures' confidence (0.5 if none) and (0.8 + stability) / 2, stability 1 - mean |bpm / estimate - 1|."""
    meter = signatures.groupBy("track_id").agg(F.avg("confidence").alias("meter"))
    steady = segments.select("track_id", F.col("bpm").alias("x")).join(estimate.select("track_id", "bpm"), "track_id").groupBy("track_id").agg((1 - F.avg(F.abs(F.col("x") / F.col("bpm") - 1))).alias("stability"))
    return steady.join(meter, "track_id", "left").select("track_id", ((F.coalesce("meter", F.lit(0.5)) + (0.8 + F.greatest(F.lit(0.0), "stability")) / 2) / 2).alias("confidence"))

"""Sequence decoding: binary Viterbi for each pitch and the joint tempo, meter and phase tracker."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Beats a bar of the five meter classes.
METER_BEATS = (2, 3, 4, 6, 12)
TEMPO_BINS = tuple(range(20, 81))


#: Log scores are whole numbers of this unit, so that sums don't depend on where a track is cut.
UNIT = 2.0**-32


def _evidence(probs: np.ndarray, scale: float) -> np.ndarray:
    """Log score of on less that of off, in units."""
    on, off = np.log(np.clip(probs * scale, 1e-10, 1)), np.log(np.clip((1 - probs) * scale, 1e-10, 1))
    return np.rint((on - off) / UNIT).astype("int64")


def _leads(evidence: np.ndarray, start: np.ndarray, cost: int) -> np.ndarray:
    """lead[t]: the best score of on at frame t - 1 less that of off; lead[0] is start. A step limits the lead to the cost of a
    switch and adds the evidence."""
    lead = np.empty((len(evidence) + 1, evidence.shape[1]), "int64")
    lead[0] = start
    for t, e in enumerate(evidence):
        lead[t + 1] = np.minimum(np.maximum(lead[t], -cost), cost) + e
    return lead


def _states(lead: np.ndarray, end: np.ndarray, cost: int) -> tuple[np.ndarray, np.ndarray]:
    """On or off at each frame, from the state at the last one back, and the state just before the first. A tie prefers on as
    predecessor."""
    out, state = np.zeros((len(lead) - 1, lead.shape[1]), bool), end
    for t in range(len(out) - 1, -1, -1):
        out[t] = state
        state = np.where(state, lead[t] >= -cost, lead[t] >= cost)
    return out, state


def binary_path(probs: np.ndarray, switch: float = 0.2, scale: float = 1.0, confidence: float = 0.6) -> np.ndarray:
    """On or off for each frame (rows) and pitch (columns); on only where the probability reaches the confidence too.

    A tie prefers state on as predecessor and off at the end."""
    if not len(probs):
        return np.zeros(probs.shape, bool)
    cost = round(switch / UNIT)
    lead = _leads(_evidence(probs, scale), np.zeros(probs.shape[1], "int64"), cost)
    return _states(lead, lead[-1] > 0, cost)[0] & (probs >= confidence)


def viterbi(frames: DataFrame, block: int = 1024, fan: int = 1024, switch: float = 0.2, scale: float = 1.0, confidence: float = 0.6) -> DataFrame:
    """(track_id, frame, pitch) of the active cells. frames: (track_id, frame, probs), pitch 21 being the first of probs.

    A track is cut into blocks of frames, each a task's group. What a block does to the lead of on over off, whatever it is
    before, is a limit and a sum (the max-plus product of its steps); what it does to the state on the way back is a table of two
    entries. Both are composed over the blocks of a track, in groups of fan and groups of groups, to what each block starts and
    ends with, and each block is then decoded on its own. The result is that of binary_path over the whole track."""
    cost, keys = round(switch / UNIT), ["track_id", "block"]
    number = F.floor(F.col("frame") / block).cast("long")
    first, last = frames.agg(F.min(number), F.max(number)).first()
    span, levels = (last or 0) - (first or 0), 1
    while fan**levels <= span:
        levels += 1
    cells = frames.select("track_id", "frame", "probs", (number - (first or 0)).alias("block"))
    grouped = cells.groupBy(*keys)

    def read(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        rows = rows.sort_values("frame")
        return rows, np.stack(rows["probs"].to_list()).astype(float)

    def key_of(rows: pd.DataFrame) -> tuple:
        return rows["track_id"].iloc[0], rows["block"].iloc[0]

    def one(track, number, **columns) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [track], "block": [number], **{c: [v.tolist()] for c, v in columns.items()}})

    def forward(rows: pd.DataFrame) -> pd.DataFrame:
        _, probs = read(rows)
        low, high, add = np.full(probs.shape[1], -(1 << 62)), np.full(probs.shape[1], 1 << 62), np.zeros(probs.shape[1], "int64")
        for e in _evidence(probs, scale):
            low, high, add = _then((low, high, add), (-cost, cost, e))
        return one(*key_of(rows), low=low, high=high, add=add)

    def backward(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        _, probs = read(rows)
        lead = _leads(_evidence(probs, scale), np.array(start["value"].iloc[0], "int64"), cost)
        tables = [_states(lead, np.full(probs.shape[1], end), cost)[1].astype("int64") for end in (False, True)]
        return one(*key_of(rows), if_off=tables[0], if_on=tables[1], last=(lead[-1] > 0).astype("int64"))

    def decode(rows: pd.DataFrame, start: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        rows, probs = read(rows)
        lead = _leads(_evidence(probs, scale), np.array(start, "int64"), cost)
        at, pitch = np.nonzero(_states(lead, np.array(end) > 0, cost)[0] & (probs >= confidence))
        return pd.DataFrame({"track_id": rows["track_id"].iloc[0], "frame": rows["frame"].to_numpy()[at].astype("int32"), "pitch": (pitch + 21).astype("int32")})

    steps = grouped.applyInPandas(forward, "track_id bigint, block bigint, low array<bigint>, high array<bigint>, add array<bigint>")
    starts = _carried(steps, ["low", "high", "add"], _then, lambda f, x: np.minimum(np.maximum(x, f[0]), f[1]) + f[2], lambda f: np.zeros_like(f[0]), fan, levels)
    maps = grouped.cogroup(starts.groupBy(*keys)).applyInPandas(backward, "track_id bigint, block bigint, if_off array<bigint>, if_on array<bigint>, last array<bigint>")
    # on the way back the last block comes first
    turned = maps.withColumn("block", F.lit(span) - F.col("block"))
    ends = _carried(turned, ["if_off", "if_on", "last"], _back_then, lambda f, x: np.where(x > 0, f[1], f[0]), lambda f: f[2], fan, levels).withColumn("block", F.lit(span) - F.col("block"))
    both = starts.join(ends.withColumnRenamed("value", "last_state"), keys)
    return grouped.cogroup(both.groupBy(*keys)).applyInPandas(lambda rows, known: decode(rows, known["value"].iloc[0], known["last_state"].iloc[0]), "track_id bigint, frame int, pitch int")


def _then(f: tuple, g: tuple) -> tuple:
    """What two steps do after another; a step (low, high, add) limits a value to low and high and then adds."""
    limit = lambda x: np.minimum(np.maximum(x + f[2], g[0]), g[1]) - f[2]
    return limit(np.maximum(f[0], -(1 << 61))), limit(np.minimum(f[1], 1 << 61)), f[2] + g[2]


def _back_then(f: tuple, g: tuple) -> tuple:
    """Two tables after another; the last state stays that of the first, as the way back begins there."""
    return np.where(f[0] > 0, g[1], g[0]), np.where(f[1] > 0, g[1], g[0]), f[2]


def _carried(steps: DataFrame, columns: list[str], then, apply, initial, fan: int, levels: int) -> DataFrame:
    """(track_id, block, value): what each block begins with, if the first one of a track begins with initial and each passes on
    what its step makes of its own.

    Blocks are numbered from 0 to below fan ** levels. Steps are composed in groups of fan blocks, level by level, until a track is one group; values go down the same way."""
    keyed = steps.withColumn("own", F.floor(F.col("block") / fan).cast("long"))
    kinds = ", ".join(f"{c} array<bigint>" for c in columns)

    def rows_of(part: pd.DataFrame):
        part = part.sort_values("block")
        return part, [tuple(np.array(x, "int64") for x in row) for row in part[columns].itertuples(index=False)]

    def total(part: pd.DataFrame) -> pd.DataFrame:
        part, found = rows_of(part)
        whole = found[0]
        for f in found[1:]:
            whole = then(whole, f)
        return pd.DataFrame({"track_id": [part["track_id"].iloc[0]], "block": [part["own"].iloc[0]], **{c: [v.tolist()] for c, v in zip(columns, whole)}})

    def values(part: pd.DataFrame, value) -> pd.DataFrame:
        part, found = rows_of(part)
        value, out = initial(found[0]) if value is None else np.array(value, "int64"), []
        for f in found:
            out.append(value.tolist())
            value = apply(f, value)
        return pd.DataFrame({"track_id": part["track_id"], "block": part["block"], "value": out})

    schema = "track_id bigint, block bigint, value array<bigint>"
    if levels <= 1:
        return keyed.groupBy("track_id", "own").applyInPandas(lambda part: values(part, None), schema)
    totals = keyed.groupBy("track_id", "own").applyInPandas(total, f"track_id bigint, block bigint, {kinds}")
    above = _carried(totals, columns, then, apply, initial, fan, levels - 1)
    return keyed.groupBy("track_id", "own").cogroup(above.withColumnRenamed("block", "own").groupBy("track_id", "own")).applyInPandas(lambda part, start: values(part, start["value"].iloc[0]), schema)


def rhythm_states(spark: SparkSession) -> DataFrame:
    """state_idx, tempo_bin, meter_class, phase: 61 tempo bins by 27 positions."""
    tempo = spark.range(TEMPO_BINS[0], TEMPO_BINS[-1] + 1).select(F.col("id").cast("int").alias("tempo_bin"))
    meter = spark.createDataFrame(list(enumerate(METER_BEATS)), "meter_class int, beats int").select("meter_class", F.explode(F.sequence(F.lit(0), F.col("beats") - 1)).alias("phase"))
    per = sum(METER_BEATS)
    before = F.element_at(F.array(*(F.lit(sum(METER_BEATS[:i])) for i in range(len(METER_BEATS)))), F.col("meter_class") + 1)
    rows = tempo.crossJoin(F.broadcast(meter))
    return rows.select(((F.col("tempo_bin") - TEMPO_BINS[0]) * per + before + F.col("phase")).cast("int").alias("state_idx"), "tempo_bin", "meter_class", F.col("phase").cast("int").alias("phase"))


def _joint_costs(tempo_cost: float, meter_cost: float, phase_cost: float) -> tuple[int, np.ndarray]:
    """In units: the cost of one tempo bin, and that of each move between positions, (old, new)."""
    meter = np.repeat(np.arange(len(METER_BEATS)), METER_BEATS)
    phase = np.concatenate([np.arange(b) for b in METER_BEATS])
    length = np.repeat(METER_BEATS, METER_BEATS)
    unit = lambda x: round(x / UNIT)
    step = phase[None, :] - phase[:, None]
    near = (step == 1) | ((phase[None, :] == 0) & (phase[:, None] == length[:, None] - 1)) | ((phase[:, None] == 0) & (phase[None, :] == length[None, :] - 1))
    return unit(tempo_cost), np.where(meter[:, None] != meter[None, :], unit(meter_cost), 0) + np.where(step == 0, 0, np.where(near, unit(phase_cost), unit(0.5)))


def joint_paths(observed, n: int, tempo_cost: float = 0.3, meter_cost: float = 1.5, phase_cost: float = 0.1, block: int = 256) -> np.ndarray:
    """The best states, (frames, tracks), of tracks of n frames each; observed(t) gives log scores (states, tracks) in units.

    The transition cost is a sum over tempo, meter and phase, so the maximum is taken one factor at a time: over tempo bins, as
    their cost is linear, by a running maximum from either side; over positions as the best of all and of the own meter at the
    full cost, or one of the few that cost less. What the best came from is looked up on the way back, for the path's states alone
    (the first position of equals, then the first tempo bin). Scores are kept for one block of frames, and for each block's first."""
    n_tempo, per = len(TEMPO_BINS), sum(METER_BEATS)
    bin_cost, position = _joint_costs(tempo_cost, meter_cost, phase_cost)
    first = np.concatenate([[0], np.cumsum(METER_BEATS)[:-1]])
    own = np.repeat(np.arange(len(METER_BEATS)), METER_BEATS)
    same = own[:, None] == own[None, :]
    full, full_own = position.max(), position[same].max()
    less = [np.flatnonzero(position[:, q] < np.where(same[:, q], full_own, full)) for q in range(per)]
    rounds = [np.array([ps[min(k, len(ps) - 1)] for ps in less]) for k in range(max(map(len, less)))]
    ramp = (bin_cost * np.arange(n_tempo))[:, None, None]
    apart = bin_cost * np.abs(np.arange(n_tempo)[:, None] - np.arange(n_tempo)[None, :])

    def advance(score: np.ndarray, t: int) -> np.ndarray:
        up = np.maximum.accumulate(score + ramp, axis=0) - ramp
        down = np.maximum.accumulate((score - ramp)[::-1], axis=0)[::-1] + ramp
        best = np.maximum(up, down)
        out = np.maximum(best.max(1, keepdims=True) - full, np.maximum.reduceat(best, first, axis=1)[:, own] - full_own)
        for ps in rounds:
            np.maximum(out, best[:, ps] - position[ps, np.arange(per)][None, :, None], out=out)
        out += observed(t).reshape(out.shape)
        return out - out.max((0, 1))  # so that long tracks don't overflow

    score = observed(0).reshape(n_tempo, per, -1) + (round(10.0 / UNIT) * np.isin(np.arange(per), first))[None, :, None]
    begins, kept = [], []
    for t in range(n):
        if t:
            score = advance(score, t)
        if t % block == 0:
            begins.append(score)
            kept = []
        kept.append(score)
    tracks = np.arange(score.shape[2])
    i, j = np.divmod(score.reshape(n_tempo * per, -1).argmax(0), per)
    out = np.zeros((n, len(tracks)), np.int32)
    for t in range(n - 1, -1, -1):
        out[t] = i * per + j
        if t:
            if t % block == 0:  # what lies before is made again
                kept = [begins[t // block - 1]]
                for u in range(t - block + 1, t):
                    kept.append(advance(kept[-1], u))
            was, cost = kept[(t - 1) % block], apart[:, i]
            j = ((was - cost[:, None, :]).max(0) - position[:, j]).argmax(0)
            i = (was[:, j, tracks] - cost).argmax(0)
    return out


def _units(scores: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(scores, -1e6, 1e6) / UNIT).astype("int64")


def joint_path(observations: np.ndarray, **costs: float) -> np.ndarray:
    """The best state of each frame: observations are (frames, states) log scores."""
    return joint_paths(lambda t: _units(observations[t])[:, None], len(observations), **costs)[:, 0]


def decode_joint(observations: DataFrame, together: int = 32) -> DataFrame:
    """(track_id, frame, state_idx) of the best path. observations: (track_id, frame, scores by state: ARRAY<DOUBLE>, or
    MAP<INT, DOUBLE> of those that are not 0).

    Tracks are dealt to tasks and come in order, so a task holds the scores of one track, or of together of equal length, which are
    decoded side by side."""
    import pyarrow as pa

    states = len(TEMPO_BINS) * sum(METER_BEATS)
    schema = pa.schema([("track_id", pa.int64()), ("frame", pa.int32()), ("state_idx", pa.int32())])

    def decoded(tracks: list[tuple]) -> pa.RecordBatch:
        n = len(tracks[0][1])

        def observed(t: int) -> np.ndarray:
            out = np.zeros((states, len(tracks)), "int64")
            for k, (_, _, rows) in enumerate(tracks):
                at, values = rows[t]
                out[at, k] = _units(values)
            return out

        found = joint_paths(observed, n)
        ids = [track for track, _, _ in tracks for _ in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([f for _, f, _ in tracks]), pa.int32()), pa.array(found.T.ravel(), pa.int32())], schema=schema)

    def rows_of(b: pa.RecordBatch):
        """(track_id, frame, where, values) of each row."""
        scores = b.column(2)
        sparse = pa.types.is_map(scores.type)
        offsets = scores.offsets.to_numpy()
        at, values = (scores.keys.to_numpy(), scores.items.to_numpy()) if sparse else (None, scores.values.to_numpy(zero_copy_only=False))
        for k, (track, frame) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            a, z = offsets[k], offsets[k + 1]
            yield track, frame, at[a:z] if sparse else slice(None), values[a:z]

    def run(batches):
        waiting: dict[int, list[tuple]] = {}  # by length
        now = None
        rows = (row for b in batches for row in rows_of(b))
        for track, frame, at, values in itertools.chain(rows, [(None, None, None, None)]):
            if now and (frame is None or track != now[0]):
                alike = waiting.setdefault(len(now[1]), [])
                alike.append(now)
                if len(alike) >= together or len(now[1]) * len(alike) >= 1 << 13 or sum(len(f) for xs in waiting.values() for _, f, _ in xs) >= 1 << 14:
                    yield from map(decoded, waiting.values())
                    waiting = {}
                now = None
            if frame is not None:
                now = now or (track, [], [])
                now[1].append(frame)
                now[2].append((at, values))
        yield from map(decoded, waiting.values())

    n = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = observations.select("track_id", F.col("frame").cast("int"), "scores").repartition(n, "track_id").sortWithinPartitions("track_id", "frame")
    return dealt.mapInArrow(run, "track_id bigint, frame int, state_idx int")


def path_downbeats(path: DataFrame, states: DataFrame) -> DataFrame:
    """Frames that enter phase 0."""
    w = Window.partitionBy("track_id").orderBy("frame")
    rows = path.join(F.broadcast(states), "state_idx").withColumn("was", F.lag("phase").over(w))
    return rows.where("phase = 0 and (was is null or was != 0)").select("track_id", "frame")


def path_segments(path: DataFrame, states: DataFrame, column: str, least: int = 4) -> DataFrame:
    """Runs of equal tempo_bin or meter_class: short ones are dropped, the last is kept."""
    w = Window.partitionBy("track_id").orderBy("frame")
    rows = path.join(F.broadcast(states), "state_idx").withColumn("new", F.when(F.col(column) == F.lag(column).over(w), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("track_id", "run").agg(F.first(column).alias(column), F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    last = F.max("run").over(Window.partitionBy("track_id"))
    return runs.withColumn("last", last).where((F.col("end_frame") - F.col("start_frame") >= least) | (F.col("run") == F.col("last"))).select("track_id", "start_frame", "end_frame", column)

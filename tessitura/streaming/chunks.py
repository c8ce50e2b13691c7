"""Streaming operators: chunk streams, late and early frames, debounce, ring buffers, running notes.

Each has a batch form over the same columns, so that a stream can be checked against it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE, EARLY, SEEK = 20_000, 10_000, 400_000  # microseconds


def timing_class(pts: Column, clock: Column) -> Column:
    """drop (over 20 ms late), show (up to 10 ms early), hold (earlier), seek (over 0.4 s apart)."""
    drift = pts - clock
    return F.when(F.abs(drift) > SEEK, "seek").when(drift < -LATE, "drop").when(drift <= EARLY, "show").otherwise("hold")


def timed_frames(frames: DataFrame, clock: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """(stream_id, frame, pts, clock, class) of frames met by the clock: each frame with the readings of its stream that arrive
    within half a second of it, classified by timing_class.

    frames: (stream_id, frame, ts, pts); clock: (stream_id, ts, clock); ts is when a row came, pts and clock are microseconds. On
    streams this is an interval join under watermarks: a reading or a frame later than delay meets nothing and is dropped, and
    state goes as time passes; the same call on tables gives the same rows."""
    f = frames.select("stream_id", "frame", F.col("ts").alias("came"), "pts").withWatermark("came", delay)
    c = clock.select(F.col("stream_id").alias("of"), F.col("ts").alias("read"), "clock").withWatermark("read", delay)
    near = (F.col("stream_id") == F.col("of")) & F.expr("read >= came - INTERVAL 500 MILLISECONDS AND read <= came + INTERVAL 500 MILLISECONDS")
    return f.join(c, near).select("stream_id", "frame", "pts", "clock", timing_class(F.col("pts"), F.col("clock")).alias("class"))


def rebuild_steps(rows, held: float, last: int | None, delta: float, every_us: int):
    """Event ids at which a rebuild is due among (us, event_id, size) in order, and the state after them."""
    due = []
    for us, event, size in rows:
        held += size
        if last is None or held >= delta or us - last >= every_us:
            due.append(event)
            held, last = 0.0, us
    return due, held, last


def rebuild_triggers(log: DataFrame, delta: float, every_us: int = 1_000_000) -> DataFrame:
    """Chunks at which a waveform is rebuilt: delta new samples since the last rebuild, or a second. One pass by user."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["us", "event_id"])[["us", "event_id", "size"]].itertuples(index=False)
        due, _, _ = rebuild_steps(rows, 0.0, None, delta, every_us)
        return pd.DataFrame({"user_id": [part["user_id"].iloc[0]] * len(due), "event_id": due})

    return log.select("user_id", "us", "event_id", "size").groupBy("user_id").applyInPandas(fold, "user_id bigint, event_id bigint")


def rebuild_stream(stream: DataFrame, delta: float, every_us: int = 1_000_000) -> DataFrame:
    """The same on a stream of (user_id, us, event_id, size): samples held and the last rebuild are the state of a user."""

    def update(key, batches, state: GroupState):
        held, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])[["us", "event_id", "size"]].itertuples(index=False)
        due, held, last = rebuild_steps(rows, held, last, delta, every_us)
        state.update((float(held), None if last is None else int(last)))
        yield pd.DataFrame({"user_id": [key[0]] * len(due), "event_id": due})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, event_id bigint", "held double, last bigint", "append", GroupStateTimeout.NoTimeout)


def debounce(edits: DataFrame, gap: str = "120 milliseconds", watermark: str | None = None) -> DataFrame:
    """The last edit of each burst: a session window by key; with a watermark it runs on a stream too.

    edits: (key, ts, value)."""
    rows = edits.withWatermark("ts", watermark) if watermark else edits
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "n")


def ring_tail(log: DataFrame, capacity: int) -> DataFrame:
    """What a ring buffer of some capacity holds at the end: the last entries of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= capacity).drop("rn")


def ring_buffer_stream(stream: DataFrame, capacity: int) -> DataFrame:
    """(key, values): each key's last capacity values after every batch that touches it, as state of that size.

    stream: (key BIGINT, seq BIGINT, value DOUBLE)."""

    def update(key, batches, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        fresh = pd.concat(list(batches)).sort_values("seq")["value"].tolist()
        held = (held + fresh)[-capacity:]
        state.update((held,))
        yield pd.DataFrame({"key": [key[0]], "values": [held]})

    return stream.groupBy("key").applyInPandasWithState(update, "key bigint, values array<double>", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def note_stream(frames: DataFrame, threshold: float, step_sec: float, delay: str = "1 second") -> DataFrame:
    """Notes of a stream of (track_id, pitch, ts, prob): active frames of a pitch no more than two steps apart are a note.

    The session closes when the watermark passes it; the same call on a batch gives the same notes."""
    on = frames.where(F.col("prob") >= threshold).withWatermark("ts", delay)
    gap = f"{int(2 * step_sec * 1e6)} microseconds"
    found = on.groupBy(F.session_window("ts", gap).alias("w"), "track_id", "pitch").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.max("prob").alias("peak"), F.count("*").alias("frames"))
    return found.select("track_id", "pitch", "start", "last", F.greatest(F.lit(1), F.least(F.lit(127), F.round(F.col("peak") * 127).cast("int"))).alias("velocity"), "frames")


def smooth_stream(frames: DataFrame, alpha: float) -> DataFrame:
    """Exponential smoothing of each pitch of a stream of (key, seq, prob): the level is the state."""

    def update(key, batches, state: GroupState):
        level, out = (state.get[0] if state.exists else 0.0), []
        for seq, p in pd.concat(list(batches)).sort_values("seq")[["seq", "prob"]].itertuples(index=False):
            level += alpha * (p - level)
            out.append((key[0], int(seq), level))
        state.update((level,))
        yield pd.DataFrame(out, columns=["key", "seq", "level"])

    return frames.groupBy("key").applyInPandasWithState(update, "key bigint, seq bigint, level double", "level double", "append", GroupStateTimeout.NoTimeout)


def decay_steps(rows, level: float, left: int, alpha: float, held: int):
    """Levels of (seq, probability) in order, and the state after them: a level stays at its peak for held frames, then falls."""
    out = []
    for seq, p in rows:
        if p >= level:
            left = held
        elif left > 0:
            left -= 1
            out.append((seq, level))
            continue
        level += alpha * (p - level)
        out.append((seq, level))
    return out, level, left


class HighlightProcessor(StatefulProcessor):
    """The level and what is left of its hold are the state of a pitch; after silence a timer takes them away."""

    def __init__(self, alpha: float, held: int, quiet_ms: int):
        self.alpha, self.held, self.quiet_ms = alpha, held, quiet_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("level", "level double, remaining int, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        level, left, timer = self.state.get() if self.state.exists() else (0.0, 0, None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        part, out = pd.concat(list(rows)).sort_values("seq"), []
        for seq, came, p in zip(part["seq"], part["ts"], part["prob"], strict=True):
            now = int(came.timestamp() * 1000)
            if timer is not None and now > timer:  # silence that no watermark has passed yet
                out.append((key[0], None, level, True))
                level, left = 0.0, 0
            steps, level, left = decay_steps([(seq, p)], level, left, self.alpha, self.held)
            out += [(key[0], int(n), float(x), False) for n, x in steps]
            timer = now + self.quiet_ms
        self.handle.registerTimer(timer)
        self.state.update((float(level), int(left), timer))
        yield pd.DataFrame(out, columns=["key", "seq", "level", "expired"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        level = self.state.get()[0] if self.state.exists() else 0.0
        self.state.clear()
        yield pd.DataFrame([(key[0], None, float(level), True)], columns=["key", "seq", "level", "expired"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def highlight_stream(frames: DataFrame, dt: float, tau: float = 0.05, hold: float = 0.0, quiet: str = "2 seconds", delay: str = "0 seconds") -> DataFrame:
    """(key, seq, level, expired): frames.highlight_decay on a stream of (key, seq, ts, prob), with hold. When a pitch has had no frame
    for quiet of event time its state is dropped, and a row says so (expired, seq null): as the watermark passes, or with the next
    frame, which starts from silence.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    alpha, held = min(1.0, max(0.02, 1 - math.exp(-dt / tau))), round(hold / dt)
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = frames.select("key", "seq", "ts", "prob").withWatermark("ts", delay).groupBy("key")
    return rows.transformWithStateInPandas(HighlightProcessor(alpha, held, quiet_ms), "key bigint, seq bigint, level double, expired boolean", "Append", "eventTime")


def ema(log: DataFrame, keep: float = 0.7, low: float = 0.02, high: float = 4.0) -> DataFrame:
    """The running rate of each user: keep of the old, the rest of the new, clamped; the first value starts it."""
    ordered = log.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "size"))).alias("xs"))
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    fold = F.aggregate("xs", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), clamp(x["size"] / 100)).otherwise(acc * keep + clamp(x["size"] / 100) * (1 - keep)))
    return ordered.select("user_id", fold.alias("rate"))

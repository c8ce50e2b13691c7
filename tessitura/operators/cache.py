"""Result cache as a table: variant keys, lookups with reasons, validation, session helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(samples: Column, rate: Column) -> Column:
    return F.sha2(F.concat_ws(",", rate.cast("string"), F.size(samples).cast("string"), F.to_json(samples)), 256)


def variant_key(*parameters: Column) -> Column:
    return F.xxhash64(*parameters)


def lookup(wanted: DataFrame, cached: DataFrame, drift: float = 0.02, seconds: float = 2.0) -> DataFrame:
    """Each wanted (content_hash, variant_key, duration) with hit or the reason for none; several entries give the nearest.

    A length may differ unless by more than 2 % and more than 2 s."""
    c = cached.groupBy("content_hash", "variant_key").agg(F.max_by("duration", "version").alias("cached_duration"))
    off = F.abs(F.col("duration") - F.col("cached_duration"))
    too_far = (off > drift * F.col("duration")) & (off > seconds)
    rows = wanted.join(c, ["content_hash", "variant_key"], "left")
    return rows.withColumn("result", F.when(F.col("cached_duration").isNull(), "missing").when(too_far, "stale").otherwise("hit"))


# The version of an entry, and the parameters that must be equal for one to serve.
VERSION = 4
SHARED = ("sample_rate", "quality", "speed", "pitch", "use_cqt", "preprocess")
REASONS = ("other_version", "other_parameters", "other_length", "invalid_timeline")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def entry_facts(cached: DataFrame, frames: int = 10_000_000, width: int = 88) -> DataFrame:
    """Entries with n_frames and fine (a step above 0, at most so many frames, each of width finite values) in place of their timeline:
    what a search joins, made where the entries lie."""
    fine = _finite(F.col("step_sec")) & (F.col("step_sec") > 0) & (F.size("timeline") <= frames) & F.forall("timeline", lambda f: (F.size(f) == width) & F.forall(f, _finite))
    return cached.withColumn("n_frames", F.size("timeline")).withColumn("fine", F.coalesce(fine, F.lit(False))).drop("timeline")


def judged(wanted: DataFrame, cached: DataFrame, drift: float = 0.02, seconds: float = 2.0, frames: int = 10_000_000, width: int = 88) -> DataFrame:
    """Each candidate entry of each wanted song with verdict: ok, or the first reason against it.

    wanted: (content_hash, n_samples, the shared parameters); cached: the same with version, step_sec, and timeline (an array of
    frames), or what entry_facts makes of it. Numbers are equal by value as they were stored; a length may differ unless by more
    than 2 % and more than 2 s. Timelines are judged before the join, and never move."""
    facts = entry_facts(cached, frames, width) if "timeline" in cached.columns else cached
    w, c = wanted.alias("w"), facts.alias("c")
    both = w.join(c, "content_hash")
    same = F.lit(True)
    for p in SHARED:
        same = same & F.col(f"w.{p}").eqNullSafe(F.col(f"c.{p}"))
    expected, held = F.col("w.n_samples") / F.col("w.sample_rate"), F.col("c.n_frames") * F.col("c.step_sec")
    off = F.abs(held - expected)
    far = (F.col("w.n_samples") > 0) & (F.col("w.n_samples") != F.col("c.n_samples")) & (off > drift * expected) & (off > seconds)
    unread = F.col("c.opened") if "opened" in facts.columns else F.lit("ok")
    verdict = F.when(unread != "ok", unread).when(F.col("c.version") != VERSION, REASONS[0]).when(~same, REASONS[1]).when(far, REASONS[2]).when(~F.col("c.fine"), REASONS[3]).otherwise("ok")
    return both.select("content_hash", *(F.col(f"w.{p}").alias(p) for p in SHARED), F.col("w.variant_key").alias("variant_key"), (F.col("w.variant_key") == F.col("c.variant_key")).alias("strict"), F.col("c.entry").alias("entry"), F.col("c.step_sec").alias("step_sec"), verdict.alias("verdict"))


# What can be wrong with an entry's file before its content is looked at.
UNREAD = ("no_file", "unreadable", "not_decompressed", "not_parsed")
_BLOB = "content_hash string, entry int, variant_key bigint, content binary"


def pack_entries(entries: DataFrame) -> DataFrame:
    """(content_hash, entry, variant_key, content): entries as compressed JSON, a file's worth each."""
    rows = entries.select("content_hash", F.col("entry").cast("int").alias("entry"), F.col("variant_key").cast("bigint").alias("variant_key"), F.to_json(F.struct(*entries.columns)).alias("text"))

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor()
        for b in batches:
            yield b.drop(columns=["text"]).assign(content=[z.compress(t.encode()) for t in b["text"]])

    return rows.mapInPandas(run, _BLOB)


def open_entries(blobs: DataFrame, frames: int = 10_000_000, width: int = 88) -> DataFrame:
    """The facts of packed entries, and opened: ok, or why an entry could not be read.

    blobs: (content_hash, entry, variant_key, content, exists BOOLEAN); a file that exists without content could not be read."""
    import pandas as pd

    def run(batches):
        import zstandard

        for b in batches:
            texts, states = [], []
            for content, exists in zip(b["content"], b["exists"], strict=True):
                text, state = None, "no_file" if not exists else "unreadable" if content is None else "ok"
                if state == "ok":
                    try:
                        text = zstandard.decompress(content).decode()
                    except (zstandard.ZstdError, UnicodeDecodeError):
                        state = "not_decompressed"
                texts.append(text)
                states.append(state)
            yield pd.DataFrame({"content_hash": b["content_hash"], "entry": b["entry"], "variant_key": b["variant_key"], "text": texts, "opened": states})

    form = "sample_rate int, quality int, speed double, pitch double, use_cqt boolean, preprocess boolean, n_samples bigint, version int, step_sec double, timeline array<array<double>>"
    rows = blobs.select("content_hash", "entry", "variant_key", "content", "exists").mapInPandas(run, "content_hash string, entry int, variant_key bigint, text string, opened string")
    parsed = rows.withColumn("p", F.from_json("text", form)).withColumn("broken", (F.col("opened") == "ok") & F.col("p.version").isNull())
    facts = parsed.select("content_hash", "entry", "variant_key", F.when(F.col("broken"), "not_parsed").otherwise(F.col("opened")).alias("opened"), "p.*")
    return entry_facts(facts, frames, width)


def diagnosed(wanted: DataFrame, facts: DataFrame, **limits) -> DataFrame:
    """For each wanted song the entry that serves (those of its own variant first, then by entry) and what was found on the way to it:
    candidates, files, parsed, and how many were turned down for each reason until one served."""
    rows = judged(wanted, facts, **limits)
    every = wanted.select("content_hash", "variant_key")
    order = Window.partitionBy("content_hash", "variant_key").orderBy(~F.col("strict"), "entry")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("first", F.min(F.when(F.col("verdict") == "ok", F.col("place"))).over(Window.partitionBy("content_hash", "variant_key")))
    seen = F.col("first").isNull() | (F.col("place") <= F.col("first"))
    reasons = (*UNREAD, *REASONS)
    counts = [F.count_if(seen & (F.col("verdict") == r)).alias(r) for r in reasons]
    files = [F.count_if(seen & (F.col("verdict") != "no_file")).alias("files"), F.count_if(seen & ~F.col("verdict").isin(*UNREAD)).alias("parsed")]
    found = ranked.groupBy("content_hash", "variant_key").agg(F.count("*").alias("candidates"), *files, *counts, F.max(F.when(F.col("place") == F.col("first"), F.col("entry"))).alias("entry"))
    filled = every.join(found, ["content_hash", "variant_key"], "left")
    return filled.select("content_hash", "variant_key", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("candidates", "files", "parsed", *reasons)), "entry")


def find_timeline(wanted: DataFrame, cached: DataFrame, **limits) -> DataFrame:
    """For each wanted song the entry that serves, those of its own variant first, and how many were turned down for each reason."""
    rows = judged(wanted, cached, **limits)
    counts = [F.count_if(F.col("verdict") == r).alias(r) for r in REASONS]
    found = rows.groupBy("content_hash", "variant_key").agg(F.count("*").alias("candidates"), *counts, F.min(F.when(F.col("verdict") == "ok", F.struct((~F.col("strict")).alias("other"), "entry"))).alias("best"))
    every = wanted.select("content_hash", "variant_key").join(found, ["content_hash", "variant_key"], "left")
    return every.select("content_hash", "variant_key", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("candidates", *REASONS)), F.col("best.entry").alias("entry"))


def far_off(cached: Column, expected: Column, drift: float = 0.3, seconds: float = 60.0) -> Column:
    """The pre-check: an entry more than 30 % and more than a minute off is not worth opening."""
    off = F.abs(cached - expected)
    return (off > drift * expected) & (off > seconds)


def valid_waveform(points: DataFrame, most: int = 5_000_000) -> DataFrame:
    """track_id, ok: at most so many points, all finite, times never falling. points: (track_id, n, t, amp)."""
    from pyspark.sql import Window

    before = F.lag("t").over(Window.partitionBy("track_id").orderBy("n"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    fine = finite("t") & finite("amp") & (before.isNull() | (F.col("t") >= before))
    return points.withColumn("fine", fine).groupBy("track_id").agg((F.every("fine") & (F.count("*") <= most)).alias("ok"), F.count("*").alias("points"))


def write_entries(entries: DataFrame, path: str, keys: tuple[str, ...] = ("content_hash",)) -> None:
    """Append entries to the cache table: Parquet with zstd, a folder for each key, so that a lookup reads one song's."""
    entries.write.mode("append").option("compression", "zstd").partitionBy(*keys).parquet(path)


def stem_entries(timelines: DataFrame, model: str, version: int = 1) -> DataFrame:
    """Rows of the per-stem cache, to be written by (content_hash, stem, model). timelines: (content_hash, stem, step_sec, timeline)."""
    return timelines.select("content_hash", "stem", F.lit(model).alias("model"), F.lit(version).alias("version"), "step_sec", "timeline")


def state_json(state: Column) -> Column:
    """Persisted settings as indented JSON."""
    return F.to_json(state, {"pretty": "true"})


def to_compute(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """What has no entry yet."""
    return wanted.join(cached, ["content_hash", "variant_key"], "left_anti")


def valid_frames(frames: DataFrame, width: int = 88) -> DataFrame:
    """track_id, ok: all frames have the width and finite values."""
    fine = (F.size("probs") == width) & F.forall("probs", lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf"))))
    return frames.groupBy("track_id").agg(F.every(fine).alias("ok"), F.count("*").alias("frames"))


def loop_part(t: Column, start: float, end: float) -> Column:
    return F.when(t < start, "pre").when(t > end, "post").otherwise("mid")


def shift_loop(start: Column, end: Column, by: Column, duration: Column) -> Column:
    """The loop moved inside the track, its length kept."""
    length = end - start
    s = F.greatest(F.lit(0.0), F.least(duration - length, start + by))
    return F.struct(s.alias("start"), (s + length).alias("end"))


def resume_position(saved: Column, duration: Column) -> Column:
    """Used over half a second; clamped to 95 % of the track where it lies beyond it."""
    return F.when(saved > 0.5, F.when(saved > duration, duration * 0.95).otherwise(saved)).otherwise(F.lit(0.0))


def preview_bucket(t: Column, width: int = 8) -> Column:
    return F.floor(t / width) * width


def analysis_estimate(audio: Column, ema_rate: Column, quality: Column, full: bool = True) -> Column:
    """Seconds an analysis may take, clamped to 0.8-300."""
    q = F.when(quality == "Draft", 0.75).when(quality == "Studio", 1.35).otherwise(1.0)
    if full:
        return F.greatest(F.lit(0.8), F.least(F.lit(300.0), 0.8 + audio * (0.4 * 0.07 + 0.6 * ema_rate) * q))
    return F.greatest(F.lit(0.25), F.least(F.lit(8.0), 0.25 + 0.02 * audio))

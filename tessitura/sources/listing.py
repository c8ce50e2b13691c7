"""What is known of media before it is decoded: probes, the choice of a track, tags, safe paths, stems in a folder, chunk streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_rate, is_media, stem_of
from ..operators.session import first_nonblank
from .ranged import chunk_events, preview, register_audio  # noqa: F401

# Fixed value: the order of stems in a session.
STEM_ORDER = ["drums", "bass", "other", "vocals", "piano", "guitar"]


def read_audio(spark: SparkSession, path: str, block: int = 65_536, mono: bool = True, most_bytes: int = 10 << 30) -> DataFrame:
    """Blocks of mono (mean of channels) or interleaved stereo samples of the WAV and FLAC files under path."""
    register_audio(spark)
    return spark.read.format("audio_blocks").option("block", block).option("mono", str(mono).lower()).option("mostBytes", most_bytes).load(path)


def probe_audio(spark: SparkSession, path: str, most_bytes: int = 10 << 30) -> DataFrame:
    """One row for each audio file under path: rate, channels, frames, seconds and tags; an error where it cannot be read."""
    register_audio(spark)
    return spark.read.format("audio_probe").option("mostBytes", most_bytes).load(path)


def choose_track(tracks: DataFrame) -> DataFrame:
    """The audio track of each file, from its container's tracks (path, track_no, sample_rate, n_frames, time_base).

    Tracks with a sample rate are audio. Of several the one whose length is nearest to the longest other track's counts, or the
    longest where there is no other; one of unknown length only if the best known is more than half off. Later ones win ties."""
    seconds = F.when(F.col("sample_rate").isNotNull(), F.col("n_frames") / F.col("sample_rate")).otherwise(F.col("n_frames") * F.col("time_base"))
    rows = tracks.withColumn("seconds", seconds)
    facts = rows.groupBy("path").agg(
        F.coalesce(F.max(F.when(F.col("sample_rate").isNull(), F.col("seconds"))), F.lit(0.0)).alias("video"), F.coalesce(F.max(F.when(F.col("sample_rate").isNotNull(), F.col("seconds"))), F.lit(0.0)).alias("best"))
    off = (F.col("best") > 0) & (F.abs(F.col("best") - F.col("video")) > 0.5 * F.col("video"))
    known = F.when(F.col("video") > 0, -F.abs(F.col("seconds") - F.col("video"))).otherwise(F.col("seconds"))
    unknown = F.when(F.col("video") > 0, F.when(off, 0.0).otherwise(float("-inf"))).otherwise(0.0)
    scored = rows.where("sample_rate is not null").join(facts, "path").withColumn("score", F.when(F.col("seconds").isNotNull(), known).otherwise(unknown))
    return scored.groupBy("path").agg(F.max_by(F.struct("track_no", "sample_rate", "seconds"), F.struct("score", "track_no")).alias("t")).select("path", "t.track_no", "t.sample_rate", "t.seconds")


def song_facts(tags: Column) -> Column:
    """Title, artist and album of a map of tags: the standard key's first value that isn't blank, else that of a key which holds it."""
    low = F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))

    def holding(name: str) -> Column:
        return F.transform(F.filter(F.map_entries(low), lambda e: F.contains(e["key"], F.lit(name))), lambda e: e["value"])

    def find(*names: str) -> Column:
        exact = [F.try_element_at(low, F.lit(n)) for n in names]
        return first_nonblank(F.concat(F.array(*exact), *map(holding, names)))

    return F.struct(find("title").alias("title"), find("artist", "performer").alias("artist"), find("album").alias("album"))


def artwork(pictures: Column) -> Column:
    """Of an array of (usage, media_type, data): the front cover, else the first image, else the first."""
    front = F.filter(pictures, lambda p: F.lower(p["usage"]) == "front cover")
    image = F.filter(pictures, lambda p: F.lower(p["media_type"]).startswith("image/"))
    return F.coalesce(*(F.try_element_at(x, F.lit(1)) for x in (front, image, pictures)))


def video_facts(streams: DataFrame) -> DataFrame:
    """(path, fps, seconds) of a probe's video streams (path, r_frame_rate, avg_frame_rate, duration, format_duration).

    The real frame rate, else the average one, else 30; the stream's duration, else the file's."""
    rate = F.coalesce(frame_rate(F.col("r_frame_rate")), frame_rate(F.col("avg_frame_rate")), F.lit(30.0))
    return streams.select("path", rate.alias("fps"), F.coalesce(F.col("duration").try_cast("double"), F.col("format_duration").try_cast("double")).alias("seconds"))


def is_safe_path(path: Column, length: Column, is_file: Column, most_bytes: int = 10 << 30) -> Column:
    """An absolute path, not on a network share, of a supported kind, that is a regular file of at most so many bytes."""
    absolute = path.startswith("/") | F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]"))
    share = F.rlike(path, F.lit(r"^(\\\\|//)"))
    return F.coalesce(absolute & ~share & is_media(path) & is_file & (length <= most_bytes), F.lit(False))


def stems_in_folder(files: DataFrame) -> DataFrame:
    """(folder, stem, path, confidence) of the stem files of a listing (path), in a session's order of stems."""
    name = F.regexp_extract("path", r"([^/\\]+)\.[^.]+$", 1)
    rows = files.where(F.rlike(F.lower("path"), F.lit(r"\.(wav|mp3)$"))).select("path", F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1).alias("folder"), stem_of(name).alias("stem"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STEM_ORDER)), F.lower("stem")), F.lit(0))
    return rows.select("folder", "stem", "path", F.lit(0.9).alias("confidence"), F.when(rank > 0, rank - 1).otherwise(len(STEM_ORDER)).cast("int").alias("place"))


def stream_audio(spark: SparkSession, path: str, chunk: int = 65_536, per_trigger: int = 64, cancel: str | None = None, tasks: int = 8, mono: bool = True) -> DataFrame:
    """The audio files that arrive in a folder, as a stream of events: started, chunk (of at least 16384 samples, the last as long as
    it is), finished, or error; and the content's hash once it is known. See ``ranged.ChunkPlan`` for order, restart and cancel."""
    register_audio(spark)
    reader = spark.readStream.format("audio_chunks").option("chunk", chunk).option("chunksPerTrigger", per_trigger)
    plan = (reader.option("cancel", cancel) if cancel else reader).load(path)
    return chunk_events(plan.repartition(tasks, "path", "start_frame"), mono)

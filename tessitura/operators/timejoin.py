"""Joins in time: interval, as-of, nearest and tolerance joins, always with the track's equality and a time bucket where the
other side is long, so that Spark plans a hash or sort-merge join with a residual filter.

Intervals are half open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_sort(df: DataFrame) -> DataFrame:
    """df for a join by sorting both sides. Spark takes exploded rows for as few as they were before, so it would send a long side to
    the driver and to every executor."""
    return df.hint("merge")


def spread_out(rows: DataFrame) -> DataFrame:
    """rows dealt to all shuffle partitions in turn, before each becomes many.

    Adaptive execution brings a row a track, which are few bytes, to one task; with a number of partitions it leaves them dealt, and
    what is made of them is shuffled by key when its size is known."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, bucket: float, keys: tuple[str, ...] = ("track_id",), how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them, start <= at < end.

    Each interval is laid out over the buckets it touches, a point has one: the join is by keys and bucket, so a long track is
    many groups. bucket is about an interval's length."""
    spread = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(start, end) / bucket))))
    dealt = points.withColumn("__b", F.floor(F.col(at) / bucket))
    left, right = dealt.alias("p"), by_sort(spread.alias("i"))
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys] + [F.col("p.__b") == F.col("i.__b"), F.col(f"p.{at}") >= F.col(f"i.{start}"), F.col(f"p.{at}") < F.col(f"i.{end}")]
    own = [F.col(f"p.{c}") for c in points.columns]
    others = [F.col(f"i.{c}") for c in intervals.columns if c not in points.columns]
    return left.join(right, on, how).select(*own, *others)


def asof_fill(points: DataFrame, marks: DataFrame, at: str, mark: str, columns: list[str], keys: tuple[str, ...] = ("track_id",), inclusive: bool = True) -> DataFrame:
    """For each point the columns of the last mark at or before it, by one sort over both sides and no join.

    A mark of equal time counts as before the point, or as after it if not inclusive. The sort is by key, so one key's rows are
    one task's: right for songs; an endless stream is first cut into keys of bounded length."""
    both = points.withColumn("__t", F.col(at)).withColumn("__side", F.lit(1))
    for c in columns:
        both = both.withColumn(f"__{c}", F.lit(None).cast(marks.schema[c].dataType))
    other = marks.select(*keys, F.col(mark).alias("__t"), F.lit(0 if inclusive else 2).alias("__side"), *(F.col(c).alias(f"__{c}") for c in columns))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(other, allowMissingColumns=True).select("*", *(F.last(f"__{c}", ignorenulls=True).over(w).alias(f"__f_{c}") for c in columns)).where("__side = 1")
    return filled.select(*points.columns, *(F.col(f"__f_{c}").alias(c) for c in columns))


def within_tolerance(left: DataFrame, right: DataFrame, at: str, other: str, tol: float, exists: bool = True, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Rows of left for which a row of right exists (or not) with |at - other| < tol, by buckets of the tolerance."""
    near = right.select(*keys, F.col(other).alias("__o")).withColumn("__b", F.explode(F.array(*(F.floor(F.col("__o") / tol) + d for d in (-1, 0, 1)))))
    dealt = left.withColumn("__b", F.floor(F.col(at) / tol))
    on = [dealt[k] == near[k] for k in keys] + [dealt["__b"] == near["__b"], F.abs(dealt[at] - near["__o"]) < tol]
    return dealt.join(by_sort(near), on, "left_semi" if exists else "left_anti").drop("__b")


SEGMENT = ("seg_no", "start_time_sec", "end_time_sec", "bpm", "beat_duration_sec", "beat_offset")


def _with_segment(points: DataFrame, segments: DataFrame, at: str, by: str, inclusive: bool, inside) -> DataFrame:
    """points with a struct seg: the segment that begins last before the point if it is inside, else the first or last.

    Segments of a track follow one another; they meet the points in one ordered scan, and each track's first and last by key."""
    marks = segments.select("track_id", F.col(by).alias("mark"), F.struct(*SEGMENT).alias("seg"))
    ends = marks.groupBy("track_id").agg(F.min_by("seg", "mark").alias("first_seg"), F.max_by("seg", "mark").alias("last_seg"), F.min("mark").alias("first_mark"))
    found = asof_fill(points, marks, at, "mark", ["seg"], inclusive=inclusive).join(ends, "track_id")
    best = F.when(inside, F.col("seg")).when(F.col(at) <= F.col("first_mark"), F.col("first_seg")).otherwise(F.col("last_seg"))
    return found.select(*points.columns, best.alias("seg"))


def segment_at_time(points: DataFrame, segments: DataFrame, at: str) -> DataFrame:
    """The segment with start <= t < end; before the first the first, otherwise (after all, or in a gap) the last."""
    return _with_segment(points, segments, at, "start_time_sec", True, F.col(at) < F.col("seg.end_time_sec"))


def time_to_beat(points: DataFrame, segments: DataFrame, at: str = "t", to: str = "beat") -> DataFrame:
    """Adds beat: the segment's offset plus the time into it in beats."""
    hit = segment_at_time(points, segments, at)
    return hit.withColumn(to, F.col("seg.beat_offset") + (F.col(at) - F.col("seg.start_time_sec")) / F.col("seg.beat_duration_sec")).drop("seg")


def beat_to_time(points: DataFrame, segments: DataFrame, at: str = "beat") -> DataFrame:
    """Adds t: the first segment with start beat <= b <= end beat, otherwise clamped into the last."""
    length = (F.col("seg.end_time_sec") - F.col("seg.start_time_sec")) / F.col("seg.beat_duration_sec")
    inside = F.col(at) <= F.col("seg.beat_offset") + length
    marks = segments.select("track_id", F.col("beat_offset").alias("mark"), F.struct(*SEGMENT).alias("seg"))
    ends = marks.groupBy("track_id").agg(F.min_by("seg", "mark").alias("first_seg"), F.max_by("seg", "mark").alias("last_seg"), F.min("mark").alias("first_mark"))
    found = asof_fill(points, marks, at, "mark", ["seg"], inclusive=False).join(ends, "track_id")
    best = F.when(inside, F.col("seg")).when(F.col(at) == F.col("first_mark"), F.col("first_seg")).otherwise(F.col("last_seg"))
    hit = found.select(*points.columns, best.alias("seg"))
    free = F.col("seg.start_time_sec") + (F.col(at) - F.col("seg.beat_offset")) * F.col("seg.beat_duration_sec")
    return hit.withColumn("t", F.greatest(F.col("seg.start_time_sec"), F.least(F.col("seg.end_time_sec"), free))).drop("seg")


def next_in_track(column: str, order: str, by: int = 1) -> Column:
    return F.lead(column, by).over(Window.partitionBy("track_id").orderBy(order))

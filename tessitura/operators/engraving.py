"""Where engraved notes lie: positions read from an SVG page, and the note at a tick."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timejoin import interval_join

POSITIONS = "page_id bigint, note_id bigint, pitch int, tick int, duration_ticks int, x double, y double, w double, h double"
_NOTE = re.compile(r"n(\d.*)")
_SHIFT = re.compile(r"translate\(\s*([^\s,)]+)[\s,]+([^\s,)]+)")


def _numbers(text: str | None) -> list[float]:
    try:
        return [float(x) for x in (text or "").split()]
    except ValueError:
        return []


def _shift(node) -> tuple[float, float] | None:
    m = _SHIFT.search(node.get("transform") or "")
    try:
        return (float(m[1]), float(m[2])) if m else None
    except ValueError:
        return None


def _box(node) -> tuple[float, float, float, float] | None:
    """Left, top, width and height of a note: its bounding box, else its rect's, else where its first use is placed (without a size)."""
    tag = lambda n: n.tag.rpartition("}")[2]
    box = _numbers(node.get("data-bounding-box"))
    if len(box) >= 4 and box[2] > 0 and box[3] > 0:
        return tuple(box[:4])
    for rect in (c for c in node if tag(c) == "rect"):
        box = [v for a in ("x", "y", "width", "height") for v in _numbers(rect.get(a))]
        return tuple(box) if len(box) == 4 and box[2] > 0 and box[3] > 0 else None
    if any(tag(c) == "g" and "bbox-" in (c.get("id") or "") for c in node):
        return None
    use = next((n for n in node.iter() if tag(n) == "use"), None)
    if use is None:
        return None
    at = _numbers(use.get("x")) + _numbers(use.get("y"))
    at = tuple(at) if len(at) == 2 else _shift(use)
    return (*at, 0.0, 0.0) if at else None


def read_positions(svg: str) -> list[tuple]:
    """(note id, pitch, tick, ticks, x, y, w, h) of a page's notes, as shares of its view box.

    Ids are n<id>_<pitch>_<tick>_<ticks>, or without the id; pitches lie within a piano. A page that cannot be read has none."""
    try:
        root = ET.fromstring(svg)
    except ET.ParseError:
        return []
    boxes = [_numbers(n.get("viewBox")) for n in root.iter() if n.tag.rpartition("}")[2] == "svg" and n.get("viewBox")]
    if not boxes or len(boxes[0]) != 4 or min(boxes[0][2:]) <= 0:
        return []
    width, height = boxes[0][2:]
    groups = [n for n in root.iter() if n.tag.rpartition("}")[2] == "g"]
    margin = next((_shift(n) or (0.0, 0.0) for n in groups if n.get("class") == "page-margin"), (0.0, 0.0))
    out = []
    for g in groups:
        m = _NOTE.search(g.get("id") or "")
        parts = m[1].split("_") if m else []
        if len(parts) < 3:
            continue
        whole = lambda s, other=None: int(s) if re.fullmatch(r"-?\d+", s) else other
        note, rest = (whole(parts[0]), parts[1:]) if len(parts) >= 4 else (0, parts)
        pitch = whole(rest[0])
        if note is None or pitch is None or not 21 <= pitch <= 108:
            continue
        if box := _box(g):
            x, y, w, h = box
            out.append((note, pitch, whole(rest[1], 0), whole(rest[2], 0), (x + margin[0]) / width, (y + margin[1]) / height, w / width, h / height))
    return out


def note_positions(pages: DataFrame) -> DataFrame:
    """Positions of the notes on SVG pages (page_id, svg): a page gives many rows, so a page is one task's work."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, svg in zip(pdf["page_id"], pdf["svg"], strict=True) for r in read_positions(svg or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POSITIONS.split(", ")])

    return pages.select("page_id", "svg").mapInPandas(run, POSITIONS)


def measure_of_tick(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """points (track_id, tick) with measure: the one whose span holds the tick, else the track's last (or first, before all).

    boundaries: (track_id, measure, start_tick, end_tick)."""
    ends = boundaries.groupBy("track_id").agg(F.min_by("measure", "start_tick").alias("first"), F.max_by("measure", "start_tick").alias("last"), F.min("start_tick").alias("begin"))
    hit = interval_join(points, boundaries, "tick", "start_tick", "end_tick", 1920.0, how="left")
    rows = hit.select(*points.columns, "measure").join(ends, "track_id")
    return rows.select(*points.columns, F.coalesce("measure", F.when(F.col("tick") < F.col("begin"), F.col("first")).otherwise(F.col("last"))).alias("measure"))

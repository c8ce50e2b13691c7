"""Score serialisation: tick spans, measures, voices, MusicXML and MIDI."""

from __future__ import annotations

import struct
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantize import snap_duration
from .timejoin import by_sort, interval_join

TICKS = 480
# Notated lengths in ticks, longest first, with type and dots.
LENGTHS = [(1920, "whole", 0), (1440, "half", 1), (960, "half", 0), (720, "quarter", 1), (480, "quarter", 0), (360, "eighth", 1), (240, "eighth", 0), (180, "16th", 1), (120, "16th", 0)]


def note_spans(quantised: DataFrame, split: int = 60) -> DataFrame:
    """Start and end ticks, staff by pitch; of neighbours with equal start and pitch the longest."""
    start = F.round(F.col("beat_start") * TICKS).cast("int")
    length = F.round(snap_duration(F.col("beat_duration")) * TICKS).cast("int")
    rows = quantised.select("track_id", "id", "pitch", "velocity", start.alias("start_tick"), (start + length).alias("end_tick"), F.when(F.col("pitch") >= split, 1).otherwise(2).alias("staff"))
    w = Window.partitionBy("track_id", "start_tick", "pitch").orderBy(F.desc("end_tick"), "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def measure_boundaries(signatures: DataFrame, until: DataFrame) -> DataFrame:
    """Measures (track_id, measure, start_tick, end_tick, numerator, denominator) up to where the last note ends.

    Each signature's stretch, up to the next or its own end, holds measures of numerator quarters, the last perhaps short; after
    the last signature its measures go on. until: (track_id, end_tick)."""
    w = Window.partitionBy("track_id").orderBy("start_beat")
    tick = lambda c: F.round(F.col(c) * TICKS).cast("bigint")
    rows = signatures.join(until.select("track_id", F.col("end_tick").cast("bigint").alias("stop")), "track_id").withColumn("width", F.greatest(F.lit(1), F.col("numerator")).cast("bigint") * TICKS)
    rows = rows.withColumn("s", tick("start_beat")).withColumn("e", F.least(F.coalesce(F.lead(tick("start_beat")).over(w), tick("end_beat")), F.col("stop")))
    last = rows.groupBy("track_id").agg(F.max_by(F.struct("width", "numerator", "denominator", "stop", "e"), "s").alias("x")).select("track_id", F.col("x.e").alias("s"), F.col("x.stop").alias("e"), "x.width", "x.numerator", "x.denominator")
    every = rows.select("track_id", "s", "e", "width", "numerator", "denominator").unionByName(last).where("e > s")
    cut = every.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("e") - F.col("s") - 1) / F.col("width")))))
    found = cut.select("track_id", (F.col("s") + F.col("k") * F.col("width")).alias("start_tick"), F.least(F.col("s") + (F.col("k") + 1) * F.col("width"), F.col("e")).alias("end_tick"), "numerator", "denominator")
    return found.withColumn("measure", F.row_number().over(Window.partitionBy("track_id").orderBy("start_tick")).cast("int")).select("track_id", "measure", "start_tick", "end_tick", "numerator", "denominator")


def equal_measures(spans: DataFrame, beats: int = 4) -> DataFrame:
    """Measures of so many quarters up to the last note's end, for tracks without signatures."""
    ends = spans.groupBy("track_id").agg(F.max("end_tick").alias("e"))
    m = ends.select("track_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest(F.col("e"), F.lit(1)) - 1) / (beats * TICKS)))).alias("m"))
    return m.select("track_id", (F.col("m") + 1).cast("int").alias("measure"), (F.col("m") * beats * TICKS).cast("bigint").alias("start_tick"), ((F.col("m") + 1) * beats * TICKS).cast("bigint").alias("end_tick"), F.lit(beats).alias("numerator"), F.lit(4).alias("denominator"))


def split_into_measures(spans: DataFrame, boundaries: DataFrame | None = None, bucket: int = 4 * TICKS) -> DataFrame:
    """Pieces of notes by measure, with tie flags. boundaries: as of measure_boundaries(), or none for measures of four quarters.

    Notes and measures are laid out over buckets of ticks and meet by track and bucket; a pair counts in the first they share."""
    if boundaries is None:
        boundaries = equal_measures(spans)
    lay = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.greatest(F.col(z), F.col(a) + 1) - 1) / bucket)))
    n = spans.withColumn("stop", F.greatest(F.col("end_tick"), F.col("start_tick") + 1)).withColumn("b", lay("start_tick", "stop"))
    m = boundaries.select(F.col("track_id"), F.col("measure"), F.col("start_tick").alias("m_start"), F.col("end_tick").alias("m_end")).withColumn("b", lay("m_start", "m_end"))
    met = n.join(m, ["track_id", "b"]).where("start_tick < m_end and m_start < stop").where(F.col("b") == F.floor(F.greatest("start_tick", "m_start") / bucket))
    return met.select(
        "track_id", "id", "pitch", "staff", "measure", F.greatest("start_tick", "m_start").cast("int").alias("start_tick"), F.least("end_tick", "m_end").cast("int").alias("end_tick"),
        (F.col("stop") > F.col("m_end")).alias("tie_start"), (F.col("start_tick") < F.col("m_start")).alias("tie_stop"),
    )


def length_tokens(ticks: int) -> list[tuple[int, str, int]]:
    """A length in whole sixteenths as notated values, longest first."""
    out, left = [], ticks // 120 * 120
    while left >= 120:
        value = next(x for x in LENGTHS if x[0] <= left)
        out.append(value)
        left -= value[0]
    return out


def duration_tokens(spark) -> DataFrame:
    """ticks (a multiple of 120 up to four whole notes), seq, value, type, dots: the greedy split as a lookup table."""
    rows = [(t, i, *v) for t in range(120, 4 * 1920 + 1, 120) for i, v in enumerate(length_tokens(t))]
    return spark.createDataFrame(rows, "ticks int, seq int, value int, type string, dots int")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by track and measure in all shuffle partitions: a measure is few bytes, but takes Python's time, and adaptive execution would
    bring many to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id", "measure")


def _next_voice(held: list[int], start: int, end: int) -> int:
    """The lowest voice that has ended, of those whose ends are held; it is held from then on."""
    v = next((i for i, x in enumerate(held) if x <= start), len(held))
    held[v : v + 1] = [end]
    return v + 1


def voices(pieces: DataFrame) -> DataFrame:
    """Adds voice: within a measure and staff, in order of start and pitch, the lowest voice that has ended.

    A task takes its measures from one sorted stream; a group each would cost milliseconds, whatever it holds."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", voice int"

    def run(batches):
        place, held = None, []
        for b in batches:
            found = []
            for *at, start, end in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("track_id", "measure", "staff", "start_tick", "end_tick")), strict=True):
                if at != place:
                    place, held = at, []
                found.append(_next_voice(held, start, end))
            yield b.append_column(pa.field("voice", pa.int32()), pa.array(found, pa.int32()))

    return _dealt(pieces).sortWithinPartitions("track_id", "measure", "staff", "start_tick", "pitch", "id").mapInArrow(run, schema)


def _voiced(notes: list[dict] | None) -> list[tuple]:
    """(staff, voice, start, pitch, end, stop, start flag, id, articulation) of a measure's notes, in order."""
    held: dict[int, list[int]] = {}
    out = []
    for n in sorted(notes or (), key=lambda n: (n["staff"], n["start_tick"], n["pitch"], n["id"])):
        voice = _next_voice(held.setdefault(n["staff"], []), n["start_tick"], n["end_tick"])
        out.append((n["staff"], voice, n["start_tick"], n["pitch"], n["end_tick"], n["tie_stop"], n["tie_start"], n["id"], n["articulation"]))
    return sorted(out, key=lambda n: (*n[:4], n[7]))


def _tokens(ticks: int) -> list[tuple[int, str, int]]:
    """Notated values of a length; what is under a sixteenth goes to the last of them."""
    found = length_tokens(ticks) or [(ticks, "16th", 0)]
    rest = ticks - sum(v for v, _, _ in found)
    return [*found[:-1], (found[-1][0] + rest, *found[-1][1:])]


def _note_xml(note: tuple, value: tuple[int, str, int], tick: int, voice: int, chord: bool, stop: bool, start: bool, beam: str | None) -> str:
    """A note element; note is (id, pitch, staff, articulation)."""
    number, pitch, staff, articulation = note
    step, alter = [("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0)][pitch % 12]
    ticks, kind, dots = value
    sides = [k for k, on in (("stop", stop), ("start", start)) if on]
    marks = "".join(f'<tied type="{k}"/>' for k in sides) + (f"<articulations><{articulation.lower()}/></articulations>" if articulation in ("Staccato", "Tenuto") else "")
    return (
        f"<note id=\"n{number}_{pitch}_{tick}_{ticks}\">{'<chord/>' if chord else ''}<pitch><step>{step}</step>{f'<alter>{alter}</alter>' if alter else ''}<octave>{pitch // 12 - 1}</octave></pitch><duration>{ticks}</duration>"
        + "".join(f'<tie type="{k}"/>' for k in sides)
        + f"<voice>{voice}</voice><type>{kind}</type>{'<dot/>' * dots}<staff>{staff}</staff>"
        + (f'<beam number="1">{beam}</beam>' if beam else "") + (f"<notations>{marks}</notations>" if marks else "") + "</note>"
    )


def _rest_xml(ticks: int, staff: int, voice: int) -> str:
    return "".join(f"<note><rest/><duration>{v}</duration><voice>{voice}</voice><type>{kind}</type>{'<dot/>' * dots}<staff>{staff}</staff></note>" for v, kind, dots in _tokens(ticks))


def beams_of(lengths: list[int]) -> list[str | None]:
    """begin, continue and end for runs of two and more groups of at most an eighth."""
    out: list[str | None] = [None] * len(lengths)
    for short, run in groupby(range(len(lengths)), key=lambda i: lengths[i] <= TICKS // 2):
        if short and len(run := list(run)) > 1:
            out[run[0]], out[run[-1]] = "begin", "end"
            for i in run[1:-1]:
                out[i] = "continue"
    return out


def voice_xml(notes: list[tuple], begin: int, width: int, staff: int, voice: int) -> str:
    """One voice of a measure: groups of equal start as chords, rests of an eighth and more, and skips below that.

    notes: (start, pitch, end, stop, start flag, id, articulation) in order. A group that begins before the last has ended is
    moved to its end; a note keeps its own length, cut at the barline."""
    groups = [list(g) for _, g in groupby(notes, key=lambda n: n[0])]
    out, cursor = [], 0

    def pause(ticks: int) -> None:
        if ticks > 0:
            out.append(_rest_xml(ticks, staff, voice) if ticks >= TICKS // 2 else f"<forward><duration>{ticks}</duration></forward>")

    for group, beam in zip(groups, beams_of([max(n[2] - n[0] for n in g) for g in groups]), strict=True):
        at = max(cursor, group[0][0] - begin)
        pause(min(at, width) - cursor)
        cursor = min(at, width)
        if cursor >= width:
            break
        longest = min(max(n[2] - n[0] for n in group), width - cursor)
        for i, (start, pitch, end, stop, tie, number, articulation) in enumerate(group):
            tick, values = start, _tokens(min(end - start, longest))
            for j, value in enumerate(values):
                out.append(_note_xml((number, pitch, staff, articulation), value, tick, voice, i > 0, stop or j > 0, tie or j + 1 < len(values), beam if i == j == 0 else None))
                tick += value[0]
        cursor += longest
    pause(width - cursor)
    return "".join(out)


# How pitch classes are written in chord symbols.
STEPS = (("C", 0), ("D", -1), ("D", 0), ("E", -1), ("E", 0), ("F", 0), ("G", -1), ("G", 0), ("A", -1), ("A", 0), ("B", -1), ("B", 0))


def harmony_xml(offset: int, root: tuple[str, int], kind: str, bass: tuple[str, int] | None, degrees: list[tuple[int, int, str]]) -> str:
    """A chord symbol: root, kind, bass under a slash, altered degrees."""
    note = lambda name, step, alter: f"<{name}><{name}-step>{step}</{name}-step>{f'<{name}-alter>{alter}</{name}-alter>' if alter else ''}</{name}>"
    altered = "".join(f"<degree><degree-value>{v}</degree-value><degree-alter>{a}</degree-alter><degree-type>{t}</degree-type></degree>" for v, a, t in degrees)
    text = ' text="other"' if kind == "other" else ""
    return f"<harmony>{note('root', *root)}<kind{text}>{kind}</kind>{note('bass', *bass) if bass else ''}{altered}{f'<offset>{offset}</offset>' if offset > 0 else ''}</harmony>"


def _clef_xml(sign: str, number: int | None = None) -> str:
    return f"<clef{f' number=\"{number}\"' if number else ''}><sign>{sign}</sign><line>{4 if sign == 'F' else 2}</line></clef>"


def measure_xml(number: int, notes: list[tuple], begin: int, width: int, first: bool, meter: tuple[int, int] | None, bpm: float | None, swing: str | None, harmony: list[str], clef: str | None = None, single: bool = False) -> str:
    """One measure: attributes where they begin or change, swing words, the tempo in the first, chord symbols, then each voice of the
    staves with backups. notes: (staff, voice, start, pitch, end, stop, start flag, id, articulation) in order; meter: where new;
    clef: of a single staff, in the first measure and where it changes."""
    out = [f'<measure number="{number}">']
    time = f"<time><beats>{meter[0]}</beats><beat-type>{meter[1]}</beat-type></time>" if meter else ""
    changed = _clef_xml(clef) if clef else ""
    if first:
        staves = changed if single else f"<staves>2</staves>{_clef_xml('G', 1)}{_clef_xml('F', 2)}"
        out.append(f"<attributes><divisions>{TICKS}</divisions>{time}{staves}</attributes>")
    elif time or changed:
        out.append(f"<attributes>{time}{changed}</attributes>")
    if swing:
        out.append(f'<direction placement="above"><direction-type><words>{swing}</words></direction-type></direction>')
    if first and bpm:
        out.append(f'<direction placement="above"><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>{bpm:.2f}</per-minute></metronome></direction-type><sound tempo="{bpm:.2f}"/></direction>')
    out += harmony
    parts = [(staff, voice, [n[2:] for n in part]) for (staff, voice), part in groupby(notes, key=lambda n: n[:2])]
    for k, (staff, voice, part) in enumerate(parts):
        if k:
            out.append(f"<backup><duration>{width}</duration></backup>")
        out.append(voice_xml(part, begin, width, staff, voice))
    if not parts:
        out.append(_rest_xml(width, 1, 1))
    out.append("</measure>")
    return "".join(out)


def musicxml(quantised: DataFrame, chords: DataFrame | None = None, bpm: float | None = None, signatures: DataFrame | None = None, sections: DataFrame | None = None, articulations: DataFrame | None = None, single_staff: bool = False) -> DataFrame:
    """(track_id, xml): each measure is a row with its notes, written by itself, and the measures are joined in order by an aggregate.

    Measures behind the last that has a note, a chord or a style are left out. With single_staff all notes stand in one staff, whose clef follows the measures'
    mean pitch.

    signatures: meters by beat (else 4/4); sections: (track_id, bar_start, bar_end, style); articulations: (track_id, id, articulation)."""
    from ..functions.text import chord_kind, degrees, parse_chord, unaltered
    from .session import clefs_of_all

    spans = note_spans(quantised)
    bars = equal_measures(spans) if signatures is None else measure_boundaries(signatures, spans.groupBy("track_id").agg(F.max("end_tick").alias("end_tick")))
    pieces = split_into_measures(spans, bars)
    pieces = pieces.withColumn("staff", F.lit(1)) if single_staff else pieces
    marked = pieces.withColumn("articulation", F.lit("Normal")) if articulations is None else pieces.join(articulations.select("track_id", "id", "articulation"), ["track_id", "id"], "left").fillna("Normal", ["articulation"])
    w = Window.partitionBy("track_id").orderBy("measure")
    same = (F.lag("numerator").over(w) == F.col("numerator")) & (F.lag("denominator").over(w) == F.col("denominator"))
    rows = bars.withColumn("new_meter", ~F.coalesce(same, F.lit(False)))
    if sections is not None:
        held = interval_join(rows.select("track_id", "measure", (F.col("measure") - 1).alias("bar")), sections.select("track_id", "bar_start", "bar_end", "style"), "bar", "bar_start", "bar_end", 4.0)
        rows = rows.join(held.groupBy("track_id", "measure").agg(F.first("style").alias("style")), ["track_id", "measure"], "left")
    else:
        rows = rows.withColumn("style", F.lit(None).cast("string"))
    before = F.coalesce(F.lag("style").over(w), F.lit("Straight"))
    words = F.when(F.col("style") == "Swing", "Swing").when(F.col("style") == "Triplet", "Triplet feel").when(F.col("style") == "Straight", "Straight")
    rows = rows.withColumn("swing", F.when(F.col("style") != before, words))
    if single_staff:
        clef = clefs_of_all(bars, pieces)
        rows = rows.join(clef.select("track_id", "measure", F.when(F.col("new_clef") | (F.col("measure") == 1), F.col("clef")).alias("clef")), ["track_id", "measure"], "left")
    else:
        rows = rows.withColumn("clef", F.lit(None).cast("string"))
    shape = "array<struct<offset:int,root:int,kind:string,bass:int,degrees:array<struct<value:int,alter:int,type:string>>>>"
    if chords is not None:
        c = chords.withColumn("p", parse_chord(F.col("symbol"))).withColumn("tick", F.round(F.col("beat") * TICKS).cast("int"))
        placed = interval_join(c, bars.select("track_id", "measure", F.col("start_tick").alias("a"), F.col("end_tick").alias("z")), "tick", "a", "z", 4.0 * TICKS)
        entry = F.struct((F.col("tick") - F.col("a")).cast("int").alias("offset"), F.col("p.root").alias("root"), chord_kind(unaltered(F.col("p.suffix"))).alias("kind"), F.col("p.bass").alias("bass"), degrees(F.col("p.suffix")).alias("degrees"))
        rows = rows.join(placed.groupBy("track_id", "measure").agg(F.array_sort(F.collect_list(entry)).cast(shape).alias("harmony")), ["track_id", "measure"], "left")
    else:
        rows = rows.withColumn("harmony", F.lit(None).cast(shape))
    sounding = pieces.groupBy("track_id").agg(F.max("measure").alias("last_note"))
    shown = F.max(F.when(F.col("harmony").isNotNull() | F.col("style").isNotNull(), F.col("measure"))).over(Window.partitionBy("track_id"))
    rows = rows.join(sounding, "track_id", "left").withColumn("shown", shown).where(F.col("measure") <= F.greatest(F.coalesce("last_note", F.lit(1)), F.coalesce("shown", F.lit(1)))).drop("last_note", "shown", "style")

    def write(batches):
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                harmony = [harmony_xml(x["offset"], STEPS[x["root"]], x["kind"], None if x["bass"] is None else STEPS[x["bass"]], [(d["value"], d["alter"], d["type"]) for d in x["degrees"]]) for x in b["harmony"] or ()]
                meter = (b["numerator"], b["denominator"]) if b["new_meter"] else None
                width = b["end_tick"] - b["start_tick"]
                out.append(measure_xml(b["measure"], _voiced(b["notes"]), b["start_tick"], width, b["measure"] == 1, meter, bpm, b["swing"], harmony, b["clef"], single_staff))
            ids = (batch.column(batch.schema.get_field_index(c)) for c in ("track_id", "measure"))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(out, pa.string())], ["track_id", "measure", "xml"])

    note = F.struct("staff", "start_tick", "pitch", "end_tick", "tie_stop", "tie_start", "id", "articulation")
    packed = _dealt(marked.withColumn("note", note).select("track_id", "measure", "note")).groupBy("track_id", "measure").agg(F.collect_list("note").alias("notes"))
    full = _dealt(rows).join(by_sort(packed), ["track_id", "measure"], "left")
    measures = full.select("track_id", "measure", "start_tick", "end_tick", "numerator", "denominator", "new_meter", "swing", "harmony", "clef", "notes").mapInArrow(write, "track_id bigint, measure int, xml string")
    head = '<?xml version="1.0" encoding="UTF-8"?><score-partwise version="3.1"><part-list><score-part id="P1"><part-name>Score</part-name></score-part></part-list><part id="P1">'
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", "xml"))), lambda m: m["xml"]), "")
    return measures.groupBy("track_id").agg(F.concat(F.lit(head), body, F.lit("</part></score-partwise>")).alias("xml"))


def midi_events(notes: DataFrame) -> DataFrame:
    """On and off events at 960 ticks a second with the delta to the event before, offs with velocity 0."""
    on = notes.select("track_id", F.floor(F.col("start_time") * 960).cast("bigint").alias("tick"), F.lit(1).alias("is_on"), "pitch", "velocity", "id")
    off = notes.select("track_id", F.floor(F.col("end_time") * 960).cast("bigint").alias("tick"), F.lit(0).alias("is_on"), "pitch", F.lit(0).alias("velocity"), "id")
    w = Window.partitionBy("track_id").orderBy("tick", "id", F.desc("is_on"))
    rows = on.unionByName(off).withColumn("seq", F.row_number().over(w).cast("int"))
    return rows.withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))).select("track_id", "seq", "tick", "delta", "is_on", "pitch", "velocity")


def _variable(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def midi_file(events: list[tuple[int, int, int, int]]) -> bytes:
    """A format 0 file of (delta, is_on, pitch, velocity)."""
    body = b"".join(_variable(d) + bytes([0x90 if on else 0x80, p & 127, v & 127]) for d, on, p, v in events) + b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, TICKS) + b"MTrk" + struct.pack(">I", len(body)) + body


def midi_files(notes: DataFrame) -> DataFrame:
    """(track_id, content BINARY): a file per track, in one streamed group each."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        events = list(zip(rows["delta"].astype(int), rows["is_on"].astype(int), rows["pitch"].astype(int), rows["velocity"].astype(int), strict=True))
        return pd.DataFrame([(rows["track_id"].iloc[0], midi_file(events))], columns=["track_id", "content"])

    return midi_events(notes).groupBy("track_id").applyInPandas(write, "track_id bigint, content binary")


def parse_midi(content: bytes) -> list[tuple[int, int, int, int]]:
    """The (delta, is_on, pitch, velocity) events of a file that midi_file wrote."""
    at, out = 22, []
    while content[at : at + 4] != b"\x00\xff\x2f\x00":
        n = 0
        while content[at] & 0x80:
            n = n << 7 | content[at] & 0x7F
            at += 1
        n = n << 7 | content[at]
        out.append((n, int(content[at + 1] & 0xF0 == 0x90), content[at + 2], content[at + 3]))
        at += 4
    return out

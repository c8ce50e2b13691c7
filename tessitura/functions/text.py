"""Column functions on labels, chord symbols, clock texts, colours and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules, the first label that contains a word wins.
STEM_RULES = [
    ("drums", ("drum", "percussion")), ("bass", ("bass",)), ("vocals", ("vocal", "voice", "singing")), ("guitar", ("guitar",)), ("piano", ("piano", "keys")), ("other", ("other", "accompaniment")),
]
# Chord suffixes and their MusicXML kinds.
CHORD_KINDS = {
    "": "major", "-": "minor", "dim": "diminished", "aug": "augmented", "sus2": "suspended-second", "sus4": "suspended-fourth", "5": "power", "7": "dominant", "Δ7": "major-seventh", "-7": "minor-seventh",
    "-Δ7": "major-minor", "dim7": "diminished-seventh", "-7b5": "half-diminished", "7#5": "augmented-seventh", "9": "dominant-ninth", "Δ9": "major-ninth", "-9": "minor-ninth", "-11": "minor-11th",
    "13": "dominant-13th", "Δ13": "major-13th", "-13": "minor-13th",
}
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
# Pitch classes of note letters.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MEDIA = ["wav", "mp3", "flac", "ogg", "m4a", "aac", "aiff", "mp4", "mkv", "mov", "webm"]


def stem_of(label: Column) -> Column:
    """The stem a label names, by ordered substring rules; any other label stays itself."""
    low, out = F.lower(label), None
    for stem, words in STEM_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, stem) if out is None else out.when(hit, stem)
    return out.otherwise(label)


def is_melodic(stem: Column) -> Column:
    return ~stem.isin("drums", "bass")


def pitch_class(name: Column) -> Column:
    """0-11 of a note name with b or #; C for anything else."""
    base = F.lit(None).cast("int")
    for letter, pc in LETTERS.items():
        base = F.when(F.substring(name, 1, 1) == letter, pc).otherwise(base)
    shift = F.when(F.substring(name, 2, 1) == "b", -1).when(F.substring(name, 2, 1) == "#", 1).otherwise(0)
    return F.coalesce(F.pmod(base + shift, F.lit(12)), F.lit(0)).cast("int")


def parse_chord(symbol: Column) -> Column:
    """struct(root, suffix, bass): the root's class, the rest before a slash, the class after it (null without)."""
    head, bass = F.split_part(symbol, F.lit("/"), F.lit(1)), F.split_part(symbol, F.lit("/"), F.lit(2))
    root, rest = F.regexp_extract(head, "^([A-G][#b]?)(.*)$", 1), F.regexp_extract(head, "^([A-G][#b]?)(.*)$", 2)
    known = root != ""
    return F.struct(
        F.when(known, pitch_class(root)).otherwise(F.lit(0)).cast("int").alias("root"),
        F.when(known, rest).otherwise(F.substring(head, 2, 1000)).alias("suffix"), F.when(bass != "", pitch_class(bass)).alias("bass"),
    )


# Altered degrees in a suffix, in the order in which they are looked for: degree, semitones, and how it is written.
DEGREES = {"b9": (9, -1, "alter"), "#9": (9, 1, "alter"), "b5": (5, -1, "alter"), "#5": (5, 1, "alter"), "b13": (13, -1, "alter"), "#11": (11, 1, "add")}


def alterations(suffix: Column) -> Column:
    """The altered degrees in a suffix: b9 with b5 first as two, then b9 #9 b5 #5 b13 #11."""
    both = F.contains(suffix, F.lit("b9")) & F.contains(suffix, F.lit("b5"))
    rest = F.when(both, F.replace(F.replace(suffix, F.lit("b9"), F.lit("")), F.lit("b5"), F.lit(""))).otherwise(suffix)
    single = F.filter(F.array(*(F.when(F.contains(rest, F.lit(a)), a) for a in DEGREES)), lambda a: a.isNotNull())
    return F.when(both, F.concat(F.array(F.lit("b9"), F.lit("b5")), single)).otherwise(single)


def unaltered(suffix: Column) -> Column:
    """A suffix without its altered degrees."""
    for a in DEGREES:
        suffix = F.replace(suffix, F.lit(a), F.lit(""))
    return suffix


def degrees(suffix: Column) -> Column:
    """array of (value, alter, type) of the altered degrees."""
    of = F.create_map(*(x for a, (value, alter, kind) in DEGREES.items() for x in (F.lit(a), F.struct(F.lit(value).alias("value"), F.lit(alter).alias("alter"), F.lit(kind).alias("type")))))
    return F.transform(alterations(suffix), lambda a: F.element_at(of, a))


def chord_kind(suffix: Column) -> Column:
    out = None
    for s, kind in CHORD_KINDS.items():
        out = F.when(suffix == s, kind) if out is None else out.when(suffix == s, kind)
    return out.otherwise("other")


def midi_name(pitch: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, SHARPS)), (F.pmod(pitch, F.lit(12)) + 1).cast("int"))
    return F.concat(name, (F.floor(pitch / 12) - 1).cast("int").cast("string"))


def is_black_key(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(1, 3, 6, 8, 10)


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9._ -]", "_")), r"\s+", " ")


def clock_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(F.greatest(F.lit(0.0), seconds)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def parse_clock(text: Column) -> Column:
    """Seconds of s, m:s or h:m:s; null for anything else."""
    parts = F.split(text, ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, at(1)).when(F.size(parts) == 2, at(1) * 60 + at(2)).when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(x), 2, "0")) for x in (r, g, b)))


def parse_colour(text: Column) -> Column:
    ok = F.rlike(text, F.lit("^#[0-9a-fA-F]{6}$"))
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(ok, F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def size_text(n: Column) -> Column:
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", n / (1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / (1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KB", n / (1 << 10))).otherwise(F.format_string("%d B", n))


def is_media(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*MEDIA)


def frame_rate(text: Column) -> Column:
    """num/den or a plain number; null for N/A or a denominator of 0."""
    num, den = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.when(den != 0, F.try_divide(num, den))).otherwise(text.try_cast("double"))


# The signatures that have a class of their own.
METER_CLASSES = {(2, 4): "SimpleDuple", (3, 4): "SimpleTriple", (4, 4): "SimpleQuadruple", (6, 8): "CompoundDuple", (12, 8): "CompoundQuadruple"}


def meter_class(numerator: Column, denominator: Column) -> Column:
    found = F.lit("Other")
    for (n, d), name in METER_CLASSES.items():
        found = F.when((numerator == n) & (denominator == d), name).otherwise(found)
    return found

"""Chord symbols: a lookup table over pitch-class sets, and scans of what sounds when."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import fold_tracks
from .timejoin import interval_join, spread_out

# The chord vocabulary in tie-break order, semitones above the root.
TEMPLATES = [
    ("", (0, 4, 7)), ("-", (0, 3, 7)), ("dim", (0, 3, 6)), ("aug", (0, 4, 8)), ("sus2", (0, 2, 7)), ("sus4", (0, 5, 7)), ("7", (0, 4, 7, 10)),
    ("Δ7", (0, 4, 7, 11)), ("-7", (0, 3, 7, 10)), ("-Δ7", (0, 3, 7, 11)), ("dim7", (0, 3, 6, 9)), ("-7b5", (0, 3, 6, 10)), ("7#5", (0, 4, 8, 10)),
    ("9", (0, 4, 7, 10, 2)), ("Δ9", (0, 4, 7, 11, 2)), ("-9", (0, 3, 7, 10, 2)), ("7b9", (0, 4, 7, 10, 1)), ("7#9", (0, 4, 7, 10, 3)), ("7#11", (0, 4, 7, 10, 6)),
    ("Δ7#11", (0, 4, 7, 11, 6)), ("-11", (0, 3, 7, 10, 2, 5)), ("13", (0, 4, 7, 10, 2, 9)), ("Δ13", (0, 4, 7, 11, 2, 9)), ("-13", (0, 3, 7, 10, 2, 9)), ("Δ9#11", (0, 4, 7, 11, 2, 6)),
]
PLACE = ("found_at", "n_pcs", "symbol")  # of a half bar's candidate
# Spelling of pitch classes.
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]


LETTERS, NATURALS = "CDEFGAB", (0, 2, 4, 5, 7, 9, 11)
# By semitones above the root, how many letters above the root's a bass note is written.
LETTER_STEPS = (0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 6)


def bass_name(root: int, bass: int) -> str:
    """How a bass note is spelled under a root: by the letter of its interval; a letter that only a natural would have gives way to it."""
    at = (LETTERS.index(FLATS[root][0]) + LETTER_STEPS[(bass - root) % 12]) % 7
    off = (bass - NATURALS[at]) % 12
    if off and NATURALS[(at + (1 if off == 1 else -1)) % 7] == (NATURALS[at] + (1 if off == 1 else -1)) % 12:
        return LETTERS[(at + (1 if off == 1 else -1)) % 7]
    return LETTERS[at] + ("" if not off else "#" if off == 1 else "b")


def pc_mask(pitches: Column) -> Column:
    """The pitch classes of an array of pitches as 12 bits."""
    return F.aggregate(F.array_distinct(F.transform(pitches, lambda p: F.pmod(p, F.lit(12)))), F.lit(0), lambda m, pc: m.bitwiseOR(F.expr("1").cast("int") * F.pow(F.lit(2), pc).cast("int")))


def chord_scores(masks: DataFrame) -> DataFrame:
    """mask, root, template number, score of pitch-class sets (mask) against every root and template that covers two of it."""
    rows = [(root, n, sum(1 << ((root + i) % 12) for i in iv), len(iv)) for root in range(12) for n, (_, iv) in enumerate(TEMPLATES)]
    shapes = F.broadcast(masks.sparkSession.createDataFrame(rows, "root int, template int, shape int, k int"))  # 300 rows
    inside = F.bit_count(F.col("mask").bitwiseAND(F.col("shape")))
    outside = F.bit_count("mask") - inside
    simple = F.when(F.col("k") == 3, 1).when(F.col("k") == 4, 0).otherwise(4 - F.col("k"))
    return masks.select("mask").distinct().crossJoin(shapes).where(inside >= 2).select("mask", "root", "template", (inside * 3 - outside + inside + simple).cast("int").alias("score"))


@lru_cache(maxsize=1)
def chord_symbols() -> tuple[str | None, ...]:
    """The whole recogniser: the symbol of pitch classes mask and bass (0-11, or -1 for none) at place 13 * mask + bass + 1.

    One class is an octave, two a fifth apart a power chord; otherwise the best root and template, with 2 more for a root in
    the bass; the first of equal scores in root and template order."""
    shapes = np.array([[sum(1 << (root + i) % 12 for i in iv), len(iv), root] for root in range(12) for _, iv in TEMPLATES])
    simple = np.where(shapes[:, 1] == 3, 1, 4 - shapes[:, 1])
    masks = np.arange(4096)[:, None]
    inside = np.bitwise_count(masks & shapes[:, 0]).astype(int)
    score = np.where(inside >= 2, inside * 4 - (np.bitwise_count(masks) - inside) + simple, -100)
    out: list[str | None] = [None] * (4096 * 13)
    for bass in range(-1, 12):
        raised = score + np.where((shapes[:, 2] == bass) & (score > -100), 2, 0)
        best = raised.argmax(1)
        for mask in range(1, 4096):
            pcs = [p for p in range(12) if mask >> p & 1]
            root, (kind, _) = int(best[mask]) // len(TEMPLATES), TEMPLATES[int(best[mask]) % len(TEMPLATES)]
            if len(pcs) == 1:
                symbol = f"{FLATS[pcs[0]]} (8ve)"
            elif len(pcs) == 2 and pcs[1] - pcs[0] == 7:
                symbol = f"{FLATS[pcs[0]]}5"
            elif raised[mask, best[mask]] == -100:
                symbol = None
            else:
                symbol = FLATS[root] + kind + (f"/{bass_name(root, bass)}" if bass >= 0 and bass != root else "")
            out[13 * mask + bass + 1] = symbol
    return tuple(out)


def chord_table(spark: SparkSession) -> DataFrame:
    """mask, bass, symbol: chord_symbols as rows."""
    return spark.createDataFrame([(n // 13, n % 13 - 1, s) for n, s in enumerate(chord_symbols()) if s], "mask int, bass int, symbol string")


def symbols(sets: DataFrame) -> DataFrame:
    """Adds symbol to rows with mask and bass, by a join with the recogniser's rows.

    They are sent as a table of fixed size, some 53,000 rows. As a literal the table would be part of every plan and every task's
    code, and each plan that adaptive execution makes of a query would hold and print it anew in the driver."""
    found = [(n, s) for n, s in enumerate(chord_symbols()) if s]
    rows = pa.table({"__place": pa.array([n for n, _ in found], pa.int64()), "symbol": pa.array([s for _, s in found], pa.string())})
    table = F.broadcast(sets.sparkSession.createDataFrame(rows))
    place = (F.col("mask") * 13 + F.col("bass") + 1).cast("bigint")
    return sets.withColumn("__place", place).join(table, "__place", "left").select(*sets.columns, "symbol")


def sounding_at(positions: DataFrame, notes: DataFrame, early: float = 1e-5) -> DataFrame:
    """The pitches that sound at each position (start <= pos + 1e-5, pos < end): mask, bass, pcs, notes.

    positions: (track_id, beat); notes: (track_id, id, pitch, beat_start, beat_duration)."""
    spans = notes.select("track_id", "id", "pitch", (F.col("beat_start") - early).alias("s"), (F.col("beat_start") + F.col("beat_duration")).alias("e"), "beat_duration")
    hits = interval_join(positions, spans, "beat", "s", "e", 4.0)
    pc = F.pmod("pitch", F.lit(12))
    # the pitches of one position are folded by aggregates alone: nothing is collected
    bits = [F.max(F.when(pc == i, 1).otherwise(0)) * (1 << i) for i in range(12)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return hits.groupBy("track_id", "beat").agg(mask.cast("int").alias("mask"), F.pmod(F.min("pitch"), F.lit(12)).cast("int").alias("bass"), F.count("*").alias("n_notes"), F.sum("beat_duration").alias("held")).withColumn("n_pcs", F.bit_count("mask").cast("int"))


def changes(scan: DataFrame) -> DataFrame:
    """Rows whose symbol differs from the one before in the track."""
    w = Window.partitionBy("track_id").orderBy("beat")
    return scan.where("symbol is not null").withColumn("was", F.lag("symbol").over(w)).where("was is null or was != symbol").drop("was")


def chord_scan(notes: DataFrame, step: float = 1.0, least: int = 2) -> DataFrame:
    """Chord changes on a fixed grid of beats."""
    ends = notes.groupBy("track_id").agg(F.max(F.col("beat_start") + F.col("beat_duration")).alias("e"))
    grid = spread_out(ends).select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / step).cast("int"))).alias("k")).select("track_id", (F.col("k") * F.lit(step)).alias("beat"))
    heard = symbols(sounding_at(grid, notes).where(F.col("n_pcs") >= least))
    return changes(heard).select("track_id", "beat", "symbol")


def bar_candidates(notes: DataFrame, bpb: int = 4, step: float = 0.25, least: int = 1) -> DataFrame:
    """The best quarter-beat of each half bar: most pitch classes, then 5 * classes + 2 * length + notes, then the earliest."""
    bpb = max(bpb, 2)
    ends = notes.groupBy("track_id").agg(F.max(F.col("beat_start") + F.col("beat_duration")).alias("e"))
    grid = spread_out(ends).select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / step).cast("int"))).alias("k")).select("track_id", (F.col("k") * F.lit(step)).alias("beat"))
    heard = sounding_at(grid, notes).where(F.col("n_pcs") >= least)
    half = F.floor(F.col("beat") / (bpb / 2)).cast("int")
    weight = F.round(F.col("n_pcs") * 5 + F.col("held") * 2 + F.col("n_notes"), 6)
    best = heard.withColumn("half", half).groupBy("track_id", "half").agg(F.max(F.struct("n_pcs", weight.alias("w"), (-F.col("beat")).alias("b"), "mask", "bass")).alias("x"))
    return symbols(best.select("track_id", "half", (-F.col("x.b")).alias("found_at"), "x.n_pcs", "x.mask", "x.bass"))


def bar_choices(bars: list[tuple], bpb: float, most: int = 2, clear: int = 3, least: int = 2) -> list[tuple[float, str]]:
    """(beat, symbol) of the chords of bars in order; a bar is (number, first, second, downbeat).

    first and second are the half bars' candidates (found at, classes, symbol) or None, downbeat (classes, symbol) or None. A
    candidate with clear classes whose symbol differs from the last one counts, at its half's beginning, or where it was found
    if that lies over 0.3 beats from both. A bar in which none counts takes what sounds on its downbeat, from least classes on."""
    out, last = [], ""
    for number, first, second, downbeat in bars:
        start, half, added = number * bpb, number * bpb + bpb / 2, 0
        for candidate, place in ((first, start), (second, half)):
            if candidate and added < most and candidate[1] >= clear and candidate[2] and candidate[2] != last:
                off = min(abs(candidate[0] - start), abs(candidate[0] - half)) > 0.3
                last = candidate[2]
                out.append((candidate[0] if off else place, last))
                added += 1
        if not added and downbeat and downbeat[0] >= least and downbeat[1] and downbeat[1] != last:
            last = downbeat[1]
            out.append((start, last))
    return out


def chords_per_bar(notes: DataFrame, bpb: int = 4) -> DataFrame:
    """At most two chords a bar, where the symbol changes. Which one counts depends on the last, so a track's bars are folded;
    a bar is one row by then."""
    bpb = max(bpb, 2)
    found = bar_candidates(notes, bpb).withColumn("bar", F.floor(F.col("half") / 2).cast("int"))
    place = F.struct("found_at", "n_pcs", "symbol")
    halves = found.groupBy("track_id", "bar").agg(F.max(F.when(F.col("half") % 2 == 0, place)).alias("first"), F.max(F.when(F.col("half") % 2 == 1, place)).alias("second"))
    grid = halves.select("track_id", (F.col("bar") * float(bpb)).alias("beat"), "bar")
    down = symbols(sounding_at(grid.select("track_id", "beat"), notes)).select("track_id", (F.col("beat") / bpb).cast("int").alias("bar"), F.struct("n_pcs", "symbol").alias("down"))
    rows = halves.join(down, ["track_id", "bar"], "left")
    flat = rows.select("track_id", "bar", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c, fields in (("first", PLACE), ("second", PLACE), ("down", ("n_pcs", "symbol"))) for f in fields))

    def fold(track, rows: list[tuple]):
        some = lambda values: None if values[-2] is None else values
        bars = [(r[0], some(r[1:4]), some(r[4:7]), some(r[7:9])) for r in sorted(rows, key=lambda r: r[0])]
        return [(track, b, s) for b, s in bar_choices(bars, float(bpb))]

    return fold_tracks(flat, fold, "track_id bigint, beat double, symbol string")

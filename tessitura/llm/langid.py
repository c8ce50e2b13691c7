"""Language identification by word-first backoff.

Words are runs of letters, lower case. A known word scores its smoothed log frequency in each language; a word unseen in
training backs off to the longest character n-grams (from max_n down to 1, with word edges) of which any is known, and
scores their mean log frequency. A document takes the language with the highest sum and prior; its score is that
language's posterior.

Defined cases: null text or a text without a letter gives ``und`` and score 0; no training row gives ``und`` for all; ties
go to the language that sorts first; rows of null language are not learned from; repeated rows stay; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, rows_of, utf8

LETTERS = re.compile(r"[^\W\d_]+")


def words_in(piece: bytes) -> list[str]:
    return LETTERS.findall(piece.decode("utf-8", "replace").lower())


def grams_in(word: str, n: int) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def fit(documents: DataFrame, rows_per_language: int = 1000, max_bytes: int = 100_000, max_n: int = 5) -> dict:
    """Log frequencies from at most about rows_per_language rows of each language, none longer than max_bytes (the documented
    bound of the fit). Every word and n-gram of the sample counts: the model's size is bounded by the sample's.

    The counts are made and summed on the executors; the driver gets one row for each entry."""
    known = documents.where(F.col("lang").isNotNull())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    model = {"langs": langs, "rows": {}, "table": np.zeros((0, len(langs)), np.float32), "prior": np.log([totals[x] / sum(totals.values()) for x in langs]), "max_n": max_n}
    if not langs:
        return model
    share = F.lit(0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, rows_per_language / n) * (1 << 40)))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < share).select("lang", utf8().alias("text")).where(F.length("text").between(1, max_bytes))

    def count(batches):
        for batch in batches:
            tally: dict[str, Counter] = {}
            for lang, text in zip(*rows_of(batch, "lang", "text"), strict=True):
                tally.setdefault(lang, Counter()).update(words_in(text))
            rows = []
            for lang, words in tally.items():
                grams: Counter = Counter()
                for w, c in words.items():
                    for n in range(1, max_n + 1):
                        for g in grams_in(w, n):
                            grams[g] += c
                rows += [(lang, 0, w, c) for w, c in words.items()] + [(lang, len(g), g, c) for g, c in grams.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "entry", "c"])

    counts = sample.mapInArrow(count, "lang string, n int, entry string, c bigint")
    of_each = [F.sum(F.when(F.col("lang") == lang, F.col("c")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(langs)]
    found = counts.groupBy("n", "entry").agg(*of_each).toArrow()
    n, entries = found["n"].to_numpy(), found["entry"].to_pylist()
    c = np.column_stack([found[f"c{i}"].to_numpy() for i in range(len(langs))]).astype(np.float64)
    size = np.array([c[n == k].sum(0) for k in range(max_n + 1)]).reshape(max_n + 1, len(langs))
    # a word has its own mark, so that one table serves words and n-grams
    model["rows"] = {(e if k else " " + e): i for i, (k, e) in enumerate(zip(n.tolist(), entries, strict=True))}
    model["table"] = np.log((c + 0.5) / (size[n] + 1)).astype(np.float32)
    return model


def evidence_rows(word: str, model: dict) -> list[int]:
    """The table's rows whose mean is the word's score: its own, or those of the longest known n-grams."""
    rows = model["rows"]
    if (own := rows.get(" " + word)) is not None:
        return [own]
    edged = f"^{word}$"
    for n in range(min(model["max_n"], len(edged)), 0, -1):
        known = [r for i in range(len(edged) - n + 1) if (r := rows.get(edged[i : i + n])) is not None]
        if known:
            return known
    return []


class PieceScores(dict):
    """piece between white space -> row of a growing matrix: each language's log score, and 1 if it has a letter."""

    def __init__(self, model: dict, floats: int = 4_000_000):
        super().__init__()
        self.model, self.width = model, len(model["langs"]) + 1
        self.limit = max(1000, floats // self.width)
        self.rows = np.zeros((1024, self.width), np.float32)

    def __missing__(self, piece: bytes) -> int:
        at = len(self)
        if at >= len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        row, table = self.rows[at], self.model["table"]
        row[:] = 0  # it may be left from before the memo was cleared
        for w in words_in(piece):
            row[-1] = 1
            if known := evidence_rows(w, self.model):
                row[:-1] += table[known[0]] if len(known) == 1 else table[known].sum(0) / np.float32(len(known))
        self[piece] = at
        return at

    def total(self, text: bytes, step: int = 50_000) -> np.ndarray:
        pieces, out = text.split(), np.zeros(self.width)
        for i in range(0, len(pieces), step):
            if len(self) > self.limit:
                self.clear()
            part = pieces[i : i + step]
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))  # may grow the matrix
            out += self.rows[at].sum(0, dtype=np.float64)
        return out


def decide(total: np.ndarray | None, model: dict) -> tuple[str, float]:
    """The language of the highest sum with its prior, and its posterior; und without a letter."""
    if total is None or not total[-1]:
        return "und", 0.0
    z = total[:-1] + model["prior"]
    p, best = np.exp(z - z.max()), int(np.argmax(z))
    return model["langs"][best], float(p[best] / p.sum())


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out fold column if present, lang_pred and score of each row, from the whole text alone."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the fit's sample
    keep = [c for c in documents.columns if c in ("doc_id", "held_out")]

    def predict(batches):
        m = shared.value
        memo = PieceScores(m)
        for batch in batches:
            found = [decide(memo.total(t) if t and m["langs"] else None, m) for t in rows_of(batch, "text")[0]]
            arrays = [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *arrays], [*keep, "lang_pred", "score"])

    kinds = dict(documents.dtypes)
    return documents.select(*keep, utf8().alias("text")).mapInArrow(predict, ", ".join([f"{c} {kinds[c]}" for c in keep] + ["lang_pred string", "score double"]))


def language_id(documents: DataFrame, mod: int = 5, held: int = 0, **bounds) -> DataFrame:
    """Learn outside the held-out fold, predict every row."""
    model = fit(documents.select("doc_id", "text", "lang").where(fold(mod) != held), **bounds)
    return identify(documents.select("doc_id", (fold(mod) == held).alias("held_out"), "text"), model)

"""Toxicity by multiple-instance learning.

A sentence's probability is a logistic of the weights of what its words show (whole words and parts of them); a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents are labelled: the weights are fitted by descending the documents' log loss through the
noisy-or. The sentences whose own probability reaches the threshold are located by their byte offsets.

A sentence of a document of n sentences has log odds lower by log(1 + n / 20), in the fit and in scores alike, so that a text
does not become toxic by its length: however many sentences without evidence are joined, they score at most 0.05 together.

Defined cases: null or empty text has no sentence and scores 0; without labelled rows of both classes every score is 0;
rows of null id are scored and belong to the fold of the empty id; repeated rows stay; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fold, labelled_sample, rows_of, utf8
from .memory import lean

SENTENCE = re.compile(rb"[^.!?\r\n]+")
TRIM = re.compile(r"^\W+|\W+$")
WORDS = 100_000  # that a task remembers, and as many older ones
FEW = 20  # sentences; from about so many on, each counts in proportion to the document
SPANS = "array<struct<start: bigint, stop: bigint, probability: double>>"


def normal(word: bytes) -> str:
    """The form in which a word is counted: lower case, without punctuation at its ends."""
    return TRIM.sub("", word.decode("utf-8", "replace").lower())


def features(word: bytes) -> tuple[str, ...]:
    """What a word shows: its form, and the form's beginnings and inner n-grams, so that inflected and new words count."""
    form = normal(word)
    if not form:
        return ()
    edged = f"^{form}$"
    return tuple({form, *(edged[:n] for n in range(4, 8)), *(edged[i : i + n] for n in (4, 5) for i in range(1, len(edged) - n + 1))})


def fit(documents: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, per_class: int = 2000, max_bytes: int = 20_000, max_features: int = 20_000, steps: int = 150, rate: float = 0.3, ridge: float = 3e-4) -> dict | None:
    """Feature weights and bias from at most about per_class labelled rows of each class (a documented bound of the fit).

    The features are those that toxic documents show significantly more often, max_features at most."""
    rows = labelled_sample(documents, labels, "toxic", mod, [held], per_class, max_bytes).orderBy("doc_id", "text").collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    shown = Memo(features, 20_000)  # a word shows about a kilobyte of strings
    seen: tuple[dict, dict] = ({}, {})
    for r in rows:
        count = seen[r["label"]]
        for f in {f for w in set(bytes(r["text"]).split()) for f in shown[w]}:
            count[f] = count.get(f, 0) + 1
    n1, n0 = y.sum(), (1 - y).sum()
    z = {}
    for f, c in seen[1].items():
        rest = seen[0].get(f, 0)
        p = (c + rest) / (n1 + n0)
        if c >= 3 and p < 1 and (v := (c / n1 - rest / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))) > 2.5:
            z[f] = v
    vocabulary = {f: i for i, f in enumerate(sorted(sorted(z, key=lambda f: (-z[f], f))[:max_features]))}
    known = Memo(lambda w: tuple(vocabulary[f] for f in shown[w] if f in vocabulary))
    ids, lengths, doc_of = array("i"), array("i"), array("i")
    for i, r in enumerate(rows):
        for s in SENTENCE.findall(bytes(r["text"])):
            before = len(ids)
            for w in s.split():
                ids.extend(known[w])
            lengths.append(len(ids) - before)
            doc_of.append(i)
    if not ids:
        return None
    sentence_of = np.repeat(np.arange(len(doc_of), dtype=np.int32), np.asarray(lengths))
    w, b = _descend(np.asarray(ids), sentence_of, np.asarray(doc_of), y, len(vocabulary), steps, rate, ridge)
    return {"weights": {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 0.01}, "bias": float(b)}


def _descend(ids, sentence_of, doc_of, y, n_words, steps, rate, ridge) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss of the noisy-or, from a bias at which clean sentences hardly count."""
    theta = np.zeros(n_words + 1)
    theta[-1] = -6.0
    share = np.log1p(np.bincount(doc_of, minlength=len(y)) / FEW)[doc_of]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n_docs, n_sentences = len(y), len(doc_of)
    for t in range(1, steps + 1):
        s = np.bincount(sentence_of, theta[ids], n_sentences) + theta[-1] - share
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        clean = np.bincount(doc_of, -np.logaddexp(0, s), n_docs)  # log of prod(1 - p)
        slope = np.where(y == 1, -1 / np.expm1(np.clip(-clean, 1e-9, 700)), 1.0) / n_docs  # of the loss by -log prod(1 - p)
        ds = p * slope[doc_of]
        grad = np.append(np.bincount(ids, ds[sentence_of], n_words), ds.sum())
        grad[:-1] += ridge * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        theta[-1] = min(theta[-1], -6.0)  # a sentence without evidence stays clean, however many there are
    return theta[:-1], theta[-1]


def score_text(text: bytes | None, weights: dict, bias: float, at: float) -> tuple[float, list[dict]]:
    """Noisy-or over the whole text's sentences, and those whose own probability, whatever the others, is at or more."""
    found = [(m, sum(map(weights.__getitem__, m[0].split()))) for m in SENTENCE.finditer(text or b"")]
    share, clean, spans = bias - math.log1p(len(found) / FEW), 0.0, []
    for m, evidence in found:
        s = evidence + share
        clean += s + math.log1p(math.exp(-s)) if s > 0 else math.log1p(math.exp(s))
        if evidence + bias > -30 and (p := 1 / (1 + math.exp(-evidence - bias))) >= at:
            spans.append({"start": m.start(), "stop": m.end(), "probability": p})
    return -math.expm1(-clean), spans


def score_toxicity(documents: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.7, sentence_threshold: float = 0.5, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences' spans of each row, from the whole text alone."""
    model = fit(documents, labels, mod, held, **bounds)
    kinds = "doc_id bigint, held_out boolean, score double, predicted int, sentences " + SPANS
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most max_features weights

    @lean
    def score(batches):
        m = shared.value
        weights = m and Memo(lambda w: sum(m["weights"].get(f, 0.0) for f in features(w)), WORDS)
        for batch in batches:
            found = [score_text(t, weights, m["bias"], sentence_threshold) if m else (0.0, []) for t in rows_of(batch, "text")[0]]
            ids, held_out = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            yield pa.RecordBatch.from_arrays(
                [ids, held_out, pa.array([p for p, _ in found], pa.float64()), pa.array([int(p >= threshold) for p, _ in found], pa.int32()), pa.array([s for _, s in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])))],
                ["doc_id", "held_out", "score", "predicted", "sentences"],
            )

    return documents.select("doc_id", (fold(mod) == held).alias("held_out"), utf8().alias("text")).mapInArrow(score, kinds)


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """documents without the rows that score threshold or more: the verdict travels with the row, so nothing is joined."""
    model = fit(documents, labels, **bounds)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @lean
    def keep(batches):
        m = shared.value
        weights = m and Memo(lambda w: sum(m["weights"].get(f, 0.0) for f in features(w)), WORDS)
        for batch in batches:
            mask = [not m or score_text(None if t is None else t.encode(), weights, m["bias"], 2.0)[0] < threshold for t in rows_of(batch, "text")[0]]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)

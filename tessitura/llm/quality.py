"""Compression classifier for quality.

Two zstandard dictionaries are trained, one from good and one from bad labelled texts. A text is compressed in blocks with
each; the difference of the two sizes over the plain bytes is the evidence, and a logistic curve, fitted on labelled
rows that built neither dictionary, turns it into a score.

Defined cases: null or empty text has no evidence and scores the curve's value at 0; without labelled rows of both classes
every score is 0.5; rows of null id are scored and belong to the fold of the empty id; repeated rows stay; an empty table
gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, rows_of, utf8


class Sizes:
    """Evidence of texts: (bytes with the bad dictionary - bytes with the good one) / plain bytes."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.block = block
        self.zips = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=level)
            self.zips.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def evidence(self, text: bytes | None) -> float:
        if not text:
            return 0.0
        g = b = 0
        for i in range(0, len(text), self.block):
            part = text[i : i + self.block]
            g += len(self.zips[0].compress(part))
            b += len(self.zips[1].compress(part))
        return (b - g) / len(text)


def spread_blocks(text: bytes, block: int, most: int) -> list[bytes]:
    """At most so many blocks of a text, evenly spread from its beginning to its end."""
    n = -(-len(text) // block)
    at = range(n) if n <= most else [i * (n - 1) // (most - 1) for i in range(most)]
    return [text[i * block : (i + 1) * block] for i in at]


def fit(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, per_class: int = 1500, max_bytes: int = 60_000, dict_bytes: int = 65_536, block: int = 2048, blocks_each: int = 8, level: int = 1) -> dict | None:
    """Dictionaries and curve from at most about per_class labelled rows of each class, none longer than max_bytes, and
    blocks_each blocks of a text, spread over the whole of it (the documented bounds of the fit)."""
    rows = labelled_sample(documents, labels, "quality", mod, [held], per_class, max_bytes).orderBy("doc_id", "text").collect()
    parts = {0: [], 1: []}
    for r in rows:
        parts[r["label"]].append(bytes(r["text"]))
    if min(map(len, parts.values())) < 4:
        return None
    dicts, rest = [], []
    for label in (1, 0):
        texts = parts[label]
        build, check = texts[::2], texts[1::2]
        rest += [(t, label) for t in check]
        blocks = [part for t in build for part in spread_blocks(t, block, blocks_each)]  # long texts must not fill a dictionary alone
        try:
            dicts.append(zstandard.train_dictionary(dict_bytes, blocks).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: its raw bytes serve as the dictionary
            dicts.append(b"".join(blocks)[-dict_bytes:])
    sizes = Sizes(dicts[0], dicts[1], block, level)
    x = np.array([sizes.evidence(t) for t, _ in rest])
    y = np.array([label for _, label in rest], float)
    scale = float(x.std()) or 1.0
    # classes were sampled alike; weights bring back their true shares
    n = {r["quality"]: r["n"] for r in labels.where(fold(mod) != held).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, n.get(1, 1) / max(1, y.sum()), n.get(0, 1) / max(1, (1 - y).sum()))
    a, b = _logistic(x / scale, y, weight / weight.mean())
    return {"good": dicts[0], "bad": dicts[1], "slope": a / scale, "bias": b, "block": block, "level": level}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias by Newton's method with a small ridge on the slope."""
    X, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        grad = X.T @ (w * (p - y)) + ridge * np.array([beta[0], 0])
        hess = (X * (w * p * (1 - p))[:, None]).T @ X + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_quality(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.3, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of each row, from the whole text alone."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit(documents, labels, mod, held, **bounds))  # two dictionaries of dict_bytes

    def score(batches):
        m = shared.value
        sizes = m and Sizes(m["good"], m["bad"], m["block"], m["level"])
        for batch in batches:
            found = [sizes.evidence(t) if m else 0.0 for t in rows_of(batch, "text")[0]]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, m["slope"] * e + m["bias"])))) if m else 0.5 for e in found]
            ids, held_out = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            yield pa.RecordBatch.from_arrays([ids, held_out, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, pa.float64())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return documents.select("doc_id", (fold(mod) == held).alias("held_out"), utf8().alias("text")).mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int, evidence double")

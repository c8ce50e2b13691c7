"""Target-distribution importance resampling with hashed word features, in DataFrame functions alone.

A document's features are its words; a feature's bucket is the crc32 of its bytes modulo ``buckets``. Each bucket has a gain:
how much more frequent it is in the target texts than in the documents, as a scaled logarithm rounded down. A document's
weight is the sum of gains over its features, its score adds a Gumbel value drawn from a hash of its id, and the documents of
the highest scores are drawn: a sample without replacement, with probabilities in proportion to exp(weight / 1000).

Bucket arrays are made by higher-order functions, and a weight is an aggregate over element_at of a literal array of gains, so
scoring makes no row a word. Counting explodes buckets inside a task and sums them there: at most ``buckets`` rows a task reach
the shuffle. The order of all documents comes from one dealing into ranges of scores, written with each range's number; ranks
are places within a range plus the rows of the ranges before it.

Defined cases: null and empty texts have no features and weight 0; a null id counts as the empty text in the hash, and its rows
come last among equal scores; rows that repeat an id are documents of their own, with equal scores in any order among
themselves; an empty table gives no rows, and without target texts all target counts are 0; further columns are ignored; a very
long text is one array of its words' buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text="text", width: int = 1):
    """Lower-cased words of a text, or runs of width consecutive words joined by a space; none for null."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(lowered, NO_WORD), "")
    if width == 1:
        return words

    def runs(ws):  # a lambda's variable: the text is split once, not for each run
        starts = F.when(F.size(ws) >= width, F.sequence(F.lit(1), F.size(ws) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, width), " "))

    return F.transform(F.array(words), runs)[0]


def buckets_of(text="text", buckets: int = 10_000, longest: int = 1):
    """The bucket of every feature of a text, runs of 1 to longest words, repeats included."""
    features = words_of(text)
    for width in range(2, longest + 1):
        features = F.concat(features, words_of(text, width))
    return F.transform(features, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def bucket_totals(texts: DataFrame, buckets: int, longest: int = 1) -> dict[int, int]:
    """Features by bucket over all rows of texts (text); the driver gets at most one number a bucket."""
    features = [words_of("text", width) for width in range(1, longest + 1)]
    words = texts.select(F.explode(features[0] if longest == 1 else F.concat(*features)).alias("word"))
    counted = words.select((F.crc32(F.col("word").cast("binary")) % buckets).cast("int").alias("bucket")).groupBy("bucket").count()
    return {r["bucket"]: r["count"] for r in counted.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """A gain for each bucket: floor(1000 * ln of the ratio of smoothed shares)."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def literal_array(values: list[int]):
    """A foldable array column: Catalyst turns it into one literal of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def draw_value(doc_id="doc_id", seed: int = 2024):
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def score_documents(documents: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 2024, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of documents (doc_id, text) against target (text)."""
    table = gains(bucket_totals(documents, buckets, longest), bucket_totals(target, buckets, longest), buckets)
    own = documents.select("doc_id", buckets_of("text", buckets, longest).alias("features"), *([] if longest == 1 else [F.size(words_of()).alias("n_words")]))
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal_array(table), b + 1))
    return own.select(
        "doc_id", (F.size("features") if longest == 1 else F.col("n_words")).cast("long").alias("n_words"), F.size("features").cast("long").alias("n_features"), weight.alias("weight"), draw_value("doc_id", seed).alias("draw"),
    ).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("draw")).alias("score"))


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in the order of these columns, without a task that holds them all.

    rows are dealt into ranges of the order and written with the range's number; the driver gets one count a range. Rows equal
    in all order columns lie in one range, so the order should tell rows apart. Ranges are found by a first look at rows: what is
    costly to compute should have been written before."""
    part, place, before = unused(rows.columns, "part", "place", "before")
    placed = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    starts, total = [], 0
    for number, n in sorted((r[part], r["count"]) for r in placed.groupBy(part).count().collect()):
        starts.append((number, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    within = placed.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return within.join(F.broadcast(first), part).withColumn(name, (F.col(place) + F.col(before)).cast("long")).drop(part, place, before)


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, seed: int = 2024, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of documents.

    Of the N documents with at least least_words words, the floor(percent * N / 100) of the highest scores are drawn and ranked
    from 1, ties by smaller id; the rank of all others is null."""
    scored = materialize(score_documents(documents, target, buckets, seed, longest).withColumn("fit", F.col("n_words") >= least_words), "scored")
    drawn = percent * scored.where("fit").count() // 100
    placed = ranked(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))

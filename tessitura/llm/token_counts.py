"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens) in a folder the caller names. A text's digest is the SHA-256
of its UTF-8 form with null as the empty text; the tokenizer's digest is that of its vocabulary file. Normalisation stops
there, as anything more could change the count. A call joins the digests to the cache, encodes each digest that misses
once, appends those counts, and joins all counts to the rows.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows stay repeated; a null id is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, scratch

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens bigint"
_loaded: dict[str, object] = {}


def _counter(path: str):
    """texts -> counts, by the library that the file's ending names; one model a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(documents: DataFrame, tokenizer: str, cache: str, limit: int = 4096, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents; cache names the cache table's folder.

    Only new digests move their text: one row for each digest and map task reaches the shuffle (first() is combined
    before it), so a text that a third of all rows repeat costs one row a task."""
    spark, version = documents.sparkSession, tokenizer_digest(tokenizer)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    _ensure(spark, cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)

    def encode(batches):
        count = _counter(tokenizer)
        for batch in batches:
            digests, texts = rows_of(batch, "digest", "text")
            out, at = [], 0
            while at < len(texts):  # slices bound what the encoder holds at once
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= slice_bytes):
                    size += len(texts[end])
                    end += 1
                out += count([t.decode() for t in texts[at:end]])
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([version] * len(out)), pa.array(out, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("digest").distinct(), "digest", "left_anti")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "digest", F.length("text").cast("long").alias("n_bytes")).join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _ensure(spark, cache: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)


def new_cache(spark) -> str:
    return scratch(spark, "token-cache")

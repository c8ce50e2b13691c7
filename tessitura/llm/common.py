"""What the corpus operators share: scratch tables, crc32 folds, bounded label samples, word memos."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build, hits
from .memory import lean


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Unset, a session in one process gets a
    folder of its own machine; on a cluster that is an error, as executors could not read each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessitura-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write df as Parquet. Its shuffle files go as soon as it is written: nothing reads them afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The scratch tables of one operator: written by name, deleted when no later step reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, scratch(spark, name), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back; a table of the same name before it stays until drop(name)."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        write(df, path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, latest: bool = True) -> None:
        """Delete the tables of these names; without latest, the last one written stays."""
        for name in names:
            paths = self.paths.get(name, [])
            for path in paths if latest else paths[:-1]:
                delete(self.spark, path)
            self.paths[name] = [] if latest else paths[-1:]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until none clashes (in any case of letters) with a column."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def text_key(column: str = "text"):
    """A hash of the text that tells rows of one id apart; rows equal in id and text are told nothing by either."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.col(column).isNull())


def without_rows(documents: DataFrame, gone: DataFrame, few: int = 10_000, filter_bytes: int = 64 << 20) -> DataFrame:
    """documents without the rows whose id and text_key() are in gone (doc_id, text_key); a null id is a value like others.

    Up to few rows are broadcast. More are joined by sorting, with the rows alone that a Bloom filter of them has: no other
    row's text is shuffled."""
    gone = materialize(gone.distinct(), "gone").toDF("id_", "key_")
    own, key, mark = unused([*documents.columns, *gone.columns], "row_id", "row_hash", "row_mark")
    marked = documents.withColumn(own, F.col("doc_id").cast("long")).withColumn(key, text_key())

    def unmet(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone, rows[own].eqNullSafe(gone["id_"]) & (rows[key] == gone["key_"]), "left_anti").select(*documents.columns)

    if gone.count() <= few:
        return unmet(marked, F.broadcast(gone))
    shared = documents.sparkSession.sparkContext.broadcast(build(gone.select(F.xxhash64("id_", "key_").alias("mark")), filter_bytes))
    marked = marked.withColumn(mark, F.xxhash64(own, key))

    def having(met: bool, *columns: str) -> DataFrame:
        @lean
        def run(batches):
            for b in batches:
                marks = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                found = b.select(list(range(b.num_columns - 1))).filter(pa.array(hits(shared.value, marks) == met))
                if len(found):
                    yield found

        rows = marked.select(*columns)
        return marked.select(*columns, mark).mapInArrow(run, rows.schema)

    return having(False, *documents.columns).union(unmet(having(True, *documents.columns, own, key), gone))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Arrow batches are bounded by bytes as well: rows are kilobytes on average, and megabytes at times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(mod: int, doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo mod (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def utf8(column: str = "text"):
    return F.col(column).cast("binary")


def sampled_ids(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most about per_class ids of each class, by the order of a hash of the id: (doc_id, label).

    The ids come from the labels alone, so that no text moves before the sample is chosen."""
    clean = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) < F.lit(int(min(1.0, per_class / n) * (1 << 40)))))
    return clean.where(keep)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: list[int], per_class: int, max_bytes: int) -> DataFrame:
    """(text BINARY, label) of the sampled rows outside the held-out folds; texts over max_bytes stay out of the fit."""
    ids = sampled_ids(labels.select("doc_id", label).where(~fold(mod).isin(held)), label, per_class)
    return (
        documents.select("doc_id", utf8().alias("text"))
        .where(F.length("text").between(1, max_bytes))
        .join(F.broadcast(ids), "doc_id")  # at most about 2 * per_class ids
        .select("doc_id", "text", "label")
    )


class Memo(dict):
    """A bounded word table: what compute(word) gives, kept for at most 2 * limit words (a young and an old half)."""

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordHash:
    """64-bit hashes of all words of a text at once, without a step for each word.

    A word's hash is a polynomial of its bytes, each mapped to a random number, modulo 2**64, mixed. The sums of
    byte * base**place over the text give those of each word as differences, times the inverse base to the word's place."""

    def __init__(self, seed: int = 0, piece: int = 1 << 18):
        rng = np.random.default_rng([seed, 77])
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.piece = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5, piece
        self.power, self.inverse = (np.ones(1, np.uint64) for _ in range(2))
        self._grow(2 * piece)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                factors = np.full(n, base % (1 << 64), np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def __call__(self, text: bytes | None, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words of a text: runs of bytes other than the six white-space bytes of ASCII.

        edges: by byte, whether it counts for nothing at either end of a word; a word of nothing else is empty and has hash 0."""
        data = np.frombuffer(text or b"", np.uint8)
        space = np.concatenate([[True], _SPACE[data], [True]])
        bounds = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = bounds[::2], bounds[1::2]
        if edges is not None and len(starts):
            core = np.flatnonzero(~(edges[data] | _SPACE[data]))
            at, behind = core.searchsorted(starts), core.searchsorted(ends)
            some, core = at < behind, np.append(core, len(data))
            starts, ends = np.where(some, core[at], starts), np.where(some, core[behind - 1] + 1, starts)
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):  # whole words, in pieces of bounded size unless a word is longer
            last = max(first + 1, int(ends.searchsorted(starts[first] + self.piece, "right")))
            low, high = int(starts[first]), int(ends[last - 1])
            self._grow(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.value[data[low:high]] * self.power[: high - low], out=sums[1:])
            a = starts[first:last] - low
            out[first:last] = (sums[ends[first:last] - low] - sums[a]) * self.inverse[a]
            first = last
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
        return out, starts, ends


def rows_of(batch, *names):
    """The named columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def slices_of(texts: list, most_bytes: int):
    """(start, stop) of runs of texts with about most_bytes together, so that what a task holds at once doesn't follow the batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 64
        if size >= most_bytes or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0

"""Substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words of a document; each word that lies in a window which also starts in a document of smaller
id is removed. A window's fingerprint is the least hash of its word 6-grams: equal windows have equal fingerprints, and
neighbours mostly share one, so a document has about two for nine words. Documents come in batches of rising ids:

1. Run. Each slice of a map task (4 MB of text) writes its sorted fingerprints with their owners, the run of the batch.
2. Merge. The batch's fingerprints are dealt by range and merge-joined with the sorted, immutable tables of all earlier
   batches; those that occur in another document too are shared. The batch's become a new table, and when there are max_runs
   tables they are compacted into one.
3. Windows. The shared fingerprints go into a Bloom filter of a fixed largest size; false hits cost work, never results. The
   runs tell which earlier documents own one; only these are read again, and windows at shared fingerprints of the batch
   and of these owners are hashed whole and dealt by hash. Equal windows of a slice are settled there: only the smallest id's
   go on, so a passage that a third of all rows share costs one entry a slice. Equality is verified: the 32-bit check beside
   the 64-bit hash comes from another hash function of the words.
4. Removal. The rows meet the runs of positions they lose in a join; texts stream through the task that cuts them.

The index lies in a folder and opens again with all its runs, so a later batch needs only what it brings and the owners it
meets. Nothing holds a text but the batch a task reads; groups of fingerprints and windows are sized by bytes of text.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r. Defined cases: null text has no words; rows of null id own
nothing and keep everything; repeated rows are equal in id and remove nothing from each other; an empty table gives no
rows; further columns, whatever their names, are ignored, or kept where documents are returned.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import build, hits
from .common import Scratch, WordHash, delete, materialize, rows_of, slices_of, text_key, unused, write
from .memory import lean

WINDOW, GRAM = 13, 6
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def rolled(h: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """A mixed polynomial hash of each run of width word hashes."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        out *= odd
        out += h[j : j + len(out)]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def window_anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least 6-gram hash in it, its lowest bit cleared."""
    m = rolled(h, GRAM, _ODD[0]) & ~np.uint64(1)
    for step in (1, 2, 4):  # least of 8 neighbours
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
    return m


def _steps(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _runs(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Id, key, first and number of consecutive positions."""
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    if not len(keys):
        return ids, keys, pos, pos
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (pos[1:] > pos[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    return ids[first], keys[first], pos[first], pos[last] - pos[first] + 1


def _slices(sorted_values: np.ndarray, parts: int):
    """(part, slice) of sorted 64-bit values, dealt to parts by equal ranges."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(sorted_values, bounds), [len(sorted_values)]])
    return [(i, slice(at[i], at[i + 1])) for i in range(parts) if at[i] < at[i + 1]]


def _packed(*arrays: np.ndarray) -> list[bytes]:
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


_TABLE = "bucket int, anchors binary, kind string"
_OWNERS = "anchors binary, row binary, ids binary"


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a folder that outlives the session.

    For each batch a table of (bucket, sorted fingerprints), and one of the slices' fingerprints with their owners. A table
    from-to stands for the batches from..to; one that another covers is left from a compaction and is ignored."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, max_runs: int = 4):
        self.spark, self.root, self.max_runs = spark, root, max_runs
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        done = {n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))}
        spans = [(n, *map(int, n.split("-")[1:3])) for n in sorted(done) if n.startswith("table-")]
        self.tables = [n for n, a, z in spans if not any((b, y) != (a, z) and b <= a and z <= y for _, b, y in spans)]
        self.made = max((z + 1 for _, _, z in spans), default=0)
        if "meta" in done:
            buckets = spark.read.parquet(f"{root}/meta").first()["buckets"]
        else:
            write(spark.createDataFrame([(buckets,)], "buckets int"), f"{root}/meta")
        self.buckets = buckets

    def owners(self) -> DataFrame | None:
        """The runs of all batches so far."""
        paths = [f"{self.root}/owners-{i:06d}" for i in range(self.made)]
        return self.spark.read.schema(_OWNERS).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        paths = [f"{self.root}/{n}" for n in self.tables]
        return self.spark.read.schema(_TABLE).parquet(*paths).where(F.col("kind") == "run").withColumn("kind", F.lit(1)) if paths else None

    def append(self, documents: DataFrame) -> DataFrame:
        """Write a batch of documents (id, text) as a run, merge-join it with all earlier ones, and give the shared fingerprints."""
        run = f"{self.root}/owners-{self.made:06d}"
        write(owner_rows(documents), run, "overwrite")  # what a failed run left goes
        rows = bucket_rows(self.spark.read.schema(_OWNERS).parquet(run), self.buckets).withColumn("kind", F.lit(0))
        if (past := self.read()) is not None:
            rows = rows.unionByName(past)
        name = f"table-{self.made:06d}-{self.made:06d}"
        write(rows.groupBy("bucket").applyInArrow(_merge_bucket, _TABLE), f"{self.root}/{name}", "overwrite")
        self.tables.append(name)
        self.made += 1
        return self.spark.read.schema(_TABLE).parquet(f"{self.root}/{name}").where(F.col("kind") == "shared").drop("kind")

    def compact(self) -> None:
        """Merge all tables into one; the old ones go."""
        if len(self.tables) > 1:
            name, old = f"table-{0:06d}-{self.made - 1:06d}", self.tables
            write(self.read().select("bucket", "anchors").groupBy("bucket").applyInArrow(_compact_bucket, _TABLE), f"{self.root}/{name}")
            self.tables = [name]
            for n in old:
                delete(self.spark, f"{self.root}/{n}")


def _blobs(table: pa.Table, kind: int | None = None) -> list[np.ndarray]:
    kinds = table["kind"].to_pylist() if kind is not None else [None] * len(table)
    return [np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64) for b, k in zip(table["anchors"].to_pylist(), kinds, strict=True) if k == kind]


def _merge_bucket(table: pa.Table) -> pa.Table:
    bucket, one = table["bucket"][0].as_py(), np.uint64(1)
    fresh = np.sort(np.concatenate([*_blobs(table, 0), np.zeros(0, np.uint64)]))
    values, first = np.unique(fresh & ~one, return_index=True)
    ends = np.append(first[1:], len(fresh))
    shared = (ends - first > 1) | (fresh[np.maximum(ends - 1, 0)] & one == one) if len(values) else np.zeros(0, bool)
    for run in _blobs(table, 1):
        at = np.minimum(np.searchsorted(run, values), max(0, len(run) - 1))
        shared |= run[at] == values if len(run) else False
    return pa.table({"bucket": pa.array([bucket] * 2, pa.int32()), "anchors": pa.array(_packed(_deltas(values), _deltas(values[shared])), pa.binary()), "kind": pa.array(["run", "shared"])})


def _compact_bucket(table: pa.Table) -> pa.Table:
    merged = np.unique(np.concatenate(_blobs(table)))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "anchors": pa.array(_packed(_deltas(merged)), pa.binary()), "kind": pa.array(["run"])})


def owner_rows(documents: DataFrame) -> DataFrame:
    """For each slice of a task its fingerprints, sorted, the row in the slice that each occurs in, and the rows' ids."""

    @lean
    def run(batches):
        words = WordHash()
        for b in batches:
            ids, texts = rows_of(b, "__id", "text")
            for start, stop in slices_of(texts, 4 << 20):
                anchors = (window_anchors(words(t)[0]) for t in texts[start:stop])
                found = [np.unique(a[_steps(a)]) for a in anchors]
                row = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
                values = np.concatenate(found)
                order = np.argsort(values, kind="stable")
                if len(values):
                    packed = _packed(_deltas(values[order]), row[order], np.array(ids[start:stop], np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["anchors", "row", "ids"])

    return documents.select("__id", "text").mapInArrow(run, _OWNERS)


def bucket_rows(owners: DataFrame, buckets: int) -> DataFrame:
    """(bucket, anchors): the fingerprints of each slice, once each; the lowest bit says that two of the slice's rows have it."""

    @lean
    def run(batches):
        for b in batches:
            for blob in rows_of(b, "anchors")[0]:
                values, counts = np.unique(np.cumsum(_unpacked(blob, np.uint64), dtype=np.uint64), return_counts=True)
                values |= (counts > 1).astype(np.uint64)
                rows = [(i, *_packed(_deltas(values[s]))) for i, s in _slices(values, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["bucket", "anchors"])

    return owners.select("anchors").mapInArrow(run, "bucket int, anchors binary")


def owners_of(owners: DataFrame, bloom: np.ndarray) -> DataFrame:
    """(id) of the documents of these runs that own a fingerprint which the filter has."""
    shared = owners.sparkSession.sparkContext.broadcast(bloom)  # at most max_bytes

    @lean
    def run(batches):
        for b in batches:
            for anchors, row, ids in zip(*rows_of(b, "anchors", "row", "ids"), strict=True):
                met = hits(shared.value, np.cumsum(_unpacked(anchors, np.uint64), dtype=np.uint64))
                own = np.unique(_unpacked(ids, np.int64)[np.unique(_unpacked(row, np.uint32)[met])])
                yield pa.RecordBatch.from_arrays([pa.array(own)], ["id"])

    return owners.mapInArrow(run, "id bigint").distinct()


def anchor_values(blobs: DataFrame) -> DataFrame:
    """The anchors of a table of blobs, one a row."""

    @lean
    def run(batches):
        for b in batches:
            for blob in rows_of(b, "anchors")[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_unpacked(blob, np.uint64), dtype=np.uint64).view(np.int64))], ["value"])

    return blobs.mapInArrow(run, "value bigint")


def _repeats(win, chk, ids):
    """The order by window and id; for each entry in it, whether a smaller id has its window."""
    order = np.lexsort((ids, chk, win))
    win, chk, ids = win[order], chk[order], ids[order]
    starts = np.concatenate([[True], (win[1:] != win[:-1]) | (chk[1:] != chk[:-1])]) if len(win) else np.zeros(0, bool)
    least = ids[starts][np.cumsum(starts) - 1] if len(win) else ids
    return order, ids > least


_WINDOWS = "bucket int, win binary, chk binary, row binary, pos binary, ids binary, keys binary, new binary, done boolean"
_REMOVALS = "id bigint, key bigint, start bigint, n bigint"


def _wanted(batches, met: np.ndarray | None):
    """The rows that are new or whose id the filter has, in batches of some 4 MB where few are."""
    held, size = [], 0
    for b in batches:
        if met is not None:
            new, ids = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__new", "__id"))
            b = b.filter(pa.array(new | hits(met, ids.astype(np.int64).view(np.uint64))))
        held.append(b)
        size += b.nbytes
        if size >= 4 << 20:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def window_rows(rows: DataFrame, bloom: np.ndarray, buckets: int, met: np.ndarray | None = None) -> DataFrame:
    """Windows at shared anchors, for each slice of a task: those that a smaller id of the slice repeats are marked done.

    met: a filter of the earlier documents that count; it is asked here, as a step of its own would be a second Python worker for
    each task, with its own memory."""
    context = rows.sparkSession.sparkContext
    shared, owners = context.broadcast(bloom), None if met is None else context.broadcast(met)  # at most max_bytes each

    @lean
    def run(batches):
        number, hashes, checks = 0, WordHash(), WordHash(1)
        for b in _wanted(batches, owners and owners.value):
            columns = rows_of(b, "__id", "__key", "__new", "text")
            for start, stop in slices_of(columns[3], 4 << 20):
                number += 1
                if out := settle_slice(number, hashes, checks, *(c[start:stop] for c in columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 7, pa.bool_()), strict=True)], [c.split()[0] for c in _WINDOWS.split(", ")])

    def settle_slice(number, hashes, checks, ids, keys, new, texts):
        bits = shared.value
        wins, chks, poss, whose = [], [], [], []
        for i, text in enumerate(texts):
            h = hashes(text)[0]
            anchors = window_anchors(h)
            first = _steps(anchors)  # neighbours mostly share an anchor
            at = np.flatnonzero(np.repeat(hits(bits, anchors[first]), np.diff(np.append(first, len(anchors)))))
            if len(at):
                wins.append(rolled(h, WINDOW, _ODD[1])[at])
                chks.append((rolled(checks(text)[0], WINDOW, _ODD[2])[at] >> np.uint64(32)).astype(np.uint32))
                poss.append(at.astype(np.uint32))
                whose.append(np.full(len(at), i, np.uint32))
        if not wins:
            return []
        win, chk, pos, row = map(np.concatenate, (wins, chks, poss, whose))
        ids, keys, new = np.array(ids, np.int64), np.array(keys, np.int64), np.array(new, bool)
        order, again = _repeats(win, chk, ids[row])
        win, chk, pos, row = win[order], chk[order], pos[order], row[order]
        out, go, ends = [], np.flatnonzero(~again), again & new[row]
        for i, part in _slices(win[go], buckets):  # they are sorted; a passage's windows go to many buckets
            s = go[part]
            used, local = np.unique(row[s], return_inverse=True)
            out.append((i, *_packed(_deltas(win[s]), chk[s], local.astype(np.uint32), pos[s], ids[used], keys[used], new[used]), False))
        if ends.any():
            used, local = np.unique(row[ends], return_inverse=True)
            empty = _packed(np.zeros(0, np.uint64), np.zeros(0, np.uint32))
            out.append(((int(keys[used[0]]) + number) % buckets, *empty, *_packed(local.astype(np.uint32), pos[ends], ids[used], keys[used], new[used]), True))
        return out

    return rows.mapInArrow(run, _WINDOWS)


def removals(windows: DataFrame) -> DataFrame:
    """Runs of window positions to remove: (__key, start, n)."""

    def settle(table: pa.Table) -> pa.Table:
        parts = [[_unpacked(x, k) for x, k in zip(r, (np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.int64, bool), strict=True)] for r in zip(*(table[c].to_pylist() for c in ("win", "chk", "row", "pos", "ids", "keys", "new")), strict=True)]
        done = table["done"].to_pylist()
        gone = [(p[4][p[2]], p[5][p[2]], p[3]) for p, d in zip(parts, done, strict=True) if d]
        if open_ := [p for p, d in zip(parts, done, strict=True) if not d]:
            win = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in open_])
            chk, pos = (np.concatenate([p[i] for p in open_]) for i in (1, 3))
            ids, keys, new = (np.concatenate([p[i][p[2]] for p in open_]) for i in (4, 5, 6))
            order, again = _repeats(win, chk, ids)
            take = order[again & new[order]]
            gone.append((ids[take], keys[take], pos[take]))
        ids, keys, pos = (np.concatenate([g[i] for g in gone] + [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        return pa.table([pa.array(c) for c in _runs(ids, keys, pos)], names=["id", "key", "start", "n"])

    return windows.groupBy("bucket").applyInArrow(settle, _REMOVALS)


def _covered(starts: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Which words the windows of these runs cover."""
    cover = np.bincount(starts, minlength=words + 1) - np.bincount(np.minimum(starts + n - 1 + WINDOW, words), minlength=words + 1)
    return np.cumsum(cover[:-1]) > 0


def _kept(words: list[bytes], starts: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """The words that no window of these runs covers, joined by one space, and how many went."""
    if not len(starts):
        return b" ".join(words), 0
    stay = ~_covered(starts, n, len(words))
    return b" ".join(compress(words, stay.tolist())), len(words) - int(stay.sum())


def repeats(documents: DataFrame, root: str | None = None, batches: int = 2, max_runs: int = 2, filter_bytes: int = 64 << 20, bucket_bytes: int = 64 << 20) -> DataFrame:
    """(id, key, start, n): runs of windows that a document of smaller id has; key is text_key().

    batches: into how many runs of rising ids the table is dealt, as if they had come one after another."""
    spark = documents.sparkSession
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), text_key().alias("__key"), F.col("text").cast("binary").alias("text"))
    keep = Scratch(spark, "repeats")
    known = rows.agg(F.sum(F.length("text")).alias("size"), F.percentile_approx("__id", [i / batches for i in range(1, batches)] or [1.0], 1000).alias("q")).first()
    index = FingerprintIndex(spark, root or f"{keep.root}/index", max(64, -(-(known["size"] or 0) // bucket_bytes)), max_runs)
    bounds = [None, *(sorted(set(known["q"] or [])) if batches > 1 else []), None]
    found: DataFrame | None = None
    for lo, hi in zip(bounds, bounds[1:]):  # a handful of batches, each a job of its own
        fresh = rows if hi is None else rows.where(F.col("__id") <= hi)
        fresh = fresh if lo is None else fresh.where(F.col("__id") > lo)
        past, met = index.owners(), None
        bloom = build(keep.keep(anchor_values(index.append(fresh)), "shared"), filter_bytes)  # written, so that no task runs two Python workers
        marked = fresh.withColumn("__new", F.lit(True))
        if past is not None:
            met = build(keep.keep(owners_of(past, bloom), "owners"), filter_bytes)
            marked = marked.unionByName((rows.where(F.col("__id") <= lo) if lo is not None else rows).withColumn("__new", F.lit(False)))
        part = materialize(removals(window_rows(marked, bloom, index.buckets, met)), "removals")
        found = part if found is None else found.unionByName(part)
        keep.drop("shared", "owners")
        if len(index.tables) >= max_runs:
            index.compact()
    if root is None:
        delete(spark, index.root)  # nobody opens it again
    return found


def _with_runs(documents: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """documents with the runs that each row loses (null where it loses none), and that column's name: a join of runs to rows."""
    own, key, runs = unused(documents.columns, "row_id", "row_key", "row_runs")
    lost = materialize(found.groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias(runs)).withColumnsRenamed({"id": own, "key": key}), "lost")
    marked = documents.withColumn(own, F.col("doc_id").cast("long")).withColumn(key, text_key())
    return marked.join(lost, [own, key], "left").select(*documents.columns, runs), runs


def _cover(text: str | None, runs: list[dict] | None) -> tuple[int, int, bytes]:
    """How many words a text has, how many go, and what stays."""
    words = text.encode().split() if text else []
    kept, gone = _kept(words, np.array([r["start"] for r in runs or ()], np.int64), np.array([r["n"] for r in runs or ()], np.int64))
    return len(words), gone, kept


def remove_repeats(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space, as bytes) of each row of documents."""
    marked, runs = _with_runs(documents.select("doc_id", "text"), repeats(documents, **options))

    @lean
    def run(batches):
        for b in batches:
            words, gone, kept = zip(*map(_cover, *rows_of(b, "text", runs)), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept binary")


def cut_repeats(documents: DataFrame, **options) -> DataFrame:
    """documents, the texts without their repeats; a text that loses none keeps its form. A column n_chars follows the text."""
    marked, runs = _with_runs(documents, repeats(documents, **options))
    types = {f.name: f.dataType for f in documents.schema.fields}

    @lean
    def run(batches):
        for b in batches:
            texts, lost = rows_of(b, "text", runs)
            cut = [(i, _cover(t, r)[2].decode()) for i, (t, r) in enumerate(zip(texts, lost, strict=True)) if r]
            b = b.drop_columns([runs])
            for name, of in (("text", lambda t: t), ("n_chars", len)):
                if name in types and cut:
                    at = b.schema.get_field_index(name)
                    values = b.column(at).to_pylist()
                    for i, t in cut:
                        values[i] = of(t)
                    b = b.set_column(at, b.schema.field(at), pa.array(values, b.column(at).type))
            yield b

    return marked.mapInArrow(run, documents.schema)

"""Ranked lexical search over a written index of compressed posting blocks, by Block-Max WAND.

An index is a Parquet table of shards, each the documents that one task met together. A row holds one term's postings in a
shard, in blocks of 128: each block's first and last document, its largest impact, and its place in the bytes, which hold gaps
and counts as variable-length integers. One row a shard, without a term, holds its documents' ids and lengths. Documents never
move between shards, so a term that every document has is split as the documents are.

A search reads the rows of its items' terms and ranks each shard on its own. Pointers stand at the first document a term may
still hold. Terms in the order of their pointers are added up by their largest impact until the sum can reach the twentieth
score so far: that is the pivot, and no document before it can enter. From the pivot on, block pointers move by their borders
alone (shallow) over up to 2048 documents; where the largest impacts of the blocks that lie over a document can't reach that score,
it is skipped, and blocks that lie only over such documents are never decompressed. Each shard's best rows are then merged by
item.

A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 75 + 25 * n * N div L, an occurrence count tf gives
10**9 * tf div (1000 * tf + 12 * m), and a score sums weight times that over the item's terms, repeats included.

Defined cases: null and empty texts have no terms and are never found; a null doc_id comes last among equal scores; rows that
repeat a doc_id are documents of their own, and equal scores of one id have ranks in any order; rows that repeat an item's id
and text count once, and rows of one id with several texts are one item with all their terms; a null item id is an id like
others; items without a term that a document holds have no rows; empty tables give no rows; further columns are ignored; a very
long text is one document of one shard, whose bytes bound its postings.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write
from .resampling import words_of

BLOCK = 128
INDEX_SCHEMA = "shard bigint, term binary, n bigint, first array<int>, last array<int>, top array<bigint>, place array<int>, data binary"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))  # lower case; what is no term is a space


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative integers, seven bits each, the last byte of a value below 128; and where each value begins."""
    sizes = np.ones(len(values), "int64")
    for bits in (7, 14, 21, 28, 35, 42, 49, 56):
        more = values >> bits > 0
        if not more.any():
            break
        sizes += more
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), "uint8")
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[begins[has] + k] = values[has] >> 7 * k & 127 | np.where(sizes[has] > k + 1, 128, 0)
    return out, begins


def from_varint(data: np.ndarray) -> np.ndarray:
    if not len(data) or data.max() < 128:
        return data.astype("int64")
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    within = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data & 127).astype("int64") << 7 * within, begins)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class ShardWriter:
    """Collects documents and gives the rows of their shard."""

    def __init__(self, n_docs: int, total: int):
        self.n_docs, self.total = n_docs, total
        self.clear()

    def clear(self) -> None:
        self.vocabulary = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids, self.lengths, self.sizes, self.terms, self.counts, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        words = text.translate(_FOLD).split()
        if not words:
            return
        found = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(found))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), "int32", len(found)))
        self.counts.append(np.fromiter(found.values(), "int32", len(found)))
        self.bytes += len(text)

    def rows(self, shard: int) -> list[pa.RecordBatch]:
        """The shard's document row, then its terms in order. Documents are numbered by rising length, as those of a length have
        like impacts, which makes the largest impact of a block say more."""
        if not self.ids:
            return []
        order = sorted(range(len(self.ids)), key=lambda i: (self.lengths[i], self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(len(order), "int64")
        number[order] = np.arange(len(order))
        m = np.array([75 + 25 * self.lengths[i] * self.n_docs // self.total for i in order], "int64")
        ids = np.array([-1 if self.ids[i] is None else self.ids[i] for i in order], "int64")
        known = np.array([self.ids[i] is not None for i in order])
        names = sorted(self.vocabulary)
        sorted_place = np.empty(len(names), "int64")
        sorted_place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term, doc, tf = sorted_place[np.concatenate(self.terms)], np.repeat(number, self.sizes), np.concatenate(self.counts).astype("int64")
        by = np.argsort(term * len(order) + doc)
        term, doc, tf = term[by], doc[by], tf[by]
        df = np.bincount(term, minlength=len(names))
        blocks = -(-df // BLOCK)
        block_term = np.repeat(np.arange(len(names)), blocks)
        nth = np.arange(len(block_term)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = (np.cumsum(df) - df)[block_term] + nth * BLOCK
        sizes = np.minimum(df[block_term] - nth * BLOCK, BLOCK)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0  # the first document of a block stands outside
        at = np.arange(len(doc)) - np.repeat(starts, sizes) + 2 * np.repeat(starts, sizes)
        values = np.empty(2 * len(doc), "int64")
        values[at], values[at + np.repeat(sizes, sizes)] = gaps, tf
        data, begins = varint(values)
        block_place = begins[2 * starts]
        term_first = np.concatenate([[0], np.cumsum(blocks)])
        term_place = np.append(block_place[term_first[:-1]], len(data))
        lists = [doc[starts].astype("int32"), doc[starts + sizes - 1].astype("int32"), np.maximum.reduceat(impacts(tf, m[doc]), starts), (block_place - term_place[block_term]).astype("int32")]
        head = pa.RecordBatch.from_pylist([{"shard": shard, "term": None, "n": len(ids), "first": None, "last": None, "top": None, "place": None, "data": np.concatenate([ids, m, known]).astype("<i8").tobytes()}], schema=_ARROW)
        return [head, *_term_rows(shard, names, df, term_first, lists, data, term_place)]


_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("top", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("data", pa.binary())])


def _term_rows(shard, names, df, term_first, lists, data, term_place, at_once: int = 20_000):
    for low in range(0, len(names), at_once):
        high = min(low + at_once, len(names))
        cut = term_first[low : high + 1]
        nested = [pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype("int32")), pa.array(values[cut[0] : cut[-1]])) for values in lists]
        places = term_place[low : high + 1]
        held = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((places - places[0]).astype("int32")), pa.py_buffer(data[places[0] : places[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(high - low, shard)), pa.array(names[low:high], pa.binary()), pa.array(df[low:high]), *nested, held], schema=_ARROW)


def build_index(documents: DataFrame, folder: str, shard_bytes: int = 16 << 20) -> str:
    """Write the index of documents (doc_id, text) to folder: one pass for N and L, one narrow pass for the shards.

    A shard is about shard_bytes of text, which bounds what a task holds: some ten times that."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def sizes(batches):
        for batch in batches:
            n = [len(t.translate(_FOLD).split()) for t in batch.column(0).to_pylist() if t]
            yield pa.RecordBatch.from_pydict({"docs": [sum(x > 0 for x in n)], "words": [sum(n)]})

    n_docs, total = rows.select("text").mapInArrow(sizes, "docs bigint, words bigint").agg(F.sum("docs"), F.sum("words")).first()

    def shards(batches):
        writer, made, part = ShardWriter(n_docs, total), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                writer.add(doc_id, texts[i].as_py() or b"")
                if writer.bytes >= shard_bytes:
                    yield from writer.rows(part << 32 | made)
                    writer.clear()
                    made += 1
        yield from writer.rows(part << 32 | made)

    write(rows.mapInArrow(shards, INDEX_SCHEMA), folder)
    return folder


class Term:
    """One term's postings in a shard; blocks are decompressed when asked for, and kept while the shard is searched."""

    __slots__ = ("first", "last", "top", "most", "place", "data", "m", "open")

    def __init__(self, first, last, top, place, data, m):
        self.first, self.last, self.top, self.most, self.place, self.data, self.m, self.open = first, last, top, int(top.max()), place, data, m, {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block b."""
        if b not in self.open:
            end = self.place[b + 1] if b + 1 < len(self.place) else len(self.data)
            values = from_varint(np.frombuffer(self.data, "uint8", end - self.place[b], self.place[b]))
            half = len(values) // 2
            docs = self.first[b] + np.cumsum(values[:half])
            self.open[b] = docs, impacts(values[half:], self.m[docs])
        return self.open[b]


class Pointer:
    """An item's place in a term: the block it stands in and the first document it may still hold."""

    __slots__ = ("term", "factor", "most", "block", "at")

    def __init__(self, term: Term, factor: int):
        self.term, self.factor, self.most, self.block, self.at = term, factor, term.most * factor, 0, int(term.first[0])

    def shallow(self, doc: int) -> bool:
        """Move to the block that may hold doc or later ones, by last documents alone; False behind the last block."""
        last = self.term.last
        if last[self.block] < doc:
            self.block += int(last[self.block :].searchsorted(doc))
            if self.block == len(last):
                return False
        self.at = max(doc, int(self.term.first[self.block]))
        return True


def best_documents(pointers: list[Pointer], k: int, id_order: np.ndarray, most_span: int = 2048) -> list[tuple[int, int]]:
    """The k highest (score, document) of one shard by Block-Max WAND, equal scores by id_order[document].

    Pointers move over spans of documents, so that the work on blocks is done on arrays; the first span is short, as nothing
    is skipped before there are k documents."""
    heap: list[tuple[int, int, int]] = []  # (score, -id_order, document), the worst first
    needed, span = 1, BLOCK
    while pointers:
        pointers.sort(key=_at)
        total = 0
        for p in pointers:
            total += p.most
            if total >= needed:
                break
        else:
            break  # all terms together can't reach the score needed
        low, high, span = p.at, p.at + span, min(2 * span, most_span)
        pointers = [p for p in pointers if p.at >= low or p.shallow(low)]
        _window([p for p in pointers if p.at < high], low, high, heap, k, needed, id_order)
        if len(heap) == k:
            needed = heap[0][0]
        pointers = [p for p in pointers if p.at >= high or p.shallow(high)]
    return [(s, d) for s, _, d in sorted(heap, reverse=True)]


def _at(pointer: Pointer) -> int:
    return pointer.at


def _window(here: list[Pointer], low: int, high: int, heap: list, k: int, needed: int, id_order: np.ndarray) -> None:
    """Score documents low to high - 1 where the blocks' largest impacts, added up, reach the score needed.

    The sums come from the blocks' borders alone; a block that lies in no such place stays compressed."""
    spans = [(p, p.block, p.block + int(p.term.first[p.block :].searchsorted(high))) for p in here]
    first = np.maximum(np.concatenate([p.term.first[a:b] for p, a, b in spans]), low) - low
    behind = np.minimum(np.concatenate([p.term.last[a:b] for p, a, b in spans]) + 1, high) - low
    top = np.concatenate([p.term.top[a:b] * p.factor for p, a, b in spans])
    bound = np.zeros(high - low + 1, "int64")
    np.add.at(bound, first, top)
    np.subtract.at(bound, behind, top)
    alive = np.cumsum(bound)[:-1] >= needed
    before = np.concatenate([[0], np.cumsum(alive)])
    opened = (before[behind] > before[first]).tolist()
    if not any(opened):
        return
    scores, n = np.zeros(high - low, "int64"), 0
    for p, a, b in spans:
        for block in range(a, b):
            if opened[n]:
                docs, gains = p.term.block(block)
                if docs[0] < low or docs[-1] >= high:
                    x, y = docs.searchsorted((low, high))
                    docs, gains = docs[x:y], gains[x:y]
                scores[docs - low] += p.factor * gains
            n += 1
    found = np.flatnonzero((scores >= needed) & alive)
    if len(found) > k:
        found = found[np.lexsort((id_order[low + found], -scores[found]))[:k]]
    for i in found.tolist():
        entry = (int(scores[i]), -int(id_order[low + i]), low + i)
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def search(index: str, items: DataFrame, k: int = 20, block_terms: int = 500_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) in the index.

    Items are taken in blocks of about block_terms terms, which are what the driver and each task hold of them. A block reads
    the index rows of its terms, by shard."""
    spark = items.sparkSession
    rows = spark.read.schema(INDEX_SCHEMA).parquet(index)
    n_docs = rows.where("term is null").agg(F.sum("n")).first()[0] or 0
    unique = items.select("item_id", "text").dropDuplicates().select("item_id", F.explode(words_of()).alias("word"))
    terms = unique.groupBy("item_id", F.col("word").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    blocks = max(1, -(-terms.count() // block_terms))
    own_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = dict(items.dtypes)["item_id"]
    parts = []
    for n in range(blocks):
        asked = [(r["item_id"], bytes(r["term"]), r["times"]) for r in terms.where(own_block == n).collect()]
        if asked and n_docs:
            parts.append(_search_block(spark, rows, asked, n_docs, k, kind))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, rows: DataFrame, asked: list, n_docs: int, k: int, kind: str) -> DataFrame:
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in {t for _, t, _ in asked}], "term binary"))
    held = rows.where("term is not null").join(wanted, "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in held.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    by_item = defaultdict(list)
    for item, term, times in asked:
        if weight.get(term, 0) > 0:
            by_item[item].append((term, times * weight[term]))
    queries = list(by_item.items())
    item_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def ranked(shard: pa.Table) -> pa.Table:
        ids, m, id_order, terms = _open_shard(shard)
        items, docs, scores = [], [], []
        for item, query in queries:
            for score, doc in best_documents([Pointer(terms[t], f) for t, f in query if t in terms], k, id_order):
                items.append(item)
                docs.append(ids[doc])
                scores.append(score)
        return pa.table({"item_id": pa.array(items, item_type), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return held.union(rows.where("term is null").select(held.columns)).groupBy("shard").applyInArrow(ranked, f"item_id {kind}, doc_id bigint, score bigint")


def _open_shard(shard: pa.Table):
    """The shard's document ids, their m, the order of the ids, and its terms."""
    shard = shard.combine_chunks()
    names, data = shard.column("term").to_pylist(), shard.column("data").to_pylist()
    head = names.index(None)
    known_ids, m, known = np.frombuffer(data[head], "<i8").reshape(3, -1)
    ids = [d if k else None for d, k in zip(known_ids.tolist(), known.tolist())]
    id_order = np.empty(len(ids), "int64")
    id_order[np.lexsort((known_ids, 1 - known))] = np.arange(len(ids))
    lists = {c: shard.column(c).chunk(0) for c in ("first", "last", "top", "place")}
    offsets = lists["first"].offsets.to_numpy()
    values = {c: v.values.to_numpy(zero_copy_only=False).astype("int64") for c, v in lists.items()}
    terms = {}
    for i, name in enumerate(names):
        if name is not None:
            a, b = offsets[i], offsets[i + 1]
            terms[name] = Term(values["first"][a:b], values["last"][a:b], values["top"][a:b], values["place"][a:b].tolist(), data[i], m)
    return ids, m, id_order, terms

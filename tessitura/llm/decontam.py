"""Benchmark decontamination by latent semantic retrieval.

1. Passage statistics: one scan counts, over all documents, in how many 32-word passages each hashed word occurs.
2. A randomised SVD of the TF-IDF passages of all documents and items, in one scan (Nyström): each task multiplies its passages
   with a sparse random start and back; the driver takes the factors of a matrix of fixed size. Nothing is sampled.
3. Search: every whole text is projected in blocks of 4 words. The windows of an item's length that begin at a block (for
   items of 32 words and more at every other one) are compared with the item's vector; all of cosine min_cosine or more are
   candidates, and no number of them is cut off. The
   projection is whitened, so that a language's common words don't dominate.
4. Check: the longest common subsequence of the item's words and the words around the window. Coverage of verbatim or more
   is a leak; from paraphrase on it is one if the answer occurs there as well: the words of the column answer, or without
   such a column at least two of the item's three rarest words.

The documents are fitted and encoded once, whatever the number of items; the items' vectors are broadcast in blocks of at
most items_each. Words are runs of bytes other than ASCII white space, A-Z in lower case, without ASCII punctuation at their
ends, compared by hashes of 32 bits. Defined cases: null or empty texts and items have no words and match nothing; rows of
null id are searched and returned with their null; repeated rows are found repeatedly; empty tables give no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, materialize, rows_of, slices_of, text_key, without_rows
from .memory import lean

BLOCK, PASSAGE, SHORT, LONGEST = 4, 32, 32, 128  # words of a block, of a passage, of the longest short item, and of the longest window
_HALL = 4096  # places of the small table that tells which words an item lacks
EDGES = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))  # they count for nothing at a word's ends
EMPTY = 0  # the hash of a word of nothing else


@cache
def _forms() -> WordHash:
    return WordHash(9)


def word_hashes(text: bytes | None) -> np.ndarray:
    """32 bits of each word's form: lower case, without punctuation at its ends."""
    return (_forms()(text.lower() if text else b"", EDGES)[0] & np.uint64(0xFFFFFFFF)).astype("<u4")


def buckets_of(hashes: np.ndarray, dims: int) -> np.ndarray:
    return (hashes & np.uint32(dims - 1)).astype(np.int64)


ENCODED = "doc_id bigint, text_key bigint, words binary"


def encode_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, words): each whole text once, as its words' hashes, compressed.

    All later passes over the corpus read this table, a quarter of the texts' size."""

    @lean
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = [z.compress(word_hashes(text).tobytes()) for text in rows_of(b, "text")[0]]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text_key")), pa.array(out, pa.binary())], ["doc_id", "text_key", "words"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, ENCODED), "encoded")


def decoded(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<u4")


def passages_of(ids: list[np.ndarray], fill: int) -> np.ndarray:
    """Texts' buckets as rows of PASSAGE words; a text's last row ends with fill."""
    first = np.concatenate([[0], np.cumsum([-(-len(x) // PASSAGE) for x in ids])])
    rows = np.full((first[-1], PASSAGE), fill, np.int32)
    for i, x in enumerate(ids):
        rows.reshape(-1)[first[i] * PASSAGE : first[i] * PASSAGE + len(x)] = x
    return rows


def passage_frequencies(encoded: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many passages each bucket occurs, and how many passages there are; from all documents."""

    @lean
    def run(batches):
        total, passages = np.zeros(dims, np.int64), 0
        for b in batches:
            blobs = rows_of(b, "words")[0]
            for start, stop in slices_of(blobs, 1 << 20):
                rows = passages_of([buckets_of(decoded(x), dims) for x in blobs[start:stop]], -1)
                rows.sort(axis=1)
                fresh = rows >= 0
                fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                total += np.bincount(rows[fresh], minlength=dims)
                passages += len(rows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], passages))], ["bucket", "n"])

    counts = encoded.select("words").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, passages = np.zeros(dims), 0
    for r in counts.collect():  # dims + 1 rows at most
        if r["bucket"] < 0:
            passages = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, passages


def _times(words: DataFrame, group: np.ndarray, sign: np.ndarray, idf: np.ndarray, width: int, blocks: int = 32, tasks: int = 16) -> np.ndarray:
    """A'A times a start that has sign at a bucket's group, A being all TF-IDF passages in unit length: partial products by task, summed
    by blocks of buckets.

    A passage's words meet its words: each pair adds one number to one place. The partial products are of fixed size, and so is
    their number, twice the cores or tasks."""
    dims, spark = len(idf), words.sparkSession
    shared, step = spark.sparkContext.broadcast((group, sign, idf)), dims // blocks

    @lean
    def run(batches):
        group, sign, idf = shared.value
        weight = np.append(idf, 0).astype(np.float32)  # the place behind the last bucket fills a text's last passage
        signed, square, column = np.append(sign * idf, 0).astype(np.float32), weight**2, np.append(group, 0).astype(np.int64)
        out = None
        for b in batches:
            blobs = rows_of(b, "words")[0]
            for start, stop in slices_of(blobs, 1 << 19):
                rows = passages_of([buckets_of(decoded(x), dims) for x in blobs[start:stop]], dims)
                out = np.zeros((dims + 1) * width) if out is None else out
                for a in range(0, len(rows), 256):
                    p = rows[a : a + 256].astype(np.int64)
                    scale = 1 / np.maximum(square[p].sum(1), 1e-12)
                    places = (p * width)[:, :, None] + column[p][:, None, :]
                    np.add.at(out, places.ravel(), ((weight[p] * scale[:, None])[:, :, None] * signed[p][:, None, :]).ravel().astype(np.float64))
        if out is not None:  # a task without passages adds nothing
            made = out[: dims * width].astype(np.float32).reshape(blocks, step * width)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in made], pa.binary())], ["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step * width)
        for x in table["part"]:
            total += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((dims, width))
    parts = words.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "block int, part binary")
    for r in parts.groupBy("block").applyInArrow(add, "block int, part binary").toLocalIterator():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["part"]).reshape(step, width)
    return out


def latent_projection(words: DataFrame, idf: np.ndarray, rank: int, over: int = 16, seed: int = 5) -> np.ndarray:
    """Whitened right singular vectors (buckets x rank) of all passages of words, by the Nyström method from a sparse random start."""
    rng, dims, width = np.random.default_rng(seed), len(idf), rank + over
    group, sign = rng.integers(0, width, dims), rng.choice([-1.0, 1.0], dims)
    product = _times(words, group, sign, idf, width)
    shift = 1e-7 * float(np.linalg.norm(product))
    product[np.arange(dims), group] += shift * sign  # a little of the unit matrix, so that the core has an inverse
    core = np.zeros((width, width))
    np.add.at(core, group, sign[:, None] * product)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = product @ (vectors / np.sqrt(np.maximum(values, 1e-12 * max(float(values[-1]), 1e-30))))
    squares, turn = np.linalg.eigh(half.T @ half)
    best = np.argsort(squares)[::-1][:rank]
    scale = np.sqrt(np.maximum(squares[best] - shift, 1e-9 + 1e-6 * max(float(squares[best[0]]), 0.0)))
    return (half @ (turn[:, best] / (np.sqrt(np.maximum(squares[best], 1e-300)) * scale))).astype(np.float32)


def lcs(bits: list[int], n: int) -> int:
    """Length of the longest common subsequence of n words and a text, given for each word of the text that is among them by
    the bits of its places: bit-parallel."""
    row = full = (1 << n) - 1
    for m in bits:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Items:
    """A block of benchmark items made ready for search: vectors by width of the window, words as bits, answers."""

    def __init__(self, rows: list[tuple], table: np.ndarray, idf: np.ndarray):
        dims, empty = len(idf), EMPTY
        self.ids, self.vocabulary, self.bits, self.many, self.sizes, self.answers = [], [], [], [], [], []
        vectors: dict[int, list] = {}  # by blocks of the window
        self.of_width: dict[int, list[int]] = {}
        for item, text, answer in rows:
            h = word_hashes(text)
            words = h[h != empty].tolist()
            if not words:
                continue
            masks: dict[int, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | (1 << i)
            step = BLOCK if len(h) <= SHORT else 2 * BLOCK  # the windows of longer items begin and end at every other block
            width = -(-min(len(h), LONGEST) // step) * step // BLOCK
            for a in sorted({*range(0, max(1, len(h) - LONGEST + 1), LONGEST), max(0, len(h) - LONGEST)}):  # a long item is several queries
                v = table[buckets_of(h[a : a + LONGEST], dims)].sum(0)
                vectors.setdefault(width, []).append(v / max(float(np.linalg.norm(v)), 1e-12))
                self.of_width.setdefault(width, []).append(len(self.ids))
            own = [w for w in word_hashes(answer).tolist() if w != empty] if answer else []
            rare = sorted(set(words), key=lambda w: (-idf[w & (dims - 1)], w))[:3]
            self.answers.append((set(own), len(set(own))) if own else (set(rare), min(2, len(rare))))
            self.ids.append(item)
            self.sizes.append(len(words))
            self.vocabulary.append(np.array(sorted(masks), np.uint32))
            self.bits.append([masks[w] for w in sorted(masks)])
            self.many.append(np.array([masks[w].bit_count() for w in sorted(masks)]))
        self.vectors = {w: np.array(v, np.float32) for w, v in vectors.items()}
        self.has = np.zeros((len(self.ids), _HALL), np.uint8)  # how often a word of this place occurs in the item
        for k, v in enumerate(self.vocabulary):
            self.has[k] = np.minimum(np.bincount(v % _HALL, self.many[k], _HALL), 255)

    def common(self, k: int, around: np.ndarray, least: float) -> int:
        """The item's longest common subsequence with some words; 0 where it cannot reach least."""
        v = self.vocabulary[k]
        at = np.minimum(np.searchsorted(v, around), len(v) - 1)
        at = at[v[at] == around]
        if np.minimum(np.bincount(at, minlength=len(v)), self.many[k]).sum() < least:
            return 0
        bits = self.bits[k]
        return lcs([bits[i] for i in at.tolist()], self.sizes[k])


def candidates(texts: list[np.ndarray], table: np.ndarray, items: Items, min_cosine: float, items_each: int = 512) -> tuple[np.ndarray, ...]:
    """text, item, first word, end, cosine of the windows of at least min_cosine, among all windows of all texts, sorted.

    table has a last row of zeros, which fills each text's last blocks. A window ends with its text."""
    dims, lengths = len(table) - 1, np.array([len(x) for x in texts], np.int64)
    n_blocks = -(-lengths // (2 * BLOCK)) * 2
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    total = int(first[-1])
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none, np.zeros(0, np.float32))]
    flat = np.full(total * BLOCK, dims, np.int64)
    for i, x in enumerate(texts):
        flat[first[i] * BLOCK : first[i] * BLOCK + len(x)] = buckets_of(x, dims)
    sums = np.zeros((total + 1, table.shape[1]), np.float32)
    for a in range(0, total, 1024):  # what is gathered at once stays in the processor's cache
        part = flat[a * BLOCK : (a + 1024) * BLOCK].reshape(-1, BLOCK)
        for j in range(BLOCK):
            sums[a + 1 : a + 1025] += table[part[:, j]]
    np.cumsum(sums, axis=0, out=sums)
    text_of = np.repeat(np.arange(len(texts)), n_blocks)
    buffer = np.empty((total, table.shape[1]), np.float32)
    for width, vectors in items.vectors.items() if total else ():
        step = 1 if width * BLOCK <= SHORT else 2
        at = np.arange(0, total, step)
        windows = buffer[: len(at)]
        whole = len(range(0, total + 1 - width, step))
        np.subtract(sums[width::step][:whole], sums[: max(0, total + 1 - width) : step], out=windows[:whole])
        ends = first[1:][text_of[at]]
        short = np.flatnonzero(at + width > ends)  # these end with their text
        windows[short] = sums[ends[short]] - sums[at[short]]
        least = min_cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)
        for j in range(0, len(vectors), items_each):
            dots = windows @ vectors[j : j + items_each].T
            b, k = np.divmod(np.flatnonzero(dots >= least[:, None]), dots.shape[1])
            text = text_of[at[b]]
            start = (at[b] - first[text]) * BLOCK
            real = start < lengths[text]
            found.append(tuple(c[real] for c in (text, np.array(items.of_width[width], np.int64)[j + k], start, np.minimum(start + width * BLOCK, lengths[text]), dots[b, k] / least[b] * min_cosine)))
    text, item, start, end, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((start, item, text))
    return text[order], item[order], start[order], end[order], cosine[order]


def leaks_in(texts: list[np.ndarray], table: np.ndarray, items: Items, min_cosine: float, verbatim: float, paraphrase: float) -> list[tuple]:
    """(which text, item, first word, cosine, coverage, kind) of the leaks in some texts, given by their words' hashes.

    Candidates that touch are looked at together first: most of them don't have enough of the item's words."""
    text, item, start, end, cosine = candidates(texts, table, items, min_cosine)
    if not len(text):
        return []
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])]))
    last = np.append(new[1:], len(text)) - 1
    sizes, lengths = np.array(items.sizes, np.int64)[item[new]], np.array([len(x) for x in texts], np.int64)
    lo, hi = np.maximum(0, start[new] - sizes), np.minimum(end[last] + sizes, lengths[text[new]])
    # how many words of each region are the item's, as far as the small table tells: all of them, then each as often as in the item
    offset, n = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), (hi - lo).astype(np.int32)
    small, times, best = np.concatenate(texts) % _HALL, items.has.ravel(), {}
    small = small.astype(np.int32)
    for a in range(0, len(new), 4096):
        part = slice(a, a + 4096)
        m, ends = n[part], np.cumsum(n[part], dtype=np.int32)
        place = np.arange(int(ends[-1]), dtype=np.int32)
        place += np.repeat(offset[text[new[part]]] + lo[part].astype(np.int32) - (ends - m), m)
        slot = small.take(place)
        slot += np.repeat((item[new[part]] * _HALL).astype(np.int32), m)
        held = times.take(slot)
        need = paraphrase * sizes[part]
        enough = np.add.reduceat(held > 0, ends - m, dtype=np.int32) >= need
        hit = np.flatnonzero((held > 0) & np.repeat(enough, m))
        key, often = np.unique(np.searchsorted(ends, hit, "right") * np.int64(len(times)) + slot[hit], return_counts=True)
        shown = np.bincount(key // len(times), np.minimum(often, times[key % len(times)]), len(m))
        for g in (a + np.flatnonzero(shown >= need)).tolist():
            _look(best, texts, items, int(text[new[g]]), int(item[new[g]]), int(lo[g]), int(hi[g]), list(zip(*(c[new[g] : last[g] + 1].tolist() for c in (start, end, cosine)), strict=True)), verbatim, paraphrase)
    return [best[k] for k in sorted(best)]


def _look(best: dict, texts: list[np.ndarray], items: Items, i: int, item: int, lo: int, hi: int, windows: list[tuple], verbatim: float, paraphrase: float) -> None:
    """Check an item's candidates in one region of a text, from the highest cosine on; best keeps the greatest coverage."""
    n, words = items.sizes[item], texts[i]
    if items.common(item, words[lo:hi], paraphrase * n) < paraphrase * n:
        return
    answer, least = items.answers[item]
    for s, e, cosine in sorted(windows, key=lambda w: (-w[2], w[0])):
        around = words[max(0, s - n) : e + n]
        coverage = items.common(item, around, paraphrase * n) / n
        kind = "verbatim" if coverage >= verbatim else "paraphrase" if coverage >= paraphrase and len(answer.intersection(around.tolist())) >= least else None
        if kind and ((i, item) not in best or coverage > best[i, item][4]):
            best[i, item] = (i, items.ids[item], s, cosine, coverage, kind)
            if coverage >= verbatim:
                return


LEAKS = "doc_id bigint, text_key bigint, item_id bigint, first_word bigint, cosine double, coverage double, kind string"


def fit(documents: DataFrame, items: DataFrame, dims: int = 1 << 15, rank: int = 96) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The encoded documents, the projection table (with a last row of zeros) and the idf of each bucket, from all rows."""
    encoded = encode_documents(documents)
    df, passages = passage_frequencies(encoded, dims)
    idf = np.log((passages + 1) / (df + 1)).astype(np.float32)

    @lean
    def own(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([z.compress(word_hashes(x).tobytes()) for x in rows_of(b, "text")[0]], pa.binary())], ["words"])

    words = encoded.select("words").union(items.select(F.col("text").cast("binary").alias("text")).mapInArrow(own, "words binary"))
    table = latent_projection(words, idf, rank) * idf[:, None]
    return encoded, np.vstack([table, np.zeros((1, rank), np.float32)]).astype(np.float32), idf


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_cosine: float = 0.5, verbatim: float = 0.75, paraphrase: float = 0.5, items_each: int = 20_000, **bounds) -> DataFrame:
    """One row per document and item that it leaks: doc_id, text_key, item_id, first word of the window, cosine, coverage, kind."""
    spark, parts = documents.sparkSession, []
    answer = F.col("answer").cast("binary") if "answer" in benchmark.columns else F.lit(None).cast("binary")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"), answer.alias("answer"))
    encoded, table, idf = fit(documents, items, **bounds)
    blocks = max(1, -(-items.count() // items_each))
    for i in range(blocks):  # the benchmark is the stated query set; its blocks meet all rows
        rows = [(r["item_id"], bytes(r["text"]), r["answer"] and bytes(r["answer"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()]
        shared = spark.sparkContext.broadcast((table, Items(rows, table, idf)))

        @lean
        def run(batches, shared=shared):
            projection, made = shared.value
            for b in batches:
                blobs = rows_of(b, "words")[0]
                for start, stop in slices_of(blobs, 1 << 17):
                    found = leaks_in([decoded(x) for x in blobs[start:stop]], projection, made, min_cosine, verbatim, paraphrase)
                    if found:
                        at, *rest = zip(*found, strict=True)
                        own = b.select(["doc_id", "text_key"]).take(pa.array([start + k for k in at]))
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                        yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], [c.split()[0] for c in LEAKS.split(", ")])

        parts.append(encoded.mapInArrow(run, LEAKS))
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def without_leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents without the rows that leak an item."""
    return without_rows(documents, find_leaks(documents, benchmark, **options).select("doc_id", "text_key"))

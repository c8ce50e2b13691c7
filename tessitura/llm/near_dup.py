"""Near-duplicate groups by bottom-k sketches.

A document's set is its distinct 5-word shingles, hashed by one function; its sketch is the k smallest hashes. Documents
are linked where the Jaccard similarity of their full sets is 0.75 or more, and grouped by the links' components.

1. One scan makes (set size, digest of the set, sketch). Documents of equal sets form a class with a number of its own; a
   group of exact copies is thus one row, whatever its size.
2. Inverted lists of the retained values generate overlaps. A pair at the threshold shares most of its retained values (all
   but a share below 1e-12 likely, see needed()), so each class need only offer its rarest retained values: by the prefix
   argument any such pair meets in one of them. A value that thousands of documents share through a common passage is thus
   offered only by documents that hardly have anything else.
3. Rounds of stars: in each list every class meets a few heads. It keeps the best of these by the union-sketch estimate;
   the exact Jaccard of the full sets verifies; components contract, and the next round only looks between components.
4. Classes whose lists reach over components after that offer the rarest values of their full sets: by the exact prefix
   filter, any pair still unlinked meets there. Lists are cut into blocks by set size, and what leaves two blocks is that a
   class may reach a component, not each pair. Such a class is compared with all the component's members, full sets in
   blocks, and one link is enough: this step drops nothing by an estimate, and no table of pairs is made.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z in lower case. Fewer than 5 words are one shingle.
Defined cases: null text or no words give an empty set, linked with nothing; rows that repeat an id keep their own sets and
components, each named by the smallest id in it; rows of null id have no component (null), link nothing and are kept; an
empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build, hits
from .common import Scratch, WordHash, rows_of, text_key, without_rows
from .memory import lean

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC4CEB9FE1A85EC53)


def shingle_set(text: bytes | None, words: WordHash) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    h, _, _ = words(text.lower() if text else b"")  # of bytes: A-Z only
    width = min(SHINGLE, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out *= _ODD
        out += h[j : j + len(out)]
    out ^= out >> np.uint64(33)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


@cache
def binomial_needed(k: int, missed: float = 1e-12) -> int:
    """The largest number that a binomial (k, 0.75) variable stays below with a probability of at most missed."""
    below, t = 0.0, 0
    while (below := below + comb(k, t) * 3**t / 4**k) <= missed:
        t += 1
    return max(1, t)


def needed(size: int, k: int) -> int:
    """How many retained values two sets of similarity 0.75 share at least, one of them of this size.

    Below k values a sketch is the whole set, and the union has at most size / 0.75 values, a quarter of them unshared. From
    k values on, the union's k smallest values are a sample of it, drawn without putting back, whose shared ones are at least
    as close about 0.75 k as binomial ones; a pair misses this number with a probability of at most 1e-12."""
    return max(1, min(-(-3 * size // 4), k - k // 3)) if size < k else binomial_needed(k)


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set (null if empty), sketch."""

    @lean
    def run(batches):
        words = WordHash(5)
        for b in batches:
            n, digests, kept = [], [], []
            for text in rows_of(b, "text")[0]:
                s = shingle_set(text, words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                kept.append(s[:k].view(np.int64))
            own = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "digest", "sketch"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def lists_of(batch, name: str) -> list[np.ndarray]:
    """A column of bigint arrays as unsigned numpy arrays, without a copy."""
    column = batch.column(batch.schema.get_field_index(name))
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity by the k smallest values of the union of two sketches; exact if both hold whole sets."""
    both = np.sort(np.concatenate([a, b]))
    again = np.append(both[1:] == both[:-1], False)
    union = np.cumsum(~again)  # how many values of the union there are up to here
    held = min(k, int(union[-1])) if len(both) else 0
    return float((again & (union < held)).sum()) / held if held else 0.0


def with_estimates(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) with the union-sketch estimate; those whose estimate is below six standard deviations are left out."""
    low = 0.75 - 6 * (0.1875 / k) ** 0.5

    @lean
    def run(batches):
        for b in batches:
            x, y = lists_of(b, "sa"), lists_of(b, "sb")
            est = np.array([union_estimate(p, q, k) for p, q in zip(x, y, strict=True)], float)
            whole = np.array([len(p) < k and len(q) < k for p, q in zip(x, y, strict=True)], bool)
            keep = np.where(whole, est >= 0.75 - 1e-9, est >= low)
            ids = [b.column(b.schema.get_field_index(n)) for n in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(est)], ["a", "b", "estimate"]).filter(pa.array(keep))

    s = classes.select("cid", "sketch")
    both = pairs.join(s.toDF("b", "sb"), "b").join(s.toDF("a", "sa"), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, estimate double")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= 75 * union on full sets."""

    @lean
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(lists_of(b, "xa"), lists_of(b, "xb"), strict=True):
                merged = np.sort(np.concatenate([x, y]))
                both = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * both >= 75 * (len(merged) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    s = sets.select("cid", "hashes")
    both = pairs.select("a", "b").join(s.toDF("b", "xb"), "b").join(s.toDF("a", "xa"), "a")
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def prefix_relations(sets: DataFrame, placed: DataFrame, keep: Scratch) -> DataFrame:
    """(cid, other): classes with another component whose members they may reach 0.75 with, by the exact prefix filter.

    sets: (cid, hashes); placed: (cid, n, c). In a common order, rarest first, two sets of similarity 0.75 meet among the
    first n - ceil(0.75 n) + 1 values of each. A set with more than a quarter of values of its own offers none."""
    full = sets.join(placed, "cid").select("cid", "n", "c", F.explode("hashes").alias("value"))
    often = keep.keep(full.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    offered = full.join(often, "value").groupBy("cid").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("list"))
    alone = F.col("n") - F.size("list")  # values of its own come first in the order
    room = (F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - alone).cast("int")
    lists = offered.where(room > 0).select("cid", "n", "c", alone.alias("alone"), F.posexplode(F.slice("list", F.lit(1), room)).alias("i", "v"))
    return list_relations(keep.keep(lists.select(F.col("v.value").alias("value"), "cid", "n", "c", (F.col("n") - F.col("alone") - F.col("i")).alias("left")), "prefixes"), keep)


def list_relations(lists: DataFrame, keep: Scratch, block: int = 256) -> DataFrame:
    """(cid, other): a class and a component c that is not its own, where they share a list of a value in which some member's size
    n and place allow 0.75. Of two components' members in a list only one side's need be named.

    left: how many values of the set come at or after the list's in the common order. From their first common value on a pair
    has at most the shorter rest in common, and needs 3 / 7 of both sizes. The smaller set thus knows the largest size of a
    partner, and the larger one the largest size of a smaller partner; sizes are dealt to bands of a tenth.

    In each band a list's entries meet in blocks, those of its largest component in blocks of their own, which never meet each
    other. What leaves two blocks is a row for each class and component, not for each pair."""
    main = lists.groupBy("value", "c").agg(F.count("*").alias("members")).groupBy("value").agg(F.sum("members").alias("members"), F.max_by("c", F.struct("members", "c")).alias("main"), F.count("*").alias("components"))
    main = main.where("components > 1").select("value", "members", "main")
    open_ = keep.keep(lists.join(main, "value"), "open-prefixes")
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.1)))
    most = F.least(F.floor(F.col("n") * 4 / 3), F.floor(F.col("left") * 7 / 3) - F.col("n"))  # of a partner that isn't smaller
    small = open_.withColumn("most", most).where("most >= n").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.col("most")))))
    large = open_.withColumn("most", F.floor(F.col("left") * 7 / 3) - F.col("n")).where("4 * most >= 3 * n").withColumn("band", band(F.col("n")))

    def blocks(entries: DataFrame, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("members") / block))
        return entries.groupBy("value", "band", (F.col("c") == F.col("main")).alias(f"main_{name}"), part.alias(f"part_{name}")).agg(F.collect_list(F.struct("cid", "c", "n", "most")).alias(name))

    def fits(x, y):
        return (x["c"] != y["c"]) & (x["n"] <= y["n"]) & (y["n"] <= x["most"]) & (x["n"] <= y["most"])

    relation = lambda cid, other: F.struct(cid.alias("cid"), other.alias("other"))
    s, t = blocks(small, "s"), blocks(large, "t")
    met = s.join(t, ["value", "band"]).where("not (main_s and main_t)")
    of_large = F.transform(F.filter("t", lambda y: F.exists("s", lambda x: fits(x, y))), lambda y: relation(y["cid"], F.col("s")[0]["c"]))
    others = lambda x: F.array_distinct(F.transform(F.filter("t", lambda y: fits(x, y)), lambda y: y["c"]))
    of_small = F.flatten(F.transform("s", lambda x: F.transform(others(x), lambda c: relation(x["cid"], c))))
    return met.select(F.explode(F.when(F.col("main_s"), of_large).otherwise(of_small)).alias("r")).select("r.cid", "r.other").distinct()


def links_of_blocks(x: list[np.ndarray], y: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each set of x that reaches 0.75 with a set of y, its place and that of the first such set."""
    nx, ny = np.array(list(map(len, x))), np.array(list(map(len, y)))
    vx, vy = np.concatenate(x), np.concatenate(y)
    order = np.argsort(vy, kind="stable")
    of_y, vy = np.repeat(np.arange(len(y), dtype=np.int32), ny)[order], vy[order]
    low, high = vy.searchsorted(vx, "left").astype(np.int32), vy.searchsorted(vx, "right").astype(np.int32)
    n = high - low
    at = np.arange(int(n.sum()), dtype=np.int32)  # where each common value stands
    at += np.repeat(low - (np.cumsum(n, dtype=np.int32) - n), n)
    pair = np.repeat(np.repeat(np.arange(len(x), dtype=np.int32) * np.int32(len(y)), nx), n)
    pair += of_y[at]
    both = np.bincount(pair, minlength=len(x) * len(y)).reshape(len(x), len(y))
    ok = 100 * both >= 75 * (nx[:, None] + ny[None, :] - both)
    return [(int(i), int(ok[i].argmax())) for i in np.flatnonzero(ok.any(1))]


def verified_relations(relations: DataFrame, placed: DataFrame, sets: DataFrame, keep: Scratch, values: int = 1 << 13, entries: int = 64) -> DataFrame:
    """Links (a, b): for each related class and component, a member of it that the class reaches 0.75 with, if there is one.

    The classes that are related to a component, and its members, are dealt to blocks of about so many values and entries; each
    block of one meets each of the other in a row of its own, and is compared there as a whole."""
    own = keep.keep(sets.join(placed.select("cid", "n", "c"), "cid").select("cid", "n", "c", "hashes"), "own-sets")
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n") / values), F.ceil(F.count("*") / entries)).cast("int")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("other").agg(parts.alias(f"parts_{name}"))
        dealt = rows.join(sizes, "other").withColumn(f"part_{name}", F.pmod(F.xxhash64("cid", F.lit(3)), F.col(f"parts_{name}")))
        dealt = dealt.repartition("other", f"part_{name}")  # else a component's blocks stay together, as they were counted
        return dealt.groupBy("other", f"part_{name}").agg(F.first(f"parts_{name}").alias(f"parts_{name}"), F.collect_list(F.struct("cid", "hashes")).alias(name))

    members = blocks(own.withColumnRenamed("c", "other").join(relations.select("other").distinct(), "other").select("other", "cid", "n", "hashes"), "y")
    asking = blocks(relations.join(own.select("cid", "n", "hashes"), "cid"), "x")
    counts = members.groupBy("other").agg(F.first("parts_y").alias("parts_y"))
    met = asking.join(counts, "other").withColumn("part_y", F.explode(F.sequence(F.lit(0), F.col("parts_y") - 1))).select("other", "part_y", "x").join(members.select("other", "part_y", "y"), ["other", "part_y"])

    @lean
    def run(batches):
        for b in batches:
            found = []
            for row in zip(_blocks_of(b, "x"), _blocks_of(b, "y"), strict=True):
                (ids_x, x), (ids_y, y) = row
                found += [(ids_x[i], ids_y[j]) for i, j in links_of_blocks(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])

    return met.select("x", "y").mapInArrow(run, "a bigint, b bigint")


def _blocks_of(batch, name: str):
    """(ids, sets) of each row's array of (cid, hashes)."""
    column = batch.column(batch.schema.get_field_index(name))
    at, entries = column.offsets.to_numpy(), column.values
    ids, lists = entries.field("cid").to_numpy(zero_copy_only=False), entries.field("hashes")
    inner, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield ids[i:j], [values[inner[n] : inner[n + 1]] for n in range(i, j)]


def full_sets(documents: DataFrame, wanted: DataFrame, filter_bytes: int) -> DataFrame:
    """(cid, hashes) of the wanted classes (cid, rep, digest); a Bloom filter keeps the others' texts out of the shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(build(wanted.select("rep"), filter_bytes))

    @lean
    def run(batches):
        words = WordHash(5)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(hits(shared.value, ids.view(np.uint64)))
            if len(at):
                found = b.take(pa.array(at))
                sets = [shingle_set(t, words) for t in found.column(1).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "digest", "hashes"])

    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    # an id can have several sets, and a set several rows of its least id
    met = rows.mapInArrow(run, "rep bigint, digest binary, hashes array<bigint>").join(wanted, ["rep", "digest"])
    return met.groupBy("rep", "digest").agg(F.first("cid").alias("cid"), F.first("hashes").alias("hashes")).select("cid", "hashes")


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(id, component) for each id of the edges (a, b): the smallest id reachable, by least neighbours and jumping.

    Each round lowers a label or ends the loop; with jumping there are about as many as the logarithm of a component's width."""
    both = keep.keep(edges.union(edges.select("b", "a")).toDF("id", "other").distinct(), "edges")
    labels = keep.keep(both.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.toDF("other", "theirs"), "other").groupBy("id").agg(F.min("theirs").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = least.join(labels.toDF("component", "beyond"), "component").select("id", "was", F.least("component", "beyond").alias("component"))
        moved = keep.keep(jump, "labels")
        keep.drop("labels", latest=False)
        labels = moved.select("id", "component")
        if moved.where("component < was").isEmpty():
            keep.drop("edges")
            return labels


def _fits(x: str, y: str):
    """Set sizes between which a similarity of 0.75 is possible."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * 75


def _placed(lists: DataFrame, grouped: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """The lists' entries with their component so far and the number of their links as a head."""
    if grouped is None:
        return lists.withColumn("c", F.col("cid")).withColumn("degree", F.lit(0))
    degrees = links.groupBy("b").agg(F.count("*").alias("degree")).withColumnRenamed("b", "cid")
    return lists.join(grouped.toDF("cid", "c"), "cid", "left").join(degrees, "cid", "left").select("value", "cid", "n", F.coalesce("c", "cid").alias("c"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _heads(placed: DataFrame, turn: int, hashed: int = 2) -> DataFrame:
    """Each entry of a list with more than one component, beside the list's heads in other components: the one with most
    links (at first the smallest number) and some by hash, other ones in each turn."""
    entry = F.struct("cid", "n", "c")
    chosen = [F.max_by(entry, F.struct("degree", -F.col("cid")))] + [F.min_by(entry, F.xxhash64("cid", F.lit(turn), F.lit(i))) for i in range(hashed)]
    heads = placed.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.array_distinct(F.array(*chosen)).alias("heads")).where("lo < hi")
    return placed.join(heads.select("value", F.explode("heads").alias("head")), "value").where((F.col("cid") != F.col("head.cid")) & (F.col("c") != F.col("head.c")))


def near_duplicates(documents: DataFrame, k: int = 64, rounds: int = 3, tries: int = 2, filter_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for each row of documents.

    rounds of stars come before the exhaustive step; tries is how many of its best heads a class verifies in each."""
    keep = Scratch(documents.sparkSession, "near-dup")
    seen = keep.keep(sketches(documents, k), "sketches")
    real = seen.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # numbered as they are written: from then on a class has one number, whoever reads it
    classes = keep.keep(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    # inverted lists of the rarest retained values
    values = classes.select("cid", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    often = keep.keep(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    offered = values.join(often, "value").groupBy("cid").agg(F.first("n").alias("n"), F.first("held").alias("held"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("list"))
    enough = F.when(F.col("n") < k, F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * 3 / 4), F.lit(k - k // 3)))).otherwise(needed(k, k))
    room = (F.col("held") - enough + 1 - (F.col("held") - F.size("list"))).cast("int")  # the unshared values come first in the prefix
    lists = keep.keep(offered.where(room > 0).select("cid", "n", F.explode(F.slice("list", F.lit(1), room)).alias("v")).select("cid", "n", F.col("v.value").alias("value")), "lists")

    # rounds of stars: the size of a group, not its square
    shared = lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select("value")
    lists = keep.keep(lists.join(shared, "value"), "lists")
    keep.drop("frequencies")
    keep.drop("lists", latest=False)
    wanted = lists.select("cid").distinct().join(classes.select("cid", "rep", "digest"), "cid")
    sets = keep.keep(full_sets(documents, wanted, filter_bytes), "sets")
    links, grouped = None, None
    for turn in range(rounds):
        heads = _heads(_placed(lists, grouped, links), turn)
        stars = heads.where(_fits("n", "head.n")).select(F.col("cid").alias("a"), F.col("head.cid").alias("b")).distinct()
        best = with_estimates(stars, classes, k).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("estimate", "b")), asc=False), 1, tries).alias("best"))
        found = keep.keep(verified(best.select("a", F.explode("best").alias("x")).select("a", "x.b"), sets), "links")
        links = found if links is None else links.union(found)
        grouped = components(links, keep)
        keep.drop("labels", latest=False)

    # what lies between components still: all pairs that the prefix filter on full sets leaves
    placed = _placed(lists, grouped, links)
    mixed = placed.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("value")
    open_ = keep.keep(placed.join(mixed, "value").select("cid", "n", "c").distinct(), "open")
    rest = keep.keep(verified_relations(keep.keep(prefix_relations(sets, open_, keep), "relations"), open_, sets, keep), "links")
    grouped = components(links.union(rest), keep)

    member = classes.join(grouped.toDF("cid", "c"), "cid", "left").select("digest", "rep", F.coalesce("c", "cid").alias("c"))
    least = member.groupBy("c").agg(F.min("rep").alias("component_id"))
    member = keep.keep(member.join(least, "c").select("digest", "component_id"), "members")
    keep.drop("classes", "lists", "sets", "links", "labels", "open", "shared-values", "prefixes", "open-prefixes", "relations", "own-sets")
    rows = seen.select("doc_id", "n_shingles", "text_key", "digest").join(member, "digest", "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "text_key")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def first_of_each(documents: DataFrame, **options) -> DataFrame:
    """documents without the rows that near_duplicates() does not keep."""
    return without_rows(documents, near_duplicates(documents, **options).where("not kept").select("doc_id", "text_key"))

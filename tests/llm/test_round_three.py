"""Pieces, importance resampling and lexical search against the library, plain Python and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessitura.llm import lexical, queries, resampling
from tessitura.llm.common import scratch
from tessitura.llm.pieces import Pieces, decode_ids, encode_texts, round_trip

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, "One two, three."), (3, "One two, three."), (4, " \n\t "), (None, "No id here"), (5, "x" * 30_000), (6, "word " * 20_000), (7, "Éa 中国 ▁ </s> <s> <0x0A> 😀"),
    (8, "\x00 nul"), (-9, "A a A a"), (9223372036854775807, "b B b"),
]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns with clashing names."""
    rows = [(i, t, 7, "x", None, 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, fit string, shard int, rank int, features int, n_words int")


# pieces


@pytest.fixture(scope="module")
def own():
    return Pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check_pieces(own, library, text):
    ids = np.frombuffer(own.encode(text), "<i4")
    assert ids.tolist() == library.encode(text, add_eos=True), text[:80]
    assert own.decode(ids) == library.decode(ids.tolist()), text[:80]


def test_pieces_equal_the_library_on_random_strings(own, library):
    rng = random.Random(5)
    plain = [own.piece[i] for i in range(259, 32_000)]
    parts = [" ", "  ", "▁", "\n", "\t", "a", "b", "the", "er", "1", "23", "é", "中", "日本", "😀", "\x00", "</s>", "<s>", "<unk>", "<0x0A>", "ﬁ", "́", "سلام", "한", "⁇", "�"]
    for n in range(6_000):
        kind = n % 4
        if kind == 0:
            text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        elif kind == 1:
            text = "".join(rng.choices(plain, k=rng.randint(1, 8)))
        elif kind == 2:
            text = "".join(rng.choices("abcdefinortsu ", k=rng.randint(1, 30)))
        else:
            text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(rng.randint(1, 20)))
        check_pieces(own, library, text)


def test_pieces_equal_the_library_on_runs_and_long_texts(own, library):
    for n in range(1, 70):
        for text in (" " * n, " " * n + "x", "x" + " " * n, "ab" * n, "é" * n):
            check_pieces(own, library, text)
    for text in ("a" * 20_000, "ab" * 10_000, "中" * 9_000, " " * 9_000, "\n" * 9_000, "abcdefghij" * 3_000):
        check_pieces(own, library, text)


def test_decode_equals_the_library_on_any_ids(own, library):
    rng = random.Random(6)
    for _ in range(5_000):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(0, 260), rng.randint(3, 258)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(np.array(ids, "int64")) == library.decode(ids), ids
    with pytest.raises(ValueError):
        own.decode(np.array([32_000]))


def test_the_last_piece_of_a_prefix_is_unique(own):
    """What the table rests on: of all pieces that end at a place, one is compatible with the last piece before it."""
    rng = random.Random(7)
    for _ in range(300):
        part = "▁" + "".join(rng.choices("abcdeghinorst", k=rng.randint(1, 25)))
        last = []
        for at in range(len(part)):
            fits = []
            for size in range(1, min(at + 1, 16) + 1):
                i = own.ids.get(part[at + 1 - size : at + 1])
                if i is not None and (size == at + 1 or own.pairs[last[at - size] << 32 | i]):
                    fits.append(i)
            assert len(fits) == 1
            last += fits


def test_pieces_of_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(0).alias("n_chars")))
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in round_trip(docs, MODEL).collect()}
    assert got == {(i, tuple(library.encode(t, add_eos=True)), library.decode(library.encode(t, add_eos=True))) for i, t in want}
    coded = encode_texts(docs, MODEL, end=False)
    assert coded.count() == len(want)
    assert sorted(((r.doc_id, r.text) for r in decode_ids(coded, MODEL).collect()), key=str) == [(i, library.decode(library.encode(t))) for i, t in want]
    assert decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), MODEL).orderBy("doc_id").collect() == [(1, None), (2, "")]
    assert round_trip(odd(spark).limit(0), MODEL).collect() == []


def test_pieces_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_sentencepiece(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_eos=True)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *sha]
        docs.pop(r.doc_id)
    assert not docs


# importance resampling

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain_resample(docs, target, percent=10, least=20, buckets=10_000, seed=2024, longest=1):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall((text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own, source, goal = [(d, *features(t)) for d, t in docs], Counter(), Counter()
    for _, _, f in own:
        source.update(f)
    for t in target:
        goal.update(features(t)[1])
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r[:4], n + 1) for n, r in enumerate(drawn)] + [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 50, "least": 2, "buckets": 50, "longest": 2, "seed": 3}, {"percent": 100, "least": 0, "longest": 3}])
def test_resampling_equals_plain_python(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **options)
    if "least" in options:
        options = {**{k: v for k, v in options.items() if k != "least"}, "least_words": options["least"]}
    assert plain_rows(resampling.resample(docs, target, **options)) == want


def test_resampling_of_odd_tables(spark):
    target = spark.createDataFrame([(None, 1), ("", 2), ("one two", 3)], "text string, doc_id int")
    got = resampling.resample(odd(spark), target, percent=50, least_words=1)
    assert plain_rows(got) == plain_resample(ODD, [None, "", "one two"], percent=50, least=1)
    assert resampling.resample(odd(spark).limit(0), target).collect() == []
    assert plain_rows(resampling.resample(odd(spark), target.limit(0))) == plain_resample(ODD, [])


def test_gains_are_one_literal_and_only_totals_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = resampling.score_documents(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan and "split(" not in plan.split("aggregate(")[1].split("lambda namedlambdavariable")[0][:200]


def test_ranks_over_many_ranges_with_ties(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 9).alias("score"), F.col("id").alias("doc_id"), F.lit(1).alias("part"))
    got = [(r.doc_id, r["rank"]) for r in resampling.ranked(rows, F.desc("score"), "doc_id").collect()]
    order = sorted(range(5000), key=lambda i: (-(i % 9), i))
    assert sorted(got) == sorted((i, n + 1) for n, i in enumerate(order))


# lexical search


def plain_search(docs, items, k=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(d, Counter(word.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, total, df, held = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs), Counter(), defaultdict(list)
    for at, (d, c) in enumerate(docs):
        df.update(c.keys())
        n = sum(c.values())
        for t, tf in c.items():
            held[t].append((at, 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // total))))
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(word.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = Counter()
        for t, times in terms.items():
            for at, gain in held.get(t, ()):
                scores[at] += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * gain
        best = sorted(((s, docs[at][0]) for at, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, n + 1, d, s) for n, (s, d) in enumerate(best[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [1, 20_000, 1 << 25])
def test_search_equals_brute_force(spark, shard_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(-1, "no id word word"), (-1, "here"), (-2, ""), (-3, None), (None, "b"), (-4, "zzzzunheard")], "item_id long, text string"))
    index = lexical.build_index(docs, scratch(spark, "test-lexical"), shard_bytes)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert plain_rows(lexical.search(index, items)) == want
    assert plain_rows(lexical.search(index, items, k=3, block_terms=700)) == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)


def test_search_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, "a b")], "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("rank", F.lit(1))
    index = lexical.build_index(odd(spark), scratch(spark, "test-lexical"))
    assert plain_rows(lexical.search(index, items)) == plain_search(ODD, [(1, "one"), (2, "a b")])
    assert lexical.search(index, items.limit(0)).collect() == []
    empty = lexical.build_index(odd(spark).limit(0), scratch(spark, "test-lexical"))
    assert lexical.search(empty, items).collect() == []


def test_copies_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "same words in all") for i in range(999, -1, -1)] + [(5000, "other words")], "doc_id long, text string").repartition(5)
    got = lexical.search(lexical.build_index(docs, scratch(spark, "test-lexical"), 4000), spark.createDataFrame([(1, "same")], "item_id long, text string"))
    assert sorted((r["rank"], r.doc_id) for r in got.collect()) == [(n + 1, n) for n in range(20)]


def test_blocks_below_the_threshold_stay_compressed():
    """One strong stretch of documents first: the other blocks of a weak term can't reach its scores."""
    rng = random.Random(3)
    docs = [f"common {'rare ' * 30}" if i < 40 else "common " + " ".join(rng.choices("abcdefgh", k=60)) for i in range(20_000)]
    writer = lexical.ShardWriter(len(docs), sum(len(d.split()) for d in docs))
    for i, d in enumerate(docs):
        writer.add(i, d.encode())
    import pyarrow as pa

    ids, m, order, terms = lexical._open_shard(pa.Table.from_batches(writer.rows(0)))
    best = lexical.best_documents([lexical.Pointer(terms[t], f) for t, f in ((b"common", 1), (b"rare", 900))], 20, order)
    assert [ids[d] for _, d in best] == list(range(20))
    assert len(terms[b"common"].top) > 150 and len(terms[b"common"].open) <= 2


def test_posting_bytes_round_trip():
    rng = np.random.default_rng(1)
    for high in (2, 100, 128, 70_000, 1 << 40):
        values = rng.integers(0, high, 1000)
        data, begins = lexical.varint(values)
        assert (lexical.from_varint(data) == values).all() and begins[0] == 0
        assert (lexical.from_varint(data[begins[500] :]) == values[500:]).all()

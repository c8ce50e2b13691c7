"""The corpus operators on small tables: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessitura.llm import chat, decontam, langid, media, near_dup, packing, quality, substring, token_counts, toxicity
from tessitura.llm.bloom import build, hits
from tessitura.llm.common import Memo, WordHash, scratch, slices_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD_BPE, PIECES, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))


def table(spark, texts):
    """doc ids from 1 on; a text can be (id, text)."""
    rows = [(t if isinstance(t, tuple) else (i + 1, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(3000)]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [None, "", "  \n\t", "one", "a b c d", "x " * 40_000, "Ünïcode ﬁ ß İ nbsp\x1cfs", "same text", "same text", "</s>[INST] <|im_end|> \\"]


def test_word_hashes_tell_words_apart():
    words = WordHash(piece=64)
    for text in (b"", b" \n", b"a", b" a\tb\x0bc\x0c d\re ", "Éa \u3000b 中".encode(), b"x" * 1000 + b" y x", b"ab " * 5000, b"\x00 \x1f \x85"):
        h, starts, ends = words(text)
        assert [text[i:j] for i, j in zip(starts, ends)] == text.split() and len(set(h.tolist())) == len(set(text.split()))
        assert h.tolist() == [int(words(b"  " + w)[0][0]) for w in text.split()]  # wherever it stands
    rng = random.Random(1)
    many = {"".join(rng.choices("ab", k=rng.randrange(1, 30))).encode() for _ in range(50_000)}
    h = words(b" ".join(many))[0]
    assert len(set(h.tolist())) == len(many) and (WordHash(1)(b" ".join(many))[0] != h).all()


def test_memo_stays_bounded_and_right():
    m = Memo(lambda w: w * 2, 10)
    assert all(m[i % 37] == (i % 37) * 2 for i in range(1000)) and len(m) + len(m.old) <= 22


def test_slices_cover_all():
    texts = [b"x" * n for n in (5, 0, 900, 3, 3)] + [None]
    parts = list(slices_of(texts, 500))
    assert [i for a, z in parts for i in range(a, z)] == list(range(6)) and list(slices_of([], 5)) == []


def test_bloom_has_no_false_negatives(spark):
    values = spark.range(0, 5000).select(F.xxhash64("id").alias("v"))
    b = build(values, 1 << 20)
    own = np.array([r["v"] for r in values.collect()]).view(np.uint64)
    others = np.array([r["v"] for r in spark.range(10_000, 15_000).select(F.xxhash64("id").alias("v")).collect()]).view(np.uint64)
    assert hits(b, own).all() and hits(b, others).mean() < 0.05
    assert not hits(build(values.limit(0), 1 << 20), others).any()


# 1 toxicity


def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    bad, docs, labels = ["grumplet", "vexoid", "snarkish"], [], []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [prose(rng, 8) for _ in range(6)]
        if toxic:
            sentences[rng.randrange(6)] += f" {rng.choice(bad)} {rng.choice(bad)}"
        docs.append((i, ". ".join(sentences), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_locates(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    located = [texts[r["doc_id"]][s["start"] : s["stop"]] for r in rows for s in r["sentences"]]
    assert located and all(any(w in s for w in (b"grumplet", b"vexoid", b"snarkish")) for s in located)


def test_length_alone_is_not_toxic(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    weights = Memo(lambda w: sum(model["weights"].get(f, 0.0) for f in toxicity.features(w)))
    score = lambda text: toxicity.score_text(text.encode(), weights, model["bias"], 0.5)[0]
    assert score("Unseenword. " * 20_000) < 0.06
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean = [r["text"] for r in docs.collect() if known.get(r["doc_id"]) == 0]
    assert score("\n".join(clean[:60])) < 0.3 and score("\n".join(clean[:60]) + ". grumplet vexoid w1.") > score("\n".join(clean[:60]))


def test_noisy_or_equals_a_plain_product(spark):
    weights, bias = {"bad": 7.0, "odd": 5.5, "mild": 1.0}, -6.0
    memo = Memo(lambda w: sum(weights.get(f, 0.0) for f in toxicity.features(w)))
    text = "A bad word. Odd things happen! mild.\nmild mild mild mild odd"
    odds = [sum(weights.get(toxicity.normal(w.encode()), 0.0) for w in s.split()) + bias for s in toxicity.re.split(r"[.!?\r\n]+", text) if s]
    want = 1 - np.prod([1 - 1 / (1 + np.exp(np.log1p(len(odds) / 20) - x)) for x in odds])
    got, spans = toxicity.score_text(text.encode(), memo, bias, 0.5)
    assert abs(got - want) < 1e-12 and [text[s["start"] : s["stop"]] for s in spans] == ["A bad word", "mild mild mild mild odd"]


def test_toxicity_odd_rows(spark):
    docs, labels = labelled(spark, 200)
    odd = docs.unionByName(table(spark, [(1000 + i, t) for i, t in enumerate(ODD)])).withColumn("score", F.lit("clash"))
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, labels).collect()}
    assert len(rows) == 210 and rows[1000]["score"] == rows[1001]["score"] == 0.0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.reject_toxic(odd, labels).columns == odd.columns
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("score > 0").count() == 0


def test_toxicity_never_learns_from_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    assert toxicity.score_text(b"clean words. " * 50_000, Memo(lambda w: 0.0), -6.0, 0.5)[0] < 0.06
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, l).collect())
    assert score(labels) == score(flipped)


# 2 media


def test_media_round_trip(spark):
    texts = [*ODD, "é" * 300]
    rows = {r["doc_id"]: r for r in media.media_columns(table(spark, texts), scratch(spark, "media")).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = rows[i + 1]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["width"], r["height"], r["bit_depth"]) == (192, len(payload) // 192, 8)
    assert len(rows) == len(texts) and rows[8]["media_sha256"] == rows[9]["media_sha256"]


def test_folders_open_by_spark_names(tmp_path):
    files, path = media.open_folder(f"file://{tmp_path}")
    assert files.type_name == "local" and path == str(tmp_path) and media.open_folder(str(tmp_path))[1] == str(tmp_path)


def test_media_header_alone_and_one_copy(spark):
    root = scratch(spark, "media")
    docs = media.with_payload(table(spark, ["same"] * 50 + ["other"]).repartition(7))
    index = media.write_shards(docs, docs.select("doc_id", "n_bytes", "digest", "key"), root)
    assert index.count() == 2
    assert sorted(media.read_media(index, root, False).columns) == sorted(["digest", "width", "height", "bit_depth", "media_bytes"])
    stored = sum(open(f, "rb").read().count(b"IHDR") for f in _files(root) if f.endswith(".tar"))
    assert stored == 2
    assert media.media_columns(table(spark, ["x"]).limit(0), scratch(spark, "media")).count() == 0


def _files(root):
    top = root.removeprefix("file://")
    return [os.path.join(d, f) for d, _, names in os.walk(top) for f in names]


# 3 substring dedup


def brute_removal(rows):
    first = {}
    split = lambda t: t.encode().split() if t else []
    for i, t in rows:
        if i is not None and t is not None:
            w = split(t)
            for j in range(len(w) - 12):
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = split(t)
        gone = set()
        for j in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed=3, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, 20) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [prose(rng, rng.randrange(0, 60))]
        if rng.random() < 0.6:
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 30))]
        texts.append("  ".join(parts) if rng.random() < 0.1 else "  \n".join(parts))
    return texts + [texts[0], texts[0], None, "", "a " * 500, "a " * 300]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_equals_brute_force(spark, batches):
    rows = [(i * 3 % 71, t) for i, t in enumerate(passages())] + [(None, passages()[0]), (5, passages()[3])]
    docs = table(spark, rows).repartition(5).withColumn("bucket", F.lit(1)).withColumn("row_RUNS", F.lit(2))
    got = substring.remove_repeats(docs, batches=batches, max_runs=2)
    want = brute_removal(rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()) == want
    cut = substring.cut_repeats(docs, batches=batches)
    assert cut.columns == docs.columns
    kept = {(i, k) for i, _, gone, k in want.elements() if gone}
    before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for r in cut.collect():
        if (r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) in kept:
            assert r["n_chars"] == len(r["text"])
        else:
            assert before[r["doc_id"], r["text"]] and r["bucket"] == 1 and r["row_RUNS"] == 2


def test_index_opens_again_and_compaction_keeps_all(spark):
    docs = table(spark, passages()).where("text is not null").selectExpr("doc_id as __id", "cast(text as binary) as text")
    root = scratch(spark, "index")
    values = lambda d: sorted(r["value"] for r in substring.anchor_values(d).collect())
    shared = []
    for lo, hi in ((0, 20), (20, 40), (40, 70)):  # each batch by an index that was opened for it
        index = substring.FingerprintIndex(spark, root, 8)
        shared.append(set(values(index.append(docs.where(f"__id > {lo} and __id <= {hi}")))))
    before = set(values(index.read().select("bucket", "anchors")))
    index.compact()
    again = substring.FingerprintIndex(spark, root, 99)
    after = values(again.read().select("bucket", "anchors"))
    assert len(again.tables) == 1 and again.buckets == 8 and again.made == 3 and len(after) == len(set(after)) and set(after) == before
    anchors = {r["__id"]: set(substring.window_anchors(WordHash()(r["text"])[0]).view(np.int64).tolist()) for r in docs.collect()}
    rows = Counter(x for i, a in anchors.items() if i <= 40 for x in a)
    assert shared[1] == {x for i, a in anchors.items() if 20 < i <= 40 for x in a if rows[x] > 1}
    bloom = build(spark.createDataFrame([(x,) for x in shared[1]], "v long"), 1 << 20)
    owners = {r["id"] for r in substring.owners_of(again.owners(), bloom).collect()}
    assert owners >= {i for i, a in anchors.items() if a & shared[1]}


def test_substring_windows_take_one_python_worker_a_task(spark, monkeypatch):
    """The filter of earlier owners is part of the window step: two Python steps in a task are two workers with a memory each."""
    plans, write = [], substring.materialize
    monkeypatch.setattr(substring, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    got = substring.repeats(table(spark, passages()), batches=3).count()
    steps = [plan.count("- MapInArrow") for name, plan in plans if name == "removals"]
    assert got and steps == [1, 1, 1]


def test_substring_empty_table(spark):
    assert substring.remove_repeats(table(spark, ["x"]).limit(0)).count() == 0 and substring.cut_repeats(table(spark, ["x"]).limit(0)).count() == 0


# 4 packing


def test_packing_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    tok = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, "it's they'Re <|endoftext|> a<|STARTOFTEXT|>b 12ab ab12. a..b, x'. K Å ẞ Σίσυφος ΟΔΟΣ"] + [prose(rng, rng.randrange(1, 3000)) for _ in range(30)]
    rows = packing.pack_documents(table(spark, texts).repartition(3), WORD_BPE).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i + 1], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(table(spark, ["x"]).limit(0), WORD_BPE).count() == 0


def test_step_groups_are_balanced(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([20, 200, 900, 4000])) for _ in range(150)]
    rows = packing.pack_documents(table(spark, texts).repartition(2).withColumn("tier", F.lit("x")), WORD_BPE, step_tokens=1 << 14).collect()
    of_partition = {}
    for r in rows:
        of_partition.setdefault(r["sequence_id"] >> 40, {}).setdefault(r["step_group"], Counter())[r["tier"]] += r["length"]
    for groups in of_partition.values():
        sizes = [sum(groups[g].values()) for g in sorted(groups)]
        assert len(sizes) > 3 and set(sizes[:-2]) == {1 << 14} and abs(sizes[-1] - sizes[-2]) <= max(sizes[-2:]) - (1 << 13) + 4096
        long = [groups[g][4096] / sum(groups[g].values()) for g in sorted(groups)[:-2]]
        assert max(long) - min(long) <= 0.5  # every group has its share of the longest tier


@pytest.mark.parametrize("tokenizer", [WORD_BPE, BYTES])
def test_any_tokenizer_gives_its_own_ids(spark, tokenizer):
    """The word memo only where the tokenizer's file says that it holds."""
    from tokenizers import Tokenizer

    assert packing.splits_words(tokenizer) == (tokenizer == WORD_BPE)
    tok, encode = Tokenizer.from_file(tokenizer), packing.text_encoder(tokenizer, 2)
    for text in [*ODD, "Two  words\nand Ümläuts, it's 12ab"]:
        assert np.frombuffer(encode(text.encode() if text is not None else None), "<u4").tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 2]


# 5 token counts


def test_counts_and_cache(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in ODD] + ["<s> </s> <unk>"]
    cache = token_counts.new_cache(spark)
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PIECES, cache).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (rows[i + 1]["n_bytes"], rows[i + 1]["n_tokens"], rows[i + 1]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    token_counts.count_tokens(docs.unionByName(table(spark, [(99, "new")])), PIECES, cache).collect()
    assert spark.read.parquet(cache).count() == stored + 1
    token_counts.count_tokens(docs, BYTES, cache).collect()  # another tokenizer has counts of its own
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(docs.limit(0), PIECES, cache).count() == 0


# 6 quality


def test_blocks_reach_a_text_to_its_end():
    text = bytes(range(250)) * 100
    parts = quality.spread_blocks(text, 1000, 8)
    assert len(parts) == 8 and parts[0] == text[:1000] and parts[-1] == text[-1000:] and quality.spread_blocks(b"abc", 1000, 8) == [b"abc"]


def test_evidence_equals_plain_compression():
    import zstandard

    good, bad = (b"the quick brown fox " * 200, b"buy now cheap deal " * 200)
    sizes = quality.Sizes(good, bad, 64, 1)
    text = b"the quick deal " * 40
    plain = lambda d: sum(len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(text[i : i + 64])) for i in range(0, len(text), 64))
    assert abs(sizes.evidence(text) - (plain(bad) - plain(good)) / len(text)) < 1e-12


def test_quality_learns(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = prose(rng, 80).split()
        docs.append((i, " ".join(words if good else [w + rng.choice(["###", "%%%"]) for w in words]), "en", "s", 0))
        labels.append((i, int(good), 0))
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(d, l).join(l, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    odd = quality.score_quality(d.unionByName(table(spark, [(1000 + i, t) for i, t in enumerate(ODD)])), l).where("doc_id >= 1000").collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality.score_quality(d, l.limit(0)).collect()} == {0.5}
    assert quality.score_quality(d.limit(0), l).count() == 0


# 7 decontamination


def benchmark_case(spark, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("the", "an", "or", "in") for b in ("ti", "er", "ou", "st", "ed", "ha") for c in ("re", "on", "le", "ing", "sh", "nd", "ble")] * 2 + ["the", "of", "and"] * 30
    items = [prose(rng, rng.randrange(14, 60), vocabulary) for _ in range(30)]
    docs, truth = [], set()
    for i in range(200):
        words = prose(rng, rng.randrange(50, 300), vocabulary).split()
        if i % 10 == 0:
            k = rng.randrange(30)
            own = items[k].split()
            if i % 20 == 0:  # a paraphrase: some words are changed, some left out
                own = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in own if rng.random() > 0.08]
            at = rng.randrange(len(words))
            words[at:at] = own
            truth.add((i, k))
        docs.append((i, " ".join(words)))
    return table(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), truth


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    docs, items, truth = benchmark_case(spark)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    assert len(found & truth) >= 0.9 * len(truth)
    assert len(found - truth) <= 2
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(200)) - {d for d, _ in found}


def test_the_projection_is_fitted_on_every_passage(spark):
    """The product of all passages with the start, from all rows and items, against the same by plain matrices."""
    rng, dims, width = random.Random(4), 64, 8
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randrange(0, 150))) for _ in range(2500)]  # more than the 2,000 that were drawn before
    idf = np.linspace(0.1, 2, dims).astype(np.float32)
    group, sign = np.arange(dims) % width, np.where(np.arange(dims) % 3 == 0, -1.0, 1.0)
    start, want = np.zeros((dims, width)), np.zeros((dims, width))
    start[np.arange(dims), group] = sign
    for text in texts:
        ids = decontam.buckets_of(decontam.word_hashes(text.encode()), dims)
        for s in range(0, len(ids), decontam.PASSAGE):
            row, part = np.zeros(dims), ids[s : s + decontam.PASSAGE]
            np.add.at(row, part, idf[part])
            want += np.outer(row, row @ start) / (idf[part] ** 2).sum()
    encoded = decontam.encode_documents(table(spark, list(enumerate(texts))))
    got = decontam._times(encoded.select("words"), group, sign, idf, width)
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()


def leaks_everywhere(docs, items):
    """(doc_id, item_id) by the check alone at every place of every text."""
    encoded, table_, idf = decontam.fit(docs, items)
    made = decontam.Items([(r["item_id"], r["text"].encode(), None) for r in items.collect()], table_, idf)
    found = set()
    for r in encoded.collect():
        words = decontam.decoded(r["words"])
        for k, n in enumerate(made.sizes):
            if made.common(k, words, n / 2) < n / 2:
                continue
            answer, least = made.answers[k]
            for s in range(0, len(words), decontam.BLOCK):
                around = words[max(0, s - n) : s + -(-n // decontam.BLOCK) * decontam.BLOCK + n]
                cover = made.common(k, around, 0) / n
                if cover >= 0.75 or (cover >= 0.5 and len(answer.intersection(around.tolist())) >= least):
                    found.add((r["doc_id"], made.ids[k]))
                    break
    return found


def test_leaks_against_every_window(spark):
    docs, items, _ = benchmark_case(spark, 6)
    want = leaks_everywhere(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_candidates_equal_plain_cosines():
    rng = np.random.default_rng(3)
    table_ = np.vstack([rng.standard_normal((64, 5)), np.zeros((1, 5))]).astype(np.float32)
    texts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 7, 8, 9, 40, 100)]
    items = decontam.Items([(1, b"a b c d e f g h i", None), (2, b"one two three", None), (3, b"", None)], table_[:64], np.ones(64, np.float32))
    got = set(zip(*(c.tolist() for c in decontam.candidates(texts, table_, items, 0.3)[:4]), strict=True))
    want = set()
    for i, x in enumerate(texts):
        for k, (width, v) in enumerate([(3, items.vectors[3][0]), (1, items.vectors[1][0])]):
            for s in range(0, len(x), 4):
                w = table_[x[s : s + 4 * width] % 64].sum(0)
                if w @ v >= 0.3 * np.linalg.norm(w):
                    want.add((i, k, s, min(len(x), s + 4 * width)))
    assert got == want and want


def test_leaks_of_rows_without_an_id(spark):
    docs, items, truth = benchmark_case(spark)
    leaking = min(d for d, _ in truth)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") == leaking, F.lit(None)).otherwise(F.lit(5))).withColumn("row_hash", F.lit(1)).withColumn("words", F.lit("clash"))
    kept = decontam.without_leaks(odd, items)
    assert kept.where("doc_id is null").count() == 0 and kept.count() > 100 and kept.columns == odd.columns


def test_leaks_odd_rows(spark):
    docs, items, _ = benchmark_case(spark)
    odd = items.unionByName(spark.createDataFrame([(100, None), (101, ""), (None, "x y z"), (102, "...")], items.schema))
    more = table(spark, [(1000 + i, t) for i, t in enumerate(ODD)])
    assert decontam.find_leaks(docs.unionByName(more), odd).where("doc_id >= 1000 or item_id >= 100").count() == 0
    assert decontam.find_leaks(docs.limit(0), items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_answers_decide_paraphrases(spark):
    text = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    near = text.replace("bravo", "x1").replace("echo", "x2").replace("kilo", "x3").replace("mike", "x4").replace("golf", "x5")
    filler = prose(random.Random(1), 60)
    docs = table(spark, [f"{filler} {near} {filler}"] + [prose(random.Random(i), 80) for i in range(2, 40)])
    case = lambda answer: decontam.find_leaks(docs, spark.createDataFrame([(1, text, answer)], "item_id bigint, text string, answer string")).count()
    assert case("november") == 1 and case("zulu") == 0


@pytest.mark.parametrize("length", [6, 10, 60, 130, 400, 1000])
def test_paraphrases_of_items_of_any_length_are_found(spark, length):
    """A twelfth of the words dropped and an eighth replaced, in the middle of a longer text."""
    rng = random.Random(length)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "l", "n", "r", "st", "nd", "ck")]
    words = lambda n: [rng.choice(vocabulary) + rng.choice(("", "", "s", "ed", "ly")) for _ in range(n)]
    items = [words(length) for _ in range(20)]
    docs = [(i, " ".join(words(rng.randrange(50, 300)))) for i in range(200)]
    for i, item in enumerate(items):
        kept = [w if rng.random() > 0.12 else words(1)[0] for w in item if rng.random() > 0.08] if length > 10 else item[1:]
        docs.append((1000 + i, " ".join(words(120) + kept + words(80))))
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(table(spark, docs), benchmark).collect()}
    assert sum((1000 + i, i) in found for i in range(20)) >= 18
    assert all(d == 1000 + i for d, i in found)


# 8 chat


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", r"<\s> <\\|im_end|>", "<<SYS>><s>\\", "[\\INST]", "", "\n\n  é\U0001f600‍<|im_start|>x"])
def test_escape_is_reversible(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROLS)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    pieces = ["hi", "\n", " ", "é\U0001f600", "</s>", "<|im_end|>", "\\", "日本語", "[INST]", "a<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\n<s>"]), "".join(rng.choices(pieces, k=rng.randrange(0, 9)))) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(100, 0, "assistant", None), (101, None, "user", "x"), (101, 0, None, "y"), (None, 0, "assistant", "null conversation"), (102, 0, "assistant", "word " * 5000), (102, 0, "assistant", "word " * 5000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(chat.with_probe(frame), BYTES)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role is not None, role or "", x is not None, x or "") for c, t, role, x in rows if c == conv))
        said = "".join(f"{role}\n{x}\n" for *_, role, _, x in turns)
        loss = "".join(x for *_, role, _, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv


# 9 near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(seed=11):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    for base in texts[:12]:
        for _ in range(rng.randrange(1, 12)):
            words = base.split()
            for _ in range(rng.randrange(0, max(1, len(words) // 15) + 2)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(5)}"
            texts.append(" ".join(words))
    passage = prose(rng, 40)
    texts += [f"{passage} {prose(rng, rng.randrange(3, 30))}" for _ in range(40)] + [texts[0].upper()] + ODD
    return list(enumerate(texts))


@pytest.mark.parametrize("k,rounds", [(16, 1), (64, 3)])
def test_near_duplicates_equal_brute_force(spark, k, rounds):
    rows = copies()
    got = near_dup.near_duplicates(table(spark, rows).repartition(4).withColumn("rep", F.lit(3)), k=k, rounds=rounds, tries=rounds).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(2)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [(4, one), (4, two), (7, one + " more"), (8, two + " more"), (9, prose(rng, 60)), (None, one), (7, one + " more")]
    docs = table(spark, rows)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("4", "4", True)] * 2 + [("7", "4", False)] * 2 + [("8", "4", False), ("9", "9", True), ("None", "None", True)])
    stay = near_dup.first_of_each(docs.withColumn("ROW_ID", F.lit(1)))
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["4", "4", "9", "None"] and stay.columns == [*docs.columns, "ROW_ID"]


def test_rows_go_by_id_and_text(spark):
    from tessitura.llm.common import text_key, without_rows

    docs = table(spark, [(1, "a"), (1, "b"), (None, "a"), (None, None), (2, ""), (2, None)])
    gone = docs.where("text = 'a' or text is null").select("doc_id", text_key().alias("text_key"))
    assert {(r["doc_id"], r["text"]) for r in without_rows(docs, gone).collect()} == {(1, "b"), (2, "")}
    assert without_rows(docs, gone.limit(0)).count() == 6 and without_rows(docs.limit(0), gone).count() == 0


LISTS = "value long, cid long, n long, c long, left long"


@pytest.mark.parametrize("members,large", [(16_000, 1), (3_000, 2), (2_000, 3)])
def test_large_components_in_one_list_make_rows_for_members_not_for_pairs(spark, members, large):
    """Some large components and an outlier in one list: at most a row for each member and other component, in seconds."""
    lists = spark.range(members * large).selectExpr("1L as value", "id as cid", "40L as n", f"id div {members} as c", "40L as left")
    lists = lists.union(spark.range(1_000_000, 1_000_001).selectExpr("1L", "id", "39L", "id", "39L"))
    began = time.time()
    got = {(r["cid"], r["other"]) for r in near_dup.list_relations(lists, near_dup.Scratch(spark, "lists")).collect()}
    assert time.time() - began < 60 and len(got) <= (members * large + 1) * large
    for c in range(large):
        assert (1_000_000, c) in got or all((i, 1_000_000) in got for i in range(c * members, (c + 1) * members))
        for d in range(c):
            assert all((i, d) in got for i in range(c * members, (c + 1) * members)) or all((i, c) in got for i in range(d * members, (d + 1) * members))


def test_list_relations_equal_brute_force(spark):
    rng = random.Random(3)
    for spread in (6, 60):
        rows = [(rng.randrange(3), i, n := rng.randrange(1, 60), rng.randrange(spread), rng.randrange(1, n + 1)) for i in range(200)]
        got = {(r["cid"], r["other"]) for r in near_dup.list_relations(spark.createDataFrame(rows, LISTS), near_dup.Scratch(spark, "lists"), block=7).collect()}
        pairs = [((a, d), (b, c)) for v, a, n, c, x in rows for w, b, m, d, y in rows if a > b and v == w and c != d and min(n, m) * 4 >= 3 * max(n, m) and 7 * min(x, y) >= 3 * (n + m)]
        assert pairs and all(one in got or other in got for one, other in pairs)  # a pair is named from one side at least
        assert got <= {relation for pair in pairs for relation in pair}


def test_links_of_blocks_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        draw = lambda: np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.integers(0, 1 << 62, rng.integers(0, 10), dtype=np.uint64)]))
        x, y = [draw() for _ in range(rng.integers(1, 9))], [draw() for _ in range(rng.integers(1, 9))]
        want = []
        for i, a in enumerate(x):
            fit = [j for j, b in enumerate(y) if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))]
            want += [(i, fit[0])] if fit else []
        assert near_dup.links_of_blocks(x, y) == want


@pytest.mark.parametrize("values,entries", [(1 << 14, 128), (300, 2)])
def test_the_exact_step_finds_every_link_between_components(spark, values, entries):
    """Every class a component of its own, as if no round of stars had found anything."""
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (5, 40, 40, 90)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[: max(1, int(len(b) * rng.uniform(0.8, 1)))], rng.integers(0, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])) for b in bases for _ in range(25)]
    of = {n: n if n % 3 else n // 6 * 6 for n in range(len(sets))}  # a few components of some classes
    frame = spark.createDataFrame([(n, s.view(np.int64).tolist()) for n, s in enumerate(sets)], "cid long, hashes array<long>")
    placed = spark.createDataFrame([(n, len(s), of[n]) for n, s in enumerate(sets)], "cid long, n long, c long")
    keep = near_dup.Scratch(spark, "exact")
    relations = near_dup.prefix_relations(frame, placed, keep)
    links = [(r["a"], r["b"]) for r in near_dup.verified_relations(relations, placed, frame, keep, values, entries).collect()]
    reach = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    assert links and all(reach(a, b) and of[a] != of[b] for a, b in links)
    joined = {frozenset((of[a], of[b])) for a, b in links}
    assert joined == {frozenset((of[a], of[b])) for a in range(len(sets)) for b in range(a) if of[a] != of[b] and reach(a, b)}


def test_retained_values_needed():
    assert near_dup.binomial_needed(64) == 21


def test_near_duplicates_odd_tables(spark):
    assert near_dup.near_duplicates(table(spark, ["x"]).limit(0)).count() == 0
    rows = near_dup.near_duplicates(table(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows)[1:] == [(2, 2), (4, 4), (4, 4)] and len(rows) == 4


def test_union_estimate_is_exact_on_whole_sets():
    a, b = np.arange(0, 40, dtype=np.uint64), np.arange(10, 50, dtype=np.uint64)
    assert near_dup.union_estimate(a, b, 64) == 30 / 50
    assert near_dup.union_estimate(a[:16], b[:16], 16) == 6 / 16
    assert near_dup.union_estimate(a[:0], a[:0], 16) == 0


# 10 language


def test_language_id(spark):
    rng = random.Random(9)
    words = {"xx": [f"{a}ka{b}" for a in "mnpt" for b in "aeiou"], "yy": [f"{a}sch{b}" for a in "bdgr" for b in "aeiou"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s", 0) for i in range(300) for lang in [("xx", "yy")[i % 2]]]
    rows += [(1000, None, "xx", "s", 0), (1001, "12 34 !", "yy", "s", 0), (1002, "nakau nakou", None, "s", 0), (1003, "", "xx", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows[:300])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "xx", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_backoff_goes_from_long_to_short():
    entries = {" know": [-1, -2], "^kn": [-3, -4], "kni": [-5, -6], "z": [-9, -8]}
    model = {"langs": ["a", "b"], "rows": {e: i for i, e in enumerate(entries)}, "table": np.array(list(entries.values()), np.float32), "prior": np.zeros(2), "max_n": 3}
    memo = langid.PieceScores(model)
    score = lambda word: memo.rows[memo[word.encode()]].tolist()
    assert score("know") == [-1, -2, 1] and score("knit") == [-4, -5, 1]  # the mean of both known 3-grams
    assert score("zip") == [-9, -8, 1] and score("qq") == [0, 0, 1] and score("12") == [0, 0, 0]


def test_language_scores_equal_a_plain_sum(spark):
    """The fit's counts and the memo against loops over words and n-grams."""
    rng = random.Random(4)
    texts = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(30)) + ". 7" for _ in range(12)] for lang, letters in (("a", "abcdé"), ("b", "cdefü"))}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in texts for t in texts[lang])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    seen = {lang: Counter() for lang in texts}
    for _, t, lang in rows:
        for w in langid.LETTERS.findall(t.lower()):
            seen[lang][(0, w)] += 1
            seen[lang].update((n, f"^{w}$"[i : i + n]) for n in range(1, 6) for i in range(len(w) + 3 - n))
    size = {lang: Counter() for lang in texts}
    for lang, c in seen.items():
        for (n, _), k in c.items():
            size[lang][n] += k
    log = lambda lang, n, e: np.log((seen[lang][(n, e)] + 0.5) / (size[lang][n] + 1))
    known = set(seen["a"]) | set(seen["b"])
    for text in ("abba cafe éü zz bcd", texts["a"][0], "cdcdcd fffff 12 x"):
        total = {}
        for lang in texts:
            total[lang] = np.log(0.5)
            for w in langid.LETTERS.findall(text.lower()):
                if (0, w) in known:
                    total[lang] += log(lang, 0, w)
                    continue
                for n in range(5, 0, -1):
                    if grams := [g for i in range(len(w) + 3 - n) if (n, g := f"^{w}$"[i : i + n]) in known]:
                        total[lang] += np.mean([log(lang, n, g) for g in grams])
                        break
        lang, score = langid.decide(langid.PieceScores(model).total(text.encode()), model)
        p = 1 / (1 + np.exp(total["b"] - total["a"]))
        assert lang == ("a" if p >= 0.5 else "b") and abs(score - max(p, 1 - p)) < 1e-4


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    names, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, sf)
        path = scratch(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert docs.columns == names and set(left) <= before and len(left) > len(before) / 2
        if name == "near_dedup":
            assert set(left) == {i for i, (_, c) in brute_components(given).items() if i == c}
        elif name == "substring_dedup":
            want = {(i, k) for i, _, gone, k in brute_removal(given) if gone}
            assert all((i, hashlib.sha256((left[i] or "").encode()).hexdigest()) in want or left[i] == t for i, t in given)
            assert {i for i, _ in want} == {i for i, t in given if left[i] != t}
        elif name == "decontamination":
            leaks = leaks_everywhere(table(spark, given), items)
            gone = {i for i, _ in given} - set(left)
            assert gone <= {i for i, _ in leaks} and len(gone) >= 0.9 * len({i for i, _ in leaks})
        before = set(left)
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == before


@pytest.mark.parametrize("name", ["toxicity", "media", "packing", "counts", "quality", "leaks", "language"])
def test_odd_rows_ids_and_columns(spark, name):
    """Null ids and texts, repeated rows, columns named like the operator's own, and an empty table."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(random.Random(1), 20)), (None, "x")], "item_id bigint, text string")
    run = {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels), "media": lambda d: media.media_columns(d, scratch(spark, "m")), "packing": lambda d: packing.pack_documents(d, WORD_BPE),
        "counts": lambda d: token_counts.count_tokens(d, PIECES, token_counts.new_cache(spark)), "quality": lambda d: quality.score_quality(d, labels), "leaks": lambda d: decontam.find_leaks(d, items), "language": langid.language_id,
    }[name]
    rng = random.Random(6)
    rows = [(i, prose(rng, 40)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (None, prose(random.Random(1), 20)), (7, "another text"), (7, "another text")]
    docs = table(spark, rows)
    for c in ("score", "PREDICTED", "held_out", "payload", "digest", "key", "n_tokens", "tier", "words", "text_key", "raw", "n_bytes"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = run(docs).select("doc_id").collect()
    if name == "leaks":
        assert None in {r["doc_id"] for r in got}
    elif name == "packing":
        assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    else:
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert run(docs.limit(0)).count() == 0


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.format_conversations(empty, BYTES)).count() == 0

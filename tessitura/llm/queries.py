"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .chat import digests, format_conversations, with_probe
from .common import scratch, table
from .decontam import find_leaks
from .langid import language_id
from .lexical import build_index, search
from .media import media_columns
from .near_dup import near_duplicates
from .packing import pack_documents
from .pieces import round_trip
from .quality import score_quality
from .resampling import resample
from .substring import remove_repeats
from .token_counts import count_tokens, new_cache
from .toxicity import score_toxicity


def op1_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_columns(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"), scratch(spark, "media"))


def op3_substring_dedup(spark, sf_dir):
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_cache(spark))


def op6_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark, sf_dir):
    return digests(format_conversations(with_probe(table(spark, sf_dir, "conversations")), public_tokenizers.path("byte_bpe_50k.json")))


def op9_minhash_near_dup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark, sf_dir):
    coded = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lexical_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents"), scratch(spark, "lexical")), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_media_columns, op3_substring_dedup, op4_packing, op5_token_counts, op6_quality, op7_decontamination, op8_chat_formatting, op9_minhash_near_dup, op10_language_id, op11_sentencepiece, op12_importance_resampling, op13_lexical_search)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 bit by bit: a table of the 256 bytes by eight halvings, then one look-up a byte of each distinct word
OP12 = rf"""
with crc_table as (
  select list(c order by i) as crc_of from (
    select i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
texts as (
  select 'd' as side, doc_id, {_LOWER} as text from documents union all select 't', null, {_LOWER} from benchmark),
words as (
  select side, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts),
hexed as (
  select word, hex(encode(word)) as h from (select distinct word from words)),
buckets as (
  select word, xor(list_reduce([4294967295] || list_transform(range(0, len(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 2]) - 1), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from hexed, crc_table),
counted as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from words join buckets using (word) group by bucket),
totals as (
  select sum(s)::bigint as s_all, sum(t)::bigint as t_all from counted),
gains as (
  select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from counted, totals),
weights as (
  select doc_id, count(*) as n_features, sum(gain)::bigint as weight from words join buckets using (word) join gains using (bucket) where side = 'd' group by doc_id),
hashes as (
  select doc_id, list_reduce([0] || list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1), lambda v, x: v * 16 + x) as h from documents),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
  from hashes left join weights using (doc_id)),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from placed
"""

OP13 = rf"""
with texts as (
  select 'd' as side, doc_id as id, {_LOWER} as text from documents union all select 'q', item_id, {_LOWER} from benchmark),
terms as (
  select side, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from texts),
held as (
  select side, id, term, count(*) as tf from terms group by side, id, term),
lengths as (
  select id as doc_id, count(*) as n from terms where side = 'd' group by id),
totals as (
  select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from held, totals where side = 'd' group by term, n_docs),
norms as (
  select doc_id, 75 + (25 * n * n_docs) // n_terms as m from lengths, totals),
scores as (
  select q.id as item_id, d.id as doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m)))::bigint as score
  from held q join held d on q.term = d.term and q.side = 'q' and d.side = 'd' join weights on weights.term = q.term join norms on norms.doc_id = d.id group by q.id, d.id),
placed as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from scores where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 20
"""

ORACLES: dict[str, str] = {"op12_importance_resampling": OP12, "op13_lexical_search": OP13}

"""The queries of this subpackage, over whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, licenses, quality, simhash, suffix_dedup, token_counts, urls
from .util import read

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The contract's rules: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(read(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    pieces = langid.piece_list(public_tokenizers.path(RANKS))
    langs, prob = langid.fit(docs.where("not held_out").select("lang", "text"), pieces)
    return langid.predict(docs, pieces, langs, prob).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.apply_rules(read(spark, sf_dir, "pages"), urls.rules_frame(spark, URL_RULES))


OP5_SQL = r"""
with p as (
  select page_id,
    coalesce(translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as h,
    coalesce(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', 2), '') as q,
    coalesce(strpos(url, '://'), 0) > 0 as ok
  from pages),
u as (select page_id, case when ok then h else '' end as host, case when ok then q else '' end as path from p),
r(rule, rhost, rpath, verdict) as (values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
f as (
  select page_id, host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all)
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from u left join f on u.page_id = f.page_id and u.host = f.host and u.path = f.path
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).select("doc_id", "license", F.round("score", 6).alias("score"), "n_matches")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op8_near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches, which the SQL of op8_decontaminate has no column for."""
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=5)
    items = F.array_join(F.array_sort(F.col("near_items").cast("array<string>")), ",")
    return found.select("doc_id", F.size("near_items").cast("long").alias("n_near"), F.sha2(items.cast("binary"), 256).alias("near_sha256"))


OP8_SQL = r"""
with dw as (select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') as w0 from documents),
d as (select doc_id, list_filter(w0, lambda x: x <> '') as w from dw),
bw as (select item_id, list_filter(string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') as w from benchmark),
b as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as k from bw where len(w) > 0)),
sizes as (select distinct n from b),
dg as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
m as (select dg.doc_id, dg.k, dg.n, b.item_id from dg join b on dg.n = b.n and dg.g = b.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from m) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from m) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits that are the same for every document: an insertion in the middle, a
    replacement of five characters at a third, and an appended line."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(s).alias("text"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    docs = read(spark, sf_dir, "documents").withColumn("edits", F.array(edit(half, half, "inserted words, "), edit(third, third + 5, "new"), edit(n + 100, n + 100, "\nThe end.")))
    return token_counts.count_edited(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(chat.text_parts(rows.unionByName(extra))))


OP10_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as t, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') as r from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, r, t)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, r, t) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(r) + length(t) + 12 + 1 + 11) as bigint) as formatted_chars
from e group by conv_id
"""


def queries() -> dict:
    ops = [op1_suffix_dedup, op2_language_id, op3_simhash, op4_byte_bpe, op5_url_filter, op6_license_scan, op7_quality_crf, op8_decontaminate, op8_near_items, op9_token_counts, op10_chat_format]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op8_decontaminate": OP8_SQL, "op10_chat_format": OP10_SQL}

"""More registered queries, over the same tables: ingestion, stores, query rewriting, rerankers, routing, memory tiers,
indexing, evaluation and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import shared_folder
from ..operators import assemble as A
from ..operators import chunking as C
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import indexing as I
from ..operators import memory as M
from ..operators import observe as O
from ..operators import retrieval as R
from ..operators import rewrite as Q
from ..sources import ingest as S
from ..sources import stores
from ..streaming import windows as X
from . import catalog as base
from .catalog import AS_OF, COS, EDGES, ENTRIES, FIXED, ITEMS, OVERLAP, PACKED, QS, TURNS, as_of, bench, bm25_sql, edges, entries, events, fused_sql, items, knn_sql, query, table, turns, vectors


@query(f"""with {FIXED}, c as (select id, i, array_to_string(w[i * 54 + 1:i * 54 + 64], ' ') as body, count(*) over (partition by id) as total from ch)
select c.id || '-chunk-' || i as chunk_id, c.id as parent_doc_id, total as total_chunks, d.lang as doc_lang, d.source as doc_source, upper(d.lang) as language, md5(d.lang || ': ' || substr(d.text, 1, 20) || chr(10) || chr(10) || body) as digest, md5(body) as original, cast(len(list_filter(string_split_regex(d.lang || ': ' || substr(d.text, 1, 20) || chr(10) || chr(10) || body, '\\s+'), lambda x: x <> '')) as bigint) as token_count
from c join documents d on d.doc_id = c.id""")
def ingest_chain(spark, sf):
    """Documents through the whole chain: fixed chunks, carried and enriched metadata, a context line, a token count."""
    docs = items(spark, sf)
    made = S.ingest(docs, lambda d: C.fixed(d, 64, 10), carry=["lang", "source"], enrich=[lambda c: c.withColumn("lang", F.col("doc_lang")), lambda c: c.withColumn("language", F.upper("lang"))], context=lambda whole, chunk: F.concat(F.col("lang"), F.lit(": "), F.substring(whole, 1, 20)))
    return made.select("chunk_id", "parent_doc_id", "total_chunks", "doc_lang", "doc_source", "language", F.md5("content").alias("digest"), F.md5("original_content").alias("original"), "token_count")


@query("select event_type as kind, count(*) as n, cast(sum(case when event_id % 3 = 0 then 1 else 0 end) as bigint) as replaced, cast(count(*) filter (user_id is null) as bigint) as no_user from events where user_id <> 4 group by 1")
def store_round_trip(spark, sf):
    """Rows put, replaced by key, deleted, and read again from a versioned table."""
    store = stores.TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "event_id long, user_id long, event_type string, state string, extra int", ["event_id"], vault="main")
    rows = events(spark, sf).select("event_id", "user_id", "event_type", F.lit("first").alias("state"))
    store.put(rows)
    store.put(rows.where("event_id % 3 = 0").withColumn("state", F.lit("second")))
    store.delete(rows.where("user_id = 4").select("event_id"))
    store.vacuum()
    return store.rows().groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(F.col("state") == "second", 1)).alias("replaced"), F.count(F.when(F.col("user_id").isNull(), 1)).alias("no_user"))


@query("select doc_id, contains(text, '100%_') as a, contains(text, '***') as b, contains(text, '%%%') as c from documents")
def like_escaped(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *(F.col("text").like(stores.like_pattern(p)).alias(n) for n, p in (("a", "100%_"), ("b", "***"), ("c", "%%%"))))


@query("select event_id, cast(user_id as varchar) as user_id, event_type, null::double as weight from events")
def migrate_schema(spark, sf):
    return stores.migrate(events(spark, sf), "event_id long, user_id string, event_type string, weight double")


SPANS = "sp as (select 't' || user_id as trace_id, 's' || event_id as span_id, case when event_id % 5 <> 0 and lag(event_id) over w is not null then 's' || lag(event_id) over w end as parent_id, event_type as name, ts as a, ts + interval 1 second * (1 + event_id % 7) as b from events window w as (partition by user_id order by ts, event_id))"


def spans(spark, sf):
    from pyspark.sql import Window as W

    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = events(spark, sf).withColumn("before", before)
    return e.select(name("t", F.col("user_id")).alias("trace_id"), name("s", F.col("event_id")).alias("span_id"), F.when(F.col("event_id") % 5 != 0, name("s", F.col("before"))).alias("parent_id"), F.col("event_type").alias("name"), F.col("ts").alias("start"), (F.col("ts") + F.make_interval(secs=1 + F.col("event_id") % 7)).alias("end"))


@query(f"""with {SPANS} select trace_id, md5('{{"traceId":"' || trace_id || '","spanId":"' || span_id || '"' || coalesce(',"parentSpanId":"' || parent_id || '"', '') || ',"name":"' || name || '","startTimeUnixNano":"' || (epoch_us(a) * 1000) || '","endTimeUnixNano":"' || (epoch_us(b) * 1000) || '"}}') as digest from sp""")
def spans_json(spark, sf):
    return stores.spans_json(spans(spark, sf)).select("trace_id", F.md5("line").alias("digest"))


@query(f"""with recursive {SPANS}, d as (select trace_id, span_id, 0::bigint as depth from sp where parent_id is null union all select sp.trace_id, sp.span_id, depth + 1 from d join sp on sp.trace_id = d.trace_id and sp.parent_id = d.span_id where depth < 256),
k as (select trace_id, parent_id as span_id, sum(date_diff('microsecond', a, b) / 1e6) as below from sp where parent_id is not null group by all)
select sp.trace_id, sp.span_id, depth, round(date_diff('microsecond', a, b) / 1e6, 6) as seconds, round(date_diff('microsecond', a, b) / 1e6 - coalesce(below, 0), 6) as own_seconds from sp left join d using (trace_id, span_id) left join k using (trace_id, span_id)""")
def span_tree(spark, sf):
    return O.span_tree(spans(spark, sf), 256).select("trace_id", "span_id", "depth", T.r6("seconds").alias("seconds"), T.r6("own_seconds").alias("own_seconds"))


@query()
def cache_replay(spark, sf):
    e = events(spark, sf).select("user_id", F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "clear").when(F.col("event_id") % 2 == 0, "set").otherwise("get").alias("op"), F.pmod(F.floor(F.col("event_id") / 100), F.lit(4)).alias("key"), (F.unix_micros("ts") / 1e6).alias("at"))
    return O.cache_replay(e, 20 * 86_400, 3, "user_id").select("user_id", "seq.event_id", "op", "hit")


@query("""with l as (select user_id, event_id // 3 as call, min(ts) filter (event_type = 'view') as started_at, min(ts) filter (event_type = 'click') as finished_at from events group by all)
select user_id, call, started_at, round(date_diff('microsecond', started_at, finished_at) / 1e6, 6) as seconds from l where started_at is not null""")
def event_calls(spark, sf):
    e = events(spark, sf).withColumn("call", F.floor(F.col("event_id") / 3))
    return O.correlate(e, "user_id", "call", "event_type", "view", "click", "ts").select("user_id", "call", F.col("started_at").cast("timestamp_ntz").alias("started_at"), T.r6("seconds").alias("seconds"))


@query("with e as (select event_id, floor(value) as prompt, user_id % 5 as r, user_id % 3 as w, case user_id % 3 when 0 then 3.0 when 1 then 0.25 end as i, case user_id % 3 when 0 then 15.0 when 1 then 1.25 end as o from events) select event_id, round((i * (greatest(0, prompt - r - w) + 0.1 * r + 1.25 * w) + o * 10) / 1e6, 9) as cost from e")
def round_costs(spark, sf):
    prices = spark.createDataFrame([("model-0", 3.0, 15.0), ("model-1", 0.25, 1.25)], "name string, input_price double, output_price double")
    rounds = events(spark, sf).select("event_id", F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"), F.lit("-2025-01-01")).alias("model"), F.floor("value").alias("prompt"), F.lit(10).alias("completion"), (F.col("user_id") % 5).alias("cache_read"), (F.col("user_id") % 3).alias("cache_write"))
    return O.round_cost(prices, rounds).select("event_id", F.round("cost", 9).alias("cost"))


# Queries into queries
@query("select item_id as query_id, md5('A text on: ' || lower(text)) as digest from benchmark")
def hyde(spark, sf):
    return Q.hypothetical(bench(spark, sf), lambda t: F.concat(F.lit("A text on: "), F.lower(t))).select("query_id", F.md5("text").alias("digest"))


@query("with v as (select item_id as query_id, 0 as n, text from benchmark union all select item_id, 1, 'In general: ' || split_part(text, '.', 1) from benchmark where trim('In general: ' || split_part(text, '.', 1)) <> '') select query_id, cast(n as bigint) as n, md5(trim(text)) as digest from v")
def step_back(spark, sf):
    return Q.step_back(bench(spark, sf), lambda t: F.concat(F.lit("In general: "), F.substring_index(t, ".", 1))).select("query_id", "n", F.md5(F.trim("text")).alias("digest"))


@query("with p as (select item_id as query_id, trim(unnest(string_split(text, '.'))) as t, generate_subscripts(string_split(text, '.'), 1) as i from benchmark), f as (select query_id, t, min(i) as i from p where t <> '' group by all), l as (select query_id, lower(t) as t, min(row(i, 0)) as i from f group by all) select query_id, row_number() over (partition by query_id order by i) - 1 as n, md5(t) as digest from l")
def rewrite_chain(spark, sf):
    """Sub-questions, each lower-cased by a second step; repeats keep the first."""
    split = lambda q: Q.decompose(q, lambda t: F.split(t, r"\."))
    return Q.chain(bench(spark, sf), split, lambda q: Q.hypothetical(q, F.lower)).select("query_id", "n", F.md5("text").alias("digest"))


@query("""with h as (select conv_id, list({'turn': turn, 's': role || ': ' || text} order by turn) as l from conversations where turn < 4 group by 1), q as (select c.conv_id as query_id, c.turn, c.text, list_transform(l, lambda x: x.s) as l from conversations c left join h using (conv_id) where c.turn >= 4 and c.role = 'user')
select query_id, turn, md5(case when l is null then text else array_to_string(l[greatest(1, len(l) - 1):len(l)], ' | ') || ' | ' || text end) as digest from q""")
def history_prefix(spark, sf):
    t = turns(spark, sf)
    past = t.where("turn < 4").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("history"))
    q = t.where("turn >= 4 and role = 'user'").join(past, "conv_id", "left").select(F.col("conv_id").alias("query_id"), "turn", "text", "history")
    return Q.with_history(q, last=2).select("query_id", "turn", F.md5("text").alias("digest"))


# Rerankers and routes
@query(bm25_sql(k=20, out="query_id, id, score").replace("select query_id, id, score from rk where rank <= 20", """, r1 as (select rk.query_id, rk.id, length(it.content) as size, row_number() over (partition by rk.query_id order by length(it.content), rk.id) as r from rk join it on it.id = rk.id where rank <= 20),
r2 as (select query_id, id, size, row_number() over (partition by query_id order by id % 7 desc, id) as rank from r1)
select query_id, id, cast(size as bigint) as size, rank from r2 where rank <= 5"""))
def rerank_chain(spark, sf):
    c = R.bm25(bench(spark, sf), items(spark, sf), 20).join(items(spark, sf).select("id", F.length("content").alias("size")), "id")
    by_size = lambda d: R.rerank(d, -F.col("size").cast("double"))
    by_id = lambda d: R.rerank(d, (F.col("id") % 7).cast("double"))
    return R.rerank_chain(c, [by_size, by_id], 5).select("query_id", "id", F.col("size").cast("long").alias("size"), "rank")


@query(knn_sql().replace("where rank <= 10 and true", "where rank <= 10").replace("select query_id, id, score, rank from (", "with k as (select query_id, id, score, rank from (", 1) + ") select query_id, id, round(1.0 / rank, 6) as score, row_number() over (partition by query_id order by rank desc) as rank from k where rank % 2 = 0")
def rerank_results(spark, sf):
    """A service gives every second candidate, the last first, one index that is out of range and one that comes twice."""
    q, e = vectors(spark, sf)
    found = R.knn(q, e)
    given = found.where("rank % 2 = 0").select("query_id", (10 - F.col("rank")).alias("pos"), (F.col("rank") - 1).alias("index"), (1.0 / F.col("rank")).alias("score"))
    extra = found.where("rank = 1").select("query_id", F.explode(F.array(F.struct(F.lit(20).cast("long").alias("pos"), F.lit(99).cast("long").alias("index")), F.struct(F.lit(21).cast("long").alias("pos"), F.lit(1).cast("long").alias("index")))).alias("x"), F.lit(0.5).alias("score")).select("query_id", "x.*", "score")
    return R.rerank_results(found, given.unionByName(extra)).select("query_id", "id", T.r6("score").alias("score"), "rank")


ROUTED = "with a as (" + bm25_sql() + "), b as (with " + ITEMS + ", " + QS + ", " + OVERLAP + " select query_id, id, score, rank from ovk where rank <= 5) select * from a where query_id % 2 = 0 union all select * from b where query_id % 2 = 1"


@query(ROUTED)
def routed_retriever(spark, sf):
    i = items(spark, sf)
    label = F.when(F.col("query_id") % 2 == 0, "words").otherwise("unknown")
    return R.routed(bench(spark, sf), label, {"words": lambda q: R.bm25(q, i), "terms": lambda q: R.overlap(q, i, 5)}, "terms").select("query_id", "id", "score", "rank")


@query(f"""with {ITEMS}, vs as (select item_id as query_id, n, list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '') as w from (select item_id, 0 as n, text as t from benchmark union all select item_id, 1, trim(split_part(text, '.', 1)) from benchmark where trim(split_part(text, '.', 1)) not in ('', text))),
ov as (select query_id, n, id, round(count(*) / max(k), 6) as score from (select distinct id, unnest(w) as term from it) join (select query_id, n, unnest(list_distinct(w)) as term, len(list_distinct(w)) as k from vs) using (term) group by all),
rk as (select *, row_number() over (partition by query_id, n order by score desc, id) as rank from ov),
f as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as rrf from rk where rank <= 20 group by all)
select query_id, id, rrf, row_number() over (partition by query_id order by rrf desc, id) as rank from f qualify rank <= 10""")
def variants_fused(spark, sf):
    v = Q.step_back(bench(spark, sf), lambda t: F.substring_index(t, ".", 1))
    return R.fused_variants(v, lambda q: R.overlap(q, items(spark, sf), 20), 10).select("query_id", "id", "rrf", "rank")


@query(knn_sql())
def knn_ivf(spark, sf):
    """The inverted-file index with all of its lists probed, which is exact."""
    q, e = vectors(spark, sf)
    return R.IvfIndex(e, 16).search(q, 10, 16)


@query(knn_sql().replace("where rank <= 10 and true", "where rank <= 10").replace("select query_id, id, score, rank from (", "with k as (select query_id, id, score, rank from (", 1) + ") select k.query_id, k.id, k.score as raw_score, greatest(0, least(1, k.score)) as score, 'dense' as retrieval_method, d.lang from k join documents d on d.doc_id = k.id where d.doc_id % 3 <> 0")
def resolved_hits(spark, sf):
    q, e = vectors(spark, sf)
    held = items(spark, sf).where("id % 3 <> 0").withColumn("score", F.lit(9))
    return R.resolve(R.knn(q, e), held, "dense").select("query_id", "id", "raw_score", "score", "retrieval_method", "lang")


@query(fused_sql(PACKED.replace("512", "300") + "select query_id, cast(coalesce(sum(tokens) filter (included), 0) as bigint) as tokens, count(*) filter (included) as kept from p group by 1").replace("from fk)\n,", "from fk),"))
def token_budget(spark, sf):
    i = items(spark, sf).withColumn("tokens", T.token_count("content"))
    found = base.fused(spark, sf).select("query_id", "id", "score").join(i.select("id", "tokens"), "id").withColumns({"priority": F.lit(5), "source": F.lit("retrieval")})
    packed = A.TokenBudget(350, 50).apply(found)
    return packed.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("included"), F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.count(F.when(F.col("included"), 1)).alias("kept"))


# Memory
@query(f"""with {ENTRIES}, q as (select 1 as query_id, ['click', 'user'] as w union all select 2, ['error']), h as (select 1 as query_id, id, 0.9 as s from en where id % 10 = 0 order by id limit 30),
r as (select q.query_id, en.id, round(coalesce(h.s, len(list_filter(w, lambda t: contains(lower(content), t))) / len(w)), 6) as relevance, round(0.3 * exp(-ln(2) / 604800.0 * greatest(hours * 3600, 0)) + 0.5 * coalesce(h.s, len(list_filter(w, lambda t: contains(lower(content), t))) / len(w)) + 0.2 * relevance_score, 6) as score from en cross join q left join h on h.query_id = q.query_id and h.id = en.id)
select query_id, id, cast(relevance as double) as relevance, score, row_number() over (partition by query_id order by score desc, id) as rank from r qualify rank <= 10""")
def scored_memory(spark, sf):
    e = entries(spark, sf)
    q = spark.createDataFrame([(1, "click user"), (2, "error")], "query_id int, text string")
    near = e.where("id % 10 = 0").select(F.lit(1).alias("query_id"), "id", F.lit(0.9).alias("score"))
    return M.scored_entries(q, e, R.rank_by(near, ["query_id"], ["id"]), 10, R.recency_half_life(F.col("hours") * 3600))


@query(f"with {TURNS}, a as (select *, sum(tokens) over (partition by conv_id order by turn desc rows unbounded preceding) as held from tn) select conv_id, turn, cast(case when held <= 100 then 0 when held <= 300 then 1 when held <= 700 then 2 else 3 end as bigint) as tier from a")
def memory_tiers(spark, sf):
    return M.tiers(turns(spark, sf), 200).select("conv_id", "turn", "tier")


@query()
def memory_progressive(spark, sf):
    t = M.tiers(turns(spark, sf), 200)
    first = lambda text, budget: F.array_join(F.slice(T.words(text), F.lit(1), budget), " ")
    return M.progressive(t, 200, first, lambda text: F.filter(F.split(text, r"\."), lambda s: F.trim(s) != "")).select("conv_id", "tier", "content", F.array_join("facts", "|").alias("facts"))


@query(f"with {TURNS}, a as (select *, sum(tokens) over (partition by conv_id order by turn desc rows unbounded preceding) as held from tn), s as (select conv_id, coalesce(min(turn) filter (role = 'user' and held <= 80), max(turn) filter (role = 'user')) as cut from a group by 1) select conv_id, turn, coalesce(turn < cut, false) as compact from tn join s using (conv_id)")
def compaction_split(spark, sf):
    return M.compaction_split(turns(spark, sf), 80).select("conv_id", "turn", "compact")


@query(f"with {ENTRIES} select id, access_count + case when id % 4 = 0 then 1 else 0 end as access_count, case when id % 6 = 0 and (expires_at is null or expires_at > timestamp '{AS_OF}') then timestamp '{AS_OF}' else expires_at end as expires_at from en")
def touch_invalidate(spark, sf):
    e = entries(spark, sf).select("id", "access_count", "expires_at")
    out = M.invalidate(M.touch(e, e.where("id % 4 = 0"), as_of()), e.where("id % 6 = 0"), as_of())
    return out.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("with f as (select conv_id, turn, trim(unnest(string_split(text, '.'))) as content, case when role = 'user' then 'fact' else 'other' end as kind from conversations), g as (select * from f where content <> '' and kind = 'fact') select conv_id, md5(content) as digest, kind, cast(min(turn) as bigint) as seen_at from g group by all")
def extract_facts(spark, sf):
    facts = lambda role, text: F.transform(F.split(text, r"\."), lambda s: F.struct(s.alias("content"), F.when(role == "user", "fact").otherwise("other").alias("kind")))
    return M.extract(turns(spark, sf), facts, ("fact", "preference")).select("conv_id", F.md5("content").alias("digest"), "kind", F.col("seen_at").cast("long").alias("seen_at"))


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations where role <> 'tool' and turn > conv_id % 3) where n <= 10")
def fresh_turns(spark, sf):
    t = turns(spark, sf)
    return M.fresh_turns(t, t.select("conv_id", (F.col("conv_id") % 3).alias("upto")).distinct()).select("conv_id", "turn")


@query(f"""with s as (select q.vec_id as id, e.vec_id as match, {COS} as score from embeddings q, embeddings e where q.vec_id % 50 = 0 and e.vec_id % 50 <> 0),
b as (select * from (select *, row_number() over (partition by id order by score desc, match) as r from s) where r = 1),
d as (select doc_id, md5(text) as h from documents), o as (select h, min(doc_id) as same from d where doc_id % 50 <> 0 group by 1)
select b.id, coalesce(same, case when score >= 0.6 then match end) as match, score, case when same is not null then 'NONE' when score >= 0.6 then 'UPDATE' else 'ADD' end as action from b join d on d.doc_id = b.id left join o using (h)""")
def consolidate_by_similarity(spark, sf):
    q, e = vectors(spark, sf)
    docs = items(spark, sf).select("id", "content")
    new = docs.where("id % 50 = 0").join(q.select(F.col("query_id").alias("id")), "id", "left_semi")
    return M.similarity_decisions(new, docs.where("id % 50 <> 0"), R.knn(q, e.where("id % 50 <> 0"), k=1), 0.6)


# Graph
NOTES = "nt as (select p_partkey as id, p_name as title, [p_type, p_brand] as tags, ['the ' || p_name] as aliases from part)"
KEY = "nullif(regexp_replace(regexp_replace(lower({0}), '[\\s\\-_]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


def notes(spark, sf):
    link = F.concat(F.lit("see [["), "p_type", F.lit("|type]] and [["), "p_name", F.lit("]]"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("tags"), F.array(F.concat(F.lit("the "), "p_name")).alias("aliases"), link.alias("content"))


@query(f"with {NOTES}, e as (select distinct {KEY.format('title')} as source, {KEY.format('t')} as target, id as item from (select id, title, unnest(tags) as t from nt)) select source, target, string_agg(i, ',' order by i) as evidence, count(*) as merged, 1.0::double as confidence, 'extracted' as provenance from (select source, target, cast(item as varchar) as i from e) group by 1, 2")
def graph_from_notes(spark, sf):
    return I.index_graph(I.note_graph(notes(spark, sf))[1]).select("source", "target", "evidence", "merged", "confidence", "provenance")


@query(f"select distinct {KEY.format('p_name')} as source, {KEY.format('p_type')} as target, 'links_to' as relation, p_partkey as item from part where p_name <> p_type")
def graph_links(spark, sf):
    return I.link_edges(notes(spark, sf))


@query(f"""with a as (select p_partkey as item, {KEY.format('p_name')} as source, {KEY.format('p_brand')} as target, 'made_by' as relation, case p_partkey % 3 when 0 then 'extracted' when 1 then 'ambiguous' else 'guess' end as p, p_partkey % 13 / 10.0 as c from part)
select item, source, target, relation, case when p = 'extracted' then p else 'ambiguous' end as provenance, cast(case when p = 'extracted' then least(1, c) else least(0.3, c) end as double) as confidence from a""")
def graph_from_answers(spark, sf):
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(F.lit("extracted"), F.lit("ambiguous"), F.lit("guess")), (F.col("p_partkey") % 3 + 1).cast("int"))
    one = F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.lit("Made by").alias("relation"), kind.alias("provenance"), (F.col("p_partkey") % 13 / 10).alias("confidence"))
    bad = F.struct(F.lit(" - ").alias("source"), F.col("p_brand").alias("target"), F.lit("x").alias("relation"), kind.alias("provenance"), F.lit(1.0).alias("confidence"))
    answers = p.select(F.col("p_partkey").alias("item"), F.to_json(F.struct(F.array(one, bad).alias("relations"))).alias("answer"))
    return I.extracted_edges(answers.union(answers.limit(1).withColumn("answer", F.lit("no json")))).select("item", "source", "target", "relation", "provenance", "confidence")


@query("with e as (select distinct l_suppkey as source, l_partkey as target, 'sells' as relation, l_orderkey as item from lineitem), k as (select * from e where item % 4 <> 0 union select source, target, 'sold', item from e where item % 4 = 0) select relation, count(*) as n, count(distinct item) as items from k group by 1")
def graph_refresh(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("sells").alias("relation"), F.col("l_orderkey").alias("item")).distinct()
    again = e.where("item % 4 = 0")
    return I.refresh(e, again.select("item"), again.withColumn("relation", F.lit("sold"))).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))


@query()
def louvain(spark, sf):
    return I.louvain(G.adjacency(edges(spark, sf)), 2, 4)


# Evaluation
@query("select label as case, label % 2 = 0 or label >= 7 as passed, cast(case when label % 2 = 1 and label < 7 then 1 else 0 end as bigint) as missing, cast(0 as bigint) as forbidden, true as size_ok from (select distinct cast(label as bigint) as label from embeddings)")
def consolidation_replay(spark, sf):
    c = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("case")).distinct()
    want = F.when((F.col("case") % 2 == 1) & (F.col("case") < 7), F.array(F.lit("KEPT"), F.lit("absent"))).otherwise(F.array(F.lit("kept")))
    cases = c.select("case", want.alias("must_have"), F.array(F.lit("gone")).alias("must_not"), F.lit(2).alias("most"))
    return E.replay_consolidation(cases, c.select("case", F.explode(F.array(F.lit("is Kept"), F.lit("other"))).alias("content")))


@query(f"with {ITEMS}, {QS}, {OVERLAP} select query_id as case, round(least(1, score), 6) as faithfulness, cast(rank as double) / 20 as relevancy, null::double as recall from ovk")
def rag_scores(spark, sf):
    o = R.overlap(bench(spark, sf), items(spark, sf), 20)
    answers = o.select(F.col("query_id").alias("case"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.array(F.col("score"), F.col("rank").cast("double")).alias("contexts"))
    return E.rag_scores(answers, faithfulness=lambda q, a, c: c[0], relevancy=lambda q, a, c: c[1] / 20, recall=None).select("case", T.r6("faithfulness").alias("faithfulness"), "relevancy", "recall")


@query(base.METRICS.join(["with ", " select query_id, precision, recall, case when query_id % 100 = 0 then 0.5 end as judged from ev"]))
def evaluate_pipeline(spark, sf):
    q, e = vectors(spark, sf)
    rel = q.select("query_id", "label").join(e.select("id", "label"), "label").select("query_id", "id")
    got = E.evaluate_pipeline(q.select("query_id", "embedding"), lambda c: R.knn(c, e), rel, 10, {"judged": lambda c: c.where("query_id % 100 = 0").select("query_id", F.lit(0.5).alias("score"))})
    return got.select("query_id", T.r6("precision").alias("precision"), T.r6("recall").alias("recall"), "judged")


@query("with m as (select max(ts) - interval 10 minute as w from events), g as (select user_id, count(*) as n, max(ts) as last from events group by 1) select user_id, n from g, m where last + interval 1 hour <= w")
def stream_expiring(spark, sf):
    """Keys whose last event is an hour old by the watermark; what the end of the stream leaves alive has no row."""
    return base._drain(X.expiring(base._stream(spark, sf), "user_id", 3600)).select("user_id", "n")


@query("select doc_id, length(substr(text, 1, 40)) as chars, true as same from documents")
def answer_json(spark, sf):
    """JSON cut out of answers: fenced, bare, and none at all."""
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.substring("text", 1, 40).alias("t"))).alias("j"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("It is "), "j", F.lit(" as asked.")))
    got = d.withColumns({"a": T.json_of(said), "none": T.json_of(F.lit("no answer"))})
    return got.select("doc_id", F.length(F.get_json_object("a", "$.t")).cast("long").alias("chars"), ((F.col("a") == F.col("j")) & F.col("none").isNull()).alias("same"))


@query(f"with {base.PARENTS}, h as (select id, sha256(array_to_string(pw, ' '))[1:16] as pid, array_to_string(pw, ' ') as body, ci from ki where ci % 2 = 1) select id as doc, pid as parent_id, cast(min(ci) as bigint) as child_index, md5(any_value(body)) as digest from h group by id, pid")
def parent_texts(spark, sf):
    docs = items(spark, sf)
    kids = C.parent_child(docs, 128, 32).where("child_index % 2 = 1").withColumn("score", F.lit(0.5))
    parents = C.fixed(docs, 128, 0).select(F.col("id").alias("doc"), F.substring(F.sha2("content", 256), 1, 16).alias("parent_id"), "content")
    return C.expand_parents(kids, parents).select("doc", "parent_id", "child_index", F.md5("content").alias("digest"))


@query()
def embed_hashed(spark, sf):
    """Documents embedded by hashed words, and each one's nearest other among those whose id is divisible by 50."""
    e = G.saved(R.embed(items(spark, sf).select("id", "content"), R.hashed_words(64)).select("id", "embedding").where("embedding is not null"))
    tasks = max(spark.sparkContext.defaultParallelism, e.count() // 50_000)  # so many that each has items enough to rule others out by
    return R.knn(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e.coalesce(tasks), 2)

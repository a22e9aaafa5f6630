"""Conversation windows, eviction, decay, consolidation and garbage collection of memory entries."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import clamp, token_count, words
from .fold import ordered_fold


def fifo_window(turns: DataFrame, max_tokens: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns that a first-in-first-out window of max_tokens still holds: the longest suffix that fits."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("held", F.sum(F.least("tokens", F.lit(max_tokens))).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("held") <= max_tokens).drop("held")


def position_scores(turns: DataFrame, rate: float = 2.0, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """score 0.5 to 1 by position (a single turn: 0.5), and linear and exponential recency (a single turn: 1)."""
    n = F.count("*").over(W.partitionBy(key))
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    x = i / F.nullif(n - 1, F.lit(0))
    one = F.lit(1.0)
    return turns.withColumns({"score": F.bround(F.coalesce(0.5 + 0.5 * x, F.lit(0.5)).cast("double"), 4), "linear": F.coalesce(x.cast("double"), one), "exponential": F.coalesce((F.exp(rate * x) - 1) / (F.exp(F.lit(rate)) - 1), one)})


def evict_prefix(rows: DataFrame, order: list, to_free: int, key: str = "conv_id") -> DataFrame:
    """`evicted`: rows in eviction order until to_free tokens are freed."""
    before = F.sum("tokens").over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    return rows.withColumn("evicted", before < to_free)


def pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """`pair`: a user turn and the assistant turn right behind it share a number, others stand alone."""
    w = W.partitionBy(key).orderBy(order)
    second = (F.col("role") == "assistant") & (F.lag("role").over(w) == "user")
    return turns.withColumn("pair", F.sum(F.when(second, 0).otherwise(1)).over(w))


def ebbinghaus(hours: Column, accesses: Column, strength: float = 24.0, factor: float = 12.0) -> Column:
    return clamp(F.exp(-hours / (F.lit(strength) + accesses * factor)))


def linear_decay(hours: Column, half_life: float = 168.0) -> Column:
    return clamp(1 - hours / (2 * half_life))


def by_hash(new: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """New entries whose content the store doesn't have, one for each content (the smallest id)."""
    fresh = new.withColumn("content_hash", F.md5(content))
    first = fresh.withColumn("n", F.row_number().over(W.partitionBy("content_hash").orderBy("id"))).where("n = 1").drop("n")
    return first.join(store.select(F.md5(content).alias("content_hash")).distinct(), "content_hash", "left_anti")


def merge_entries(rows: DataFrame, key: str) -> DataFrame:
    """Entries of a key as one: the longest content (ties: the newest), all tags, one more access for each, the best relevance."""
    return rows.groupBy(key).agg(F.max_by("content", F.struct(F.length("content"), "created_at", "id")).alias("content"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"), (F.sum("access_count") + F.count("*") - 1).cast("long").alias("access_count"), F.max("relevance_score").alias("relevance_score"))


def collect_garbage(entries: DataFrame, retention: Column, retained_below: float, as_of: Column, hours: Column) -> DataFrame:
    """`state` of each entry: expired past its retention, expired, decayed or live. Only live entries can decay."""
    gone = F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of)
    return entries.withColumn("state", F.when(gone & (F.col("expires_at") + retention <= as_of), "purged").when(gone, "expired").when(ebbinghaus(hours, F.col("access_count")) < retained_below, "decayed").otherwise("live"))


def sliding_memory(turns: DataFrame, max_tokens: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """`evicted_so_far` after each turn, as the window takes them one by one."""

    def start() -> dict:
        return {"held": deque(), "sum": 0, "out": 0}

    def step(state: dict, row: dict) -> int:
        t = min(row["tokens"] or 0, max_tokens)
        while state["held"] and state["sum"] + t > max_tokens:
            state["sum"] -= state["held"].popleft()
            state["out"] += 1
        state["held"].append(t)
        state["sum"] += t
        return state["out"]

    return ordered_fold(turns, [key], [order], ["tokens"], start, step, "evicted_so_far", LongType())


def apply_decisions(store: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """The store after decisions(action, and its columns): ADD and UPDATE write their row, DELETE expires the store's
    row as of now (one that isn't there, or has expired, stays as it is), NONE does nothing. One decision an id."""
    written = decisions.where(F.col("action").isin("ADD", "UPDATE")).select(store.columns)
    gone = decisions.where("action = 'DELETE'").select("id", F.lit(True).alias("gone"))
    ends = F.when(F.col("gone") & F.coalesce(F.col("expires_at") > as_of, F.lit(True)), as_of).otherwise(F.col("expires_at"))
    kept = store.join(written.select("id"), "id", "left_anti").join(gone, "id", "left").withColumn("expires_at", ends)
    return kept.select(store.columns).unionByName(written)


def consolidation_candidates(hits: DataFrame, gate: float = 0.3, cap: int = 20) -> DataFrame:
    """hits(query_id, id, score, rank) that a decision is asked about: facts whose best hit reaches the gate, and only the
    first `cap` distinct entries in order of fact and rank. A fact without rows here is added as it is."""
    best = F.max("score").over(W.partitionBy("query_id"))
    near = hits.withColumn("best", best).where(F.col("best") >= gate).drop("best")
    first = near.groupBy("id").agg(F.min(F.struct("query_id", "rank")).alias("at")).orderBy("at", "id").limit(cap)
    return near.join(F.broadcast(first.select("id")), "id", "left_semi").select(hits.columns)


def touch(entries: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Entries that used(id) names have one access more and were accessed now."""
    hit = F.col("_hit").isNotNull()
    marked = entries.join(used.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    stamped = {"access_count": F.col("access_count") + F.when(hit, 1).otherwise(0)}
    if "last_accessed" in entries.columns:
        stamped["last_accessed"] = F.when(hit, now).otherwise(F.col("last_accessed"))
    return marked.withColumns(stamped).select(entries.columns)


def invalidate(entries: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Entries that gone(id) names end now, if they haven't ended yet."""
    marked = entries.join(gone.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    live_yet = F.coalesce(F.col("expires_at") > now, F.lit(True))
    return marked.withColumn("expires_at", F.when(F.col("_hit").isNotNull() & live_yet, now).otherwise(F.col("expires_at"))).select(entries.columns)


def scored_entries(queries: DataFrame, entries: DataFrame, hits: DataFrame, k: int, recency: Column, weights: tuple[float, float, float] = (0.3, 0.5, 0.2), digits: int = 6) -> DataFrame:
    """(query_id, id, relevance, score, rank): a query's k best entries by recency, relevance and importance.

    hits(query_id, id, score, rank) are vector hits: of the first 3k of a query the clamped cosine is the relevance, of
    all other entries it is the share of the query's words that they contain. Every entry is a candidate, as its recency
    counts; queries come in a frame that is counted and small enough to broadcast.
    """
    from ..functions.text import keyword_overlap
    from .retrieval import FEW_TERMS, memory_score, top_k

    if queries.limit(FEW_TERMS + 1).count() > FEW_TERMS:
        raise ValueError(f"more than {FEW_TERMS} queries at once")
    near = hits.where(F.col("rank") <= 3 * k).select("query_id", "id", clamp("score").alias("near"))
    pairs = entries.join(F.broadcast(queries.select("query_id", "text"))).join(near, ["query_id", "id"], "left")
    relevance = F.coalesce("near", keyword_overlap("text", "content"))
    scored = pairs.select("query_id", "id", F.round(relevance, digits).alias("relevance"), F.round(memory_score(recency, relevance, F.col("relevance_score"), weights), digits).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), "id"], k)


def entry_items(found: DataFrame, entries: DataFrame, priority: int = 7) -> DataFrame:
    """Found entries as context items of source memory; their score is the entry's own relevance, not the composite one."""
    told = entries.select("id", "content", clamp("relevance_score").alias("own"))
    return found.join(told, "id").select("query_id", "id", "content", F.col("own").alias("score"), F.lit(priority).alias("priority"), F.lit("memory").alias("source"))


def summary_buffer(turns: DataFrame, max_tokens: int, compact: Callable[[Column], Column] | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, evicted, summary): what a window of max_tokens has let go, in order and summarised by compact(text); the text
    itself without one, or where that gives null. Conversations that let nothing go have an empty summary."""
    from .assemble import joined

    held = fifo_window(turns, max_tokens, key, order).select(key, order, F.lit(True).alias("_kept"))
    out = F.col("_kept").isNull()
    gone = turns.join(held, [key, order], "left").groupBy(key).agg(F.count(F.when(out, 1)).alias("evicted"), joined(order, text, " ", out).alias("whole"))
    return gone.select(key, "evicted", (F.col("whole") if compact is None else F.coalesce(compact(F.col("whole")), "whole")).alias("summary"))


#: Share of the budget of each tier: turns as they are, summaries, shorter summaries, facts.
TIERS = (0.5, 0.25, 0.125, 0.0625)


def tiers(turns: DataFrame, max_tokens: int, key: str = "conv_id", order: str = "turn", ratio: float = 0.25) -> DataFrame:
    """turns with `tier`: 0 for those that the newest tier's budget holds, then 1 and 2 for older ones, whose summaries
    take `ratio` of a tier's tokens before, and 3 for what only facts are left of. A turn is of the tier in which the
    tokens from it to the end still fit."""
    after = F.sum("tokens").over(W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    reach, total, place = [], 0.0, 1.0
    for share in TIERS[:-1]:
        total += max_tokens * share / place  # tokens of turns whose summaries fill the tier
        reach.append(total)
        place *= ratio
    tier = F.when(after <= reach[0], 0).when(after <= reach[1], 1).when(after <= reach[2], 2).otherwise(3)
    return turns.withColumn("tier", tier.cast("long"))


def progressive(tiered: DataFrame, max_tokens: int, compact: Callable[[Column, Column], Column], facts: Callable[[Column], Column], key: str = "conv_id", order: str = "turn", text: str = "text", most_facts: int = 50, fact_tokens: int = 500) -> DataFrame:
    """(key, tier, content, facts): each tier of tiers() as one text; tiers 1 and 2 through compact(text, budget), and the
    newest distinct facts(text) of tier 3 that are within most_facts and fact_tokens. Without a text from compact the
    tier is cut to its budget's words."""
    from .assemble import joined

    body = tiered.groupBy(key, "tier").agg(joined(order, text, "\n").alias("whole"))
    budget = F.element_at(F.array(*(F.lit(int(max_tokens * s)) for s in TIERS)), (F.col("tier") + 1).cast("int"))
    cut = F.array_join(F.slice(words("whole"), F.lit(1), budget), " ")
    content = F.when(F.col("tier") == 0, F.col("whole")).when(F.col("tier") < 3, F.coalesce(compact(F.col("whole"), budget), cut))
    newest = F.slice(F.reverse(F.array_distinct(F.reverse(facts(F.col("whole"))))), -most_facts, most_facts)
    newest = F.when(F.size(F.array_distinct(facts(F.col("whole")))) <= most_facts, F.array_distinct(facts(F.col("whole")))).otherwise(newest)

    def held(a: Column, x: Column) -> Column:
        size = a["n"] + F.size(words(x))
        return F.struct(F.when(size <= fact_tokens, F.concat(F.array(x), a["kept"])).otherwise(a["kept"]).alias("kept"), size.alias("n"))

    kept = F.aggregate(F.reverse(newest), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n")), held, lambda a: a["kept"])
    return body.select(key, "tier", content.alias("content"), F.when(F.col("tier") == 3, kept).alias("facts"))


def compaction_split(turns: DataFrame, keep_tokens: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with `compact`: all before the longest suffix that fits into keep_tokens and begins with a user turn; where
    no such suffix is left, everything but the last user turn and what follows it."""
    w = W.partitionBy(key)
    after = F.sum("tokens").over(w.orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))
    user = F.col("role") == "user"
    at = F.min(F.when(user & (F.col("after") <= keep_tokens), F.col(order))).over(w)
    last = F.max(F.when(user, F.col(order))).over(w)
    split = turns.withColumn("after", after).withColumn("at", F.coalesce(at, last))
    return split.withColumn("compact", F.coalesce(F.col(order) < F.col("at"), F.lit(False))).drop("after", "at")


def extract(turns: DataFrame, facts: Callable[[Column, Column], Column], kinds: tuple[str, ...], key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, content, kind, seen_at) of facts(role, text), an array of (content, kind): kinds that aren't listed and blank
    contents are dropped, a content is kept once a key, where it came first."""
    rows = turns.select(key, order, F.explode(facts(F.col("role"), F.col("text"))).alias("f"))
    good = rows.select(key, order, F.trim("f.content").alias("content"), F.col("f.kind").alias("kind")).where(F.col("kind").isin(list(kinds)) & (F.col("content") != ""))
    return good.groupBy(key, "content").agg(F.min_by("kind", order).alias("kind"), F.min(order).alias("seen_at"))


def fresh_turns(turns: DataFrame, seen: DataFrame, last: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A key's turns behind the last one that seen(key, upto) has, at most its `last` newest, without tool turns."""
    new = turns.where("role <> 'tool'").join(seen, key, "left").where(F.col("upto").isNull() | (F.col(order) > F.col("upto")))
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return new.withColumn("_n", n).where(F.col("_n") <= last).select(turns.columns)


def similarity_decisions(new: DataFrame, store: DataFrame, hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, match, score, action) of new(id, content): NONE where the store has the same content, UPDATE of the best of
    hits(query_id, id, score, rank) where that reaches the threshold, else ADD. The batch is never compared with itself."""
    same = new.join(store.select(F.md5("content").alias("h"), F.col("id").alias("same")).groupBy("h").agg(F.min("same").alias("same")), F.md5("content") == F.col("h"), "left").select("id", "same")
    best = hits.where("rank = 1").select(F.col("query_id").alias("id"), F.col("id").alias("near"), "score")
    near = F.coalesce(F.col("score") >= threshold, F.lit(False))
    both = same.join(best, "id", "left")
    action = F.when(F.col("same").isNotNull(), "NONE").when(near, "UPDATE").otherwise("ADD")
    return both.select("id", F.coalesce("same", F.when(near, F.col("near"))).alias("match"), "score", action.alias("action"))


class Memory:
    """A conversation's memory as one object: turns and facts as frames, changed by replacing them."""

    def __init__(self, turns: DataFrame, facts: DataFrame, max_tokens: int):
        self.turns, self.facts, self.max_tokens = turns, facts, max_tokens

    def add_turns(self, turns: DataFrame) -> Memory:
        return Memory(self.turns.unionByName(turns), self.facts, self.max_tokens)

    def add_facts(self, facts: DataFrame) -> Memory:
        """Facts whose content isn't there yet."""
        return Memory(self.turns, self.facts.unionByName(by_hash(facts, self.facts).drop("content_hash")), self.max_tokens)

    def delete_facts(self, ids: DataFrame) -> Memory:
        return Memory(self.turns, self.facts.join(ids.select("id"), "id", "left_anti"), self.max_tokens)

    def relevant(self, text: str, k: int, as_of: Column) -> DataFrame:
        from .predicates import search_entries

        return search_entries(self.facts, text, k, as_of)

    def context(self, key: str = "conv_id", order: str = "turn") -> DataFrame:
        """(key, place, priority, score, tokens, content): facts first with priority 8, then the turns the window holds,
        with scores by their position."""
        facts = self.facts.select(key, F.row_number().over(W.partitionBy(key).orderBy(F.desc("relevance_score"), "id")).cast("long").alias("place"), F.lit(8).alias("priority"), F.col("relevance_score").alias("score"), token_count("content").alias("tokens"), "content")
        held = position_scores(fifo_window(self.turns, self.max_tokens, key, order), key=key, order=order)
        turns = held.select(key, F.col(order).cast("long").alias("place"), F.lit(7).alias("priority"), "score", "tokens", F.col("text").alias("content"))
        return facts.unionByName(turns)

"""Context assembly: token budgets, packing, formatting."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .fold import greedy_fit, ordered_fold

#: Share of the total by source: budgets for chat, retrieval and agent use; all reserve 15 %.
PRESETS = {
    "chat": {"system": 0.10, "memory": 0.10, "conversation": 0.20, "retrieval": 0.25},
    "rag": {"system": 0.10, "memory": 0.05, "conversation": 0.10, "retrieval": 0.40},
    "agent": {"system": 0.15, "memory": 0.10, "conversation": 0.15, "retrieval": 0.20, "tool": 0.15},
}
RESERVE = 0.15


def pack(items: DataFrame, max_tokens: int, reserve: int = 0, key: str = "query_id") -> DataFrame:
    """items(key, id, priority, score, tokens) with `included`: greedy by priority, then score, ties by id."""
    if max_tokens - reserve <= 0:
        raise ValueError("nothing is left of the budget")
    return ordered_fold(items, [key], [F.desc("priority"), F.desc("score"), "id"], ["tokens"], *greedy_fit(max_tokens - reserve), "included", BooleanType())


def cap_sources_truncate(items: DataFrame, cap: int, key: str = "query_id") -> DataFrame:
    """`included` within each source's cap, greedy in the same order."""
    return ordered_fold(items, [key, "source"], [F.desc("priority"), F.desc("score"), "id"], ["tokens"], *greedy_fit(cap), "included", BooleanType())


def cap_sources_drop(items: DataFrame, caps: dict[str, int], key: str = "query_id") -> DataFrame:
    """A source over its cap is dropped whole; a source without a cap passes."""
    used = F.sum("tokens").over(W.partitionBy(key, "source"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("source")] if caps else F.lit(None)
    return items.withColumn("included", F.coalesce(used <= cap, F.lit(True)))


def diagnostics(packed: DataFrame, max_tokens: int, key: str = "query_id") -> DataFrame:
    inc = F.col("included")
    used = F.coalesce(F.sum(F.when(inc, F.col("tokens"))), F.lit(0))
    return packed.groupBy(key).agg(F.count("*").alias("considered"), F.count(F.when(inc, 1)).alias("included"), F.count(F.when(~inc, 1)).alias("overflow"), used.cast("long").alias("used_tokens"), F.round(used / max_tokens, 4).alias("utilization"))


def alternating(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Adjacent turns of one role merged, two line breaks between; system turns stay apart."""
    w = W.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(role).over(w) != F.col(role)) | (F.col(role) == "system"), F.lit(True))
    island = turns.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return island.groupBy(key, "island").agg(F.first(role).alias("role"), F.array_join(parts, "\n\n").alias("content"), F.count("*").alias("merged"))


def joined(order: str | Column, text: str | Column, between: str, only: Column | None = None) -> Column:
    """Aggregate: texts in order, joined; empty where none is left."""
    pair = F.struct(F.col(order) if isinstance(order, str) else order, (F.col(text) if isinstance(text, str) else text).alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair if only is None else F.when(only, pair))), lambda s: s["t"]), between)


def generic_format(items: DataFrame, key: str, order: str) -> DataFrame:
    """One text a key with SYSTEM, MEMORY and CONTEXT sections; empty sections are left out. items(section, content)."""
    parts = []
    for name in ("system", "memory", "context"):
        body = joined(order, "content", "\n", F.col("section") == name)
        parts.append(F.when(F.count(F.when(F.col("section") == name, 1)) > 0, F.concat(F.lit(f"=== {name.upper()} ===\n"), body)))
    return items.groupBy(key).agg(F.concat_ws("\n\n", *parts).alias("formatted"))


def chat_json(turns: DataFrame, key: str, order: str, role: str, text: str, source: str | None = None) -> DataFrame:
    """The list-of-messages form as JSON. With a source column, items speak in the role that message_role() allows them,
    so retrieved content never speaks as system; without one, turns speak in their own role."""
    said = F.col(role) if source is None else message_role(role, source)
    message = F.struct(said.alias("role"), F.col(text).alias("content"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), message.alias("m")))), lambda s: s["m"])
    return turns.groupBy(key).agg(F.to_json(rows).alias("messages"))


def enrich_queries(queries: DataFrame, items: DataFrame, key: str, order: list, n: int = 5) -> DataFrame:
    """`enriched`: the query's text and, if there are any, its key's last n items(key, content), oldest first."""
    last = items.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(o) for o in order)))).where(F.col("n") <= n)
    context = last.groupBy(key).agg(joined(-F.col("n"), "content", "; ").alias("context"))
    has = F.trim(F.coalesce("context", F.lit(""))) != ""
    return queries.join(context, key, "left").withColumn("enriched", F.when(has, F.concat("text", F.lit("\n\nConversation context: "), "context")).otherwise(F.col("text"))).drop("context")


def message_role(role: str, source: str) -> Column:
    """The role an item may speak in: only system items as system, only tool (and system) items as tool, else user."""
    r, s = F.coalesce(role, F.lit("user")), F.col(source)
    ok = r.isin("user", "assistant") | (r.isin("system", "tool") & (s == "system")) | ((r == "tool") & (s == "tool"))
    return F.when(F.coalesce(ok, F.lit(False)), r).otherwise("user")


def window_part(source: str) -> Column:
    """Where a formatter puts an item: system, the messages (memory), or context."""
    s = F.col(source)
    return F.when(s == "system", "system").when(s.isin("memory", "conversation"), "memory").otherwise("context")


def block_format(items: DataFrame, key: str, order: str) -> DataFrame:
    """(key, system, messages) as JSON: system blocks, and messages in turn with the context as the first one. Cache
    marks stand on the last system block and on the context. items(source, role, content)."""
    mark = F.struct(F.lit("ephemeral").alias("type")).alias("cache_control")
    placed = items.withColumns({"part": window_part("source"), "said": message_role("role", "source")})
    last = F.col(order) == F.max(order).over(W.partitionBy(key))
    text = [F.lit("text").alias("type"), F.col("content").alias("text")]
    block = F.when(last, F.to_json(F.struct(*text, mark))).otherwise(F.to_json(F.struct(*text)))
    system = placed.where("part = 'system'").withColumn("b", block).groupBy(key).agg(joined(order, "b", ",").alias("system"))
    shown = placed.where("part = 'context'").groupBy(key).agg(joined(order, "content", "\n\n---\n\n").alias("c"))
    head = shown.select(key, F.lit(None).cast(items.schema[order].dataType).alias(order), F.lit("user").alias("said"), F.concat(F.lit("Here is relevant context:\n\n"), "c").alias("content"))
    talk = alternating(placed.where("part = 'memory'").select(key, order, "said", "content").unionByName(head), key, order, "said", "content").join(shown.select(key, F.lit(True).alias("has")), key, "left")
    marked = F.to_json(F.struct("role", F.array(F.struct(*text, mark)).alias("content")))
    line = F.when((F.col("island") == 1) & F.coalesce("has", F.lit(False)), marked).otherwise(F.to_json(F.struct("role", "content")))
    messages = talk.withColumn("m", line).groupBy(key).agg(joined("island", "m", ",").alias("messages"))
    both = system.join(messages, key, "full")
    return both.select(key, *(F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("]")).alias(c) for c in ("system", "messages")))


@dataclass(frozen=True)
class TokenBudget:
    """A total, what of it is reserved for the answer, shares by source, and what to do with a source over its share."""

    total: int
    reserve: int = 0
    shares: Mapping[str, int] = field(default_factory=dict)
    overflow: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.total <= 0 or not 0 <= self.reserve < self.total:
            raise ValueError("nothing is left of the budget")
        if sum(self.shares.values()) + self.reserve > self.total:
            raise ValueError("the shares exceed the budget")
        if bad := set(self.overflow.values()) - {"truncate", "drop"}:
            raise ValueError(f"unknown strategy {sorted(bad)}")

    @classmethod
    def preset(cls, name: str, total: int) -> TokenBudget:
        return cls(total, int(total * RESERVE), {s: int(total * x) for s, x in PRESETS[name].items()})

    def allocation(self, source: str) -> int:
        """A source's own share, or the pool that all sources without one use."""
        return self.shares.get(source, self.shared_pool)

    @property
    def shared_pool(self) -> int:
        return max(0, self.total - self.reserve - sum(self.shares.values()))

    def strategy(self, source: str) -> str:
        return self.overflow.get(source, "truncate")

    def apply(self, items: DataFrame, key: str = "query_id") -> DataFrame:
        """items(key, id, source, priority, score, tokens) with `included`: sources with a share are cut to it or dropped
        whole, then everything that is left is packed into the total."""
        capped = cap_by_source(items, self.shares, {s: self.strategy(s) for s in self.shares}, key)
        kept = pack(capped.where("fits").drop("fits"), self.total, self.reserve, key)
        return kept.unionByName(capped.where("not fits").drop("fits").withColumn("included", F.lit(False)))


def cap_by_source(items: DataFrame, caps: Mapping[str, int], strategy: Mapping[str, str], key: str = "query_id") -> DataFrame:
    """`fits`: an item within its source's cap. "truncate" keeps what fits one by one, "drop" the whole source or nothing;
    a source without a cap passes."""
    if not caps:
        return items.withColumn("fits", F.lit(True))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("source")]
    drops = [s for s in caps if strategy.get(s) == "drop"]
    used = F.sum("tokens").over(W.partitionBy(key, "source"))
    whole = items.where(cap.isNull() | F.col("source").isin(drops)).withColumn("fits", F.coalesce(used <= cap, F.lit(True)))
    cut = items.where(cap.isNotNull() & ~F.col("source").isin(drops)).withColumn("cap", cap)

    def step(state: dict, row: dict) -> bool:
        fits = state["used"] + (row["tokens"] or 0) <= row["cap"]
        if fits:
            state["used"] += row["tokens"] or 0
        return fits

    one_by_one = ordered_fold(cut, [key, "source"], [F.desc("priority"), F.desc("score"), "id"], ["tokens", "cap"], lambda: {"used": 0}, step, "fits", BooleanType())
    return whole.unionByName(one_by_one.drop("cap"))


def usage(packed: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, source, tokens) of what was included."""
    return packed.where("included").groupBy(key, "source").agg(F.sum("tokens").cast("long").alias("tokens"))

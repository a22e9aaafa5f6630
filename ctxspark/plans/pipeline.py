"""The pipeline builder: a list of lazy steps (queries, items) -> items, executed as one job."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assemble, graph, retrieval

Step = Callable[[DataFrame, DataFrame | None], DataFrame]
log = logging.getLogger(__name__)


class Pipeline:
    """queries(query_id, ...) -> packed items(query_id, id, source, priority, score, tokens, content)."""

    def __init__(self, max_tokens: int, reserve: int = 0):
        self.max_tokens, self.reserve = max_tokens, reserve
        self.steps: list[tuple[str, Step, str]] = []
        self.caps: dict[str, int] = {}
        self.overflow: dict[str, str] = {}

    def step(self, name: str, fn: Step, on_error: str = "raise") -> Pipeline:
        """on_error "skip" covers what fails while the plan is built."""
        if on_error not in ("raise", "skip"):
            raise ValueError(on_error)
        self.steps.append((name, fn, on_error))
        return self

    def retrieve(self, name: str, retriever: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Appends what the retriever finds; repeats stay."""
        return self.step(name, lambda q, items: retriever(q) if items is None else items.unionByName(retriever(q), allowMissingColumns=True))

    def filter(self, name: str, keep: Column) -> Pipeline:
        return self.step(name, lambda q, items: items.where(keep))

    def system_prompt(self, text: str, tokens: int) -> Pipeline:
        """A row for each query that comes before all others."""

        def add(q: DataFrame, items: DataFrame | None) -> DataFrame:
            row = q.select("query_id", F.lit(-1).cast("long").alias("id"), F.lit("system").alias("source"), F.lit(10).alias("priority"), F.lit(1.0).alias("score"), F.lit(tokens).cast("long").alias("tokens"), F.lit(text).alias("content"))
            return row if items is None else items.unionByName(row, allowMissingColumns=True)

        return self.step("system", add)

    def rerank(self, name: str, reranker: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Any transform of what was found so far."""
        return self.step(name, lambda q, items: reranker(items))

    def transformed(self, name: str, variants: Callable[[DataFrame], DataFrame], retriever: Callable[[DataFrame], DataFrame], k: int = 10) -> Pipeline:
        """Retrieves each variant(query_id, n, text) of a query, fuses its lists, and appends what isn't there yet."""

        def add(q: DataFrame, items: DataFrame | None) -> DataFrame:
            found = retrieval.fused_variants(variants(q), retriever, k)
            return found if items is None else items.unionByName(retrieval.new_only(found, items), allowMissingColumns=True)

        return self.step(name, add)

    def classified(self, name: str, label: Column, retrievers: dict[str, Callable[[DataFrame], DataFrame]], default: str | None = None) -> Pipeline:
        """Each query goes to the retriever of its label."""
        return self.retrieve(name, lambda q: retrieval.routed(q, label, retrievers, default))

    def graph_memory(self, name: str, edges: DataFrame, links: DataFrame, entries: DataFrame, seeds: Callable[[DataFrame], DataFrame], depth: int = 2, most: int = 5) -> Pipeline:
        """Appends the entries that are linked to what seeds(queries) -> (query_id, node) reaches: at most `most`, the
        nearest first, as items of source memory with priority 6."""

        def find(q: DataFrame) -> DataFrame:
            start = seeds(q).select("query_id", F.col("node").alias("seed")).distinct()
            near = graph.bfs(start.select("seed").distinct(), graph.adjacency(edges), depth)
            hits = start.join(near, "seed").join(links, "node").groupBy("query_id", F.col("item").alias("id")).agg(F.min("hops").alias("hops"))
            few = retrieval.top_k(hits, ["query_id"], ["hops", "id"], most)
            told = few.join(entries, "id")
            return told.select("query_id", "id", "content", F.col("relevance_score").alias("score"), "tokens", F.lit(6).alias("priority"), F.lit("memory").alias("source"))

        return self.retrieve(name, find)

    def cap_source(self, source: str, tokens: int, overflow: str = "truncate") -> Pipeline:
        """overflow "truncate" keeps what fits, "drop" drops a source over its cap whole."""
        if overflow not in ("truncate", "drop"):
            raise ValueError(overflow)
        self.caps[source] = tokens
        self.overflow[source] = overflow
        return self

    def build(self, queries: DataFrame) -> DataFrame:
        items: DataFrame | None = None
        for name, fn, on_error in self.steps:
            try:
                items = fn(queries, items)
            except Exception:
                if on_error == "raise":
                    raise
                log.warning("step %s is skipped", name, exc_info=True)
        if self.caps:
            items = assemble.cap_by_source(items, self.caps, self.overflow).where("fits").drop("fits")
        return assemble.pack(items, self.max_tokens, self.reserve)

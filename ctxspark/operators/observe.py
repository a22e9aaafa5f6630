"""Costs, metrics, limits and call patterns from logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from .fold import ordered_fold


def cost_summary(entries: DataFrame) -> DataFrame:
    """Totals over all, by model and by operation in one pass: entries(model, operation, cost)."""
    return entries.groupingSets([[], ["model"], ["operation"]], "model", "operation").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.grouping_id().cast("long").alias("level"))


def price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by the price per million tokens; a date behind a model's name is ignored, with
    dashes or without."""
    return usage.withColumn("name", F.regexp_replace("model", r"-\d{4}-?\d{2}-?\d{2}$", "")).join(F.broadcast(prices), "name", "left").withColumn("cost", (F.col("input") * F.col("input_price") + F.col("output") * F.col("output_price")) / 1e6)


def metric_summary(points: DataFrame) -> DataFrame:
    """Count, extremes, mean and interpolated p50 and p95 of each metric: points(name, value)."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return points.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), p.alias("p")).select("name", "n", "low", "high", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def durations(events: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Seconds from each event to the key's next one."""
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("seconds", (F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)) / 1e6)


def limit_breach(events: DataFrame, key: str, order: list[str], amount: str, limit: float) -> DataFrame:
    """The first event of each key at which the running total passes the limit."""
    run = F.sum(amount).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    over = events.withColumn("total", run).where(F.col("total") > limit)
    return over.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def stuck(events: DataFrame, key: str, order: list[str], call: str, times: int) -> DataFrame:
    """Events at which the same call stands for the `times`-th time in a row, or more."""

    def step(state: dict, row: dict) -> int:
        state["n"] = state["n"] + 1 if row[call] == state["call"] else 1
        state["call"] = row[call]
        return state["n"]

    return ordered_fold(events, [key], order, [call], lambda: {"call": None, "n": 0}, step, "in_a_row", LongType()).where(F.col("in_a_row") >= times)


def span_kind(name: str) -> Column:
    """Kind of a span by its step's name."""
    n = F.lower(name)
    return F.when(n.rlike("retriev|search|query"), "retrieval").when(n.rlike("rerank|rank"), "reranking").when(n.rlike("format"), "formatting").when(n.rlike("memory"), "memory").otherwise("pipeline")


def call_batches(calls: DataFrame, key: str, order: list[str], read_only: str) -> DataFrame:
    """`batch`: calls in a row that only read run together, any other call alone."""
    w = W.partitionBy(key).orderBy(*order)
    reads = F.coalesce(read_only, F.lit(False))
    return calls.withColumn("batch", F.sum(F.when(reads & F.coalesce(F.lag(reads).over(w), F.lit(False)), 0).otherwise(1)).over(w))


def search_tools(tools: DataFrame, pattern: str) -> DataFrame:
    """tools(name, description) that match, case ignored; what is no regular expression is searched as plain text."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return tools.where(F.concat_ws(" ", "name", "description").rlike(f"(?i){pattern}"))


def pass_lift(runs: DataFrame) -> DataFrame:
    """One row of runs(passed_with, passed_without): both pass rates and their difference; 0 without runs."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return runs.agg(F.count("*").alias("n"), rate("passed_with").alias("rate_with"), rate("passed_without").alias("rate_without")).withColumn("lift", F.col("rate_with") - F.col("rate_without"))


def round_cost(prices: DataFrame, rounds: DataFrame, cached: float = 0.1, written: float = 1.25) -> DataFrame:
    """Cost of rounds(model, prompt, completion, cache_read, cache_write): tokens read from a cache cost `cached` of the
    input price, tokens written to it `written`; both count as prompt tokens that are not paid for again. Null without a
    price."""
    plain = F.greatest(F.lit(0), F.col("prompt") - F.col("cache_read") - F.col("cache_write"))
    paid = plain + F.col("cache_read") * cached + F.col("cache_write") * written
    return price(rounds.withColumns({"input": paid, "output": F.col("completion")}), prices).drop("name", "input", "output", "input_price", "output_price")


def span_tree(spans: DataFrame, levels: int = 64) -> DataFrame:
    """spans(trace_id, span_id, parent_id, start, end) with depth, seconds, and own_seconds without those of children. A
    span whose parent isn't there is a root; spans deeper than `levels`, or in a circle, have a null depth."""
    from .graph import saved

    seconds = (F.unix_micros("end") - F.unix_micros("start")) / 1e6
    timed = spans.withColumn("seconds", seconds)
    below = timed.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("seconds").alias("below"))
    told = timed.join(below, ["trace_id", "span_id"], "left").withColumn("own_seconds", F.col("seconds") - F.coalesce("below", F.lit(0.0))).drop("below")
    links = spans.select("trace_id", "span_id", "parent_id")
    there = links.select("trace_id", F.col("span_id").alias("up"), F.lit(True).alias("there"))
    up = links.select("trace_id", "span_id", F.col("parent_id").alias("up")).join(there, ["trace_id", "up"], "left").withColumn("up", F.when(F.col("there"), F.col("up")))
    jump = saved(up.select("trace_id", "span_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(max(1, (levels - 1).bit_length())):  # each round doubles how far a span has looked up
        if jump.where("up is not null").isEmpty():
            break
        far = jump.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        jump = saved(jump.join(far, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    found = jump.select("trace_id", "span_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return told.join(found, ["trace_id", "span_id"], "left")


def rollup_runs(calls: DataFrame, run: str, turn: str, amount: str) -> DataFrame:
    """(run, turn, calls, amount): per turn, per run (turn null), and over all (both null)."""
    return calls.rollup(run, turn).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))


def correlate(events: DataFrame, key: str, call: str, kind: str, started: str, finished: str, at: str) -> DataFrame:
    """(key, call, started_at, finished_at, seconds) of an event stream's calls: each start with its own end, null where
    that is missing."""
    when = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    both = events.where(F.col(kind).isin(started, finished)).groupBy(key, call).agg(when(started).alias("started_at"), when(finished).alias("finished_at"))
    return both.where("started_at is not null").withColumn("seconds", (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6)


def cache_replay(log: DataFrame, ttl: float, most: int, vault: str = "vault") -> DataFrame:
    """log(vault, seq, op, key, at in seconds) with `hit`: whether a get finds what a set put there no more than ttl
    seconds before. A cache holds `most` keys; a new one pushes out the one that was set first. `clear` empties it,
    `drop` removes a key."""

    def step(state: dict, row: dict) -> bool:
        held, op, key, at = state["held"], row["op"], row["key"], row["at"]
        if op == "clear":
            held.clear()
        elif op == "drop":
            held.pop(key, None)
        elif op == "set":
            held.pop(key, None)
            for old in [k for k, t in held.items() if at - t > ttl]:
                del held[old]
            if len(held) >= most:
                del held[next(iter(held))]
            held[key] = at
        return op == "get" and key in held and at - held[key] <= ttl

    return ordered_fold(log, [vault], ["seq"], ["op", "key", "at"], lambda: {"held": {}}, step, "hit", BooleanType())

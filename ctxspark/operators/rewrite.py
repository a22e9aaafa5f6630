"""Queries into queries: each operator takes queries(query_id, text, ...) and a function from Column to Column that stands
for the model (an SQL expression, or an Arrow UDF over whole batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import rank_by

Generate = Callable[[Column], Column]


def hypothetical(queries: DataFrame, generate: Generate) -> DataFrame:
    """The text replaced by a document that could answer it; an embedding of the old text goes."""
    return queries.withColumn("text", generate(F.col("text"))).drop("embedding", "history")


def variants(queries: DataFrame, generate: Generate, keep: bool = True) -> DataFrame:
    """(query_id, n, text): the query itself as number 0 (with `keep`), and the texts that generate() gives as an array;
    blank ones are left out, and repeats of a query keep the first."""
    made = F.filter(F.transform(generate(F.col("text")), lambda t: F.trim(t)), lambda t: t != "")
    texts = F.concat(F.array("text"), made) if keep else made
    rows = queries.select("query_id", F.posexplode(texts).alias("n", "text"))
    first = rank_by(rows, ["query_id", "text"], ["n"], "nth").where("nth = 1").drop("nth")
    return rank_by(first, ["query_id"], ["n"], "m").select("query_id", (F.col("m") - 1).alias("n"), "text")


def decompose(queries: DataFrame, generate: Generate) -> DataFrame:
    """(query_id, n, text): only the sub-questions."""
    return variants(queries, generate, keep=False)


def step_back(queries: DataFrame, generate: Generate) -> DataFrame:
    """(query_id, n, text): the query and one that is more abstract."""
    return variants(queries, lambda t: F.array(generate(t)))


def rewrite(queries: DataFrame, generate: Callable[[Column, Column], Column], history: str = "history") -> DataFrame:
    """The text rewritten by generate(text, history); untouched where the history is null or empty."""
    has = F.coalesce(F.size(history) > 0, F.lit(False))
    return queries.withColumn("text", F.when(has, generate(F.col("text"), F.col(history))).otherwise(F.col("text")))


def with_history(queries: DataFrame, history: str = "history", last: int = 3) -> DataFrame:
    """The last turns of history(array of role, content) before the text, ` | ` between."""
    said = F.transform(F.slice(history, F.greatest(F.lit(1), F.size(history) - last + 1), last), lambda h: F.concat_ws(": ", h["role"], h["content"]))
    has = F.coalesce(F.size(history) > 0, F.lit(False))
    return queries.withColumn("text", F.when(has, F.array_join(F.concat(said, F.array("text")), " | ")).otherwise(F.col("text")))


def classify(queries: DataFrame, label: Column, default: str | None = None) -> DataFrame:
    """`label` by any expression; null ones take the default."""
    return queries.withColumn("label", label if default is None else F.coalesce(label, F.lit(default)))


def chain(queries: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, n, text): steps after each other, each over all texts of the one before; a query's repeats keep the first."""
    now = queries.select("query_id", F.lit(0).cast("long").alias("n"), "text")
    for step in steps:
        own = now.withColumn("query_id", F.struct("query_id", F.col("n").alias("at")))
        made = step(own)
        made = made if "n" in made.columns else made.withColumn("n", F.lit(0).cast("long"))
        flat = made.select("query_id.query_id", F.struct(F.col("query_id.at").alias("at"), "n").alias("order"), "text")
        first = rank_by(flat, ["query_id", "text"], ["order"], "nth").where("nth = 1")
        now = rank_by(first, ["query_id"], ["order"], "m").select("query_id", (F.col("m") - 1).alias("n"), "text")
    return now

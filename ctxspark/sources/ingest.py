"""From documents to items: chunk, number, describe, enrich, put into context, count."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

Chunk = Callable[[DataFrame], DataFrame]


def described(chunks: DataFrame, docs: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """chunks(id, chunk_index, content) with chunk_id, parent_doc_id, total_chunks, word_count and char_count, and the
    documents' columns `carry` under doc_<name>."""
    numbered = chunks.withColumn("total_chunks", F.count("*").over(W.partitionBy("id")))
    told = numbered.select(T.chunk_id("id", "chunk_index").alias("chunk_id"), F.col("id").alias("parent_doc_id"), "chunk_index", "total_chunks", T.token_count("content").alias("word_count"), F.length("content").cast("long").alias("char_count"), "content")
    names = list(carry)
    if not names:
        return told
    own = docs.select(F.col("id").alias("parent_doc_id"), *(F.col(c).alias(f"doc_{c.removeprefix('doc_')}") for c in names))
    return told.join(own, "parent_doc_id", "left")


def enriched(items: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The items through a chain of steps; each sees what the one before it made."""
    for step in steps:
        items = items.transform(step)
    return items


def contextualized(items: DataFrame, context: Callable[[Column, Column], Column], whole: DataFrame) -> DataFrame:
    """A chunk's content led by context(document, chunk) and a blank line; the content as it was stays in
    original_content. Where the context is null or blank the content is untouched."""
    told = items.join(whole.select(F.col("id").alias("parent_doc_id"), F.col("content").alias("_whole")), "parent_doc_id")
    said = context(F.col("_whole"), F.col("content"))
    has = F.coalesce(F.trim(said) != "", F.lit(False))
    led = F.when(has, F.concat(said, F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    return told.withColumns({"original_content": F.col("content"), "content": led}).drop("_whole")


def ingest(docs: DataFrame, chunk: Chunk, carry: Iterable[str] = (), enrich: Iterable[Callable[[DataFrame], DataFrame]] = (), context: Callable[[Column, Column], Column] | None = None, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """Items of docs(id, content, ...): chunks described, enriched, put into context, and their tokens counted last.

    Documents without words have no chunks, so no items; a null content is one of them.
    """
    items = enriched(described(chunk(docs), docs, carry), enrich)
    if context is not None:
        items = contextualized(items, context, docs)
    return items.withColumns({"token_count": count(F.col("content")), "source": F.lit("retrieval")})

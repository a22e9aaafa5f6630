"""Command line: index a folder, search the index, and look at a graph of edges."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, graph, retrieval
from .sources import files


def index(spark: SparkSession, folder: str, out: str, size: int, overlap: int) -> DataFrame:
    """Chunks of the folder's readable files, written as Parquet to `out`; returns the files that could not be read."""
    docs = files.ingest_directory(spark, folder)
    good = docs.where("error is null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    chunking.fixed(good, size, overlap).write.mode("overwrite").parquet(out)
    return docs.where("error is not null").select("path", "error")


def search(spark: SparkSession, table: str, text: str, k: int) -> DataFrame:
    """The k best chunks for a text by BM25."""
    items = spark.read.parquet(table).select(F.concat_ws("-chunk-", "id", F.col("chunk_index").cast("string")).alias("id"), "content")
    found = retrieval.bm25(spark.createDataFrame([(0, text)], "query_id long, text string"), items, k)
    return found.join(items, "id").orderBy("rank").select("rank", "id", "score", "content")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ctxspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("index")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--size", type=int, default=512)
    c.add_argument("--overlap", type=int, default=50)
    c = commands.add_parser("query")
    c.add_argument("table")
    c.add_argument("text")
    c.add_argument("-k", type=int, default=10)
    c = commands.add_parser("info")
    c.add_argument("table")
    c = commands.add_parser("graph")
    c.add_argument("what", choices=["hubs", "path", "neighbors", "backlinks", "communities"])
    c.add_argument("edges", help="Parquet with source and target")
    c.add_argument("--node")
    c.add_argument("--to")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--depth", type=int, default=4)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        index(spark, a.folder, a.out, a.size, a.overlap).show(truncate=False)
    elif a.command == "query":
        search(spark, a.table, a.text, a.k).show(a.k, truncate=120)
    elif a.command == "info":
        t = spark.read.parquet(a.table)
        t.agg(F.count("*").alias("chunks"), F.countDistinct("id").alias("documents")).show()
    else:
        edges = spark.read.parquet(a.edges).select(F.col("source").cast("string"), F.col("target").cast("string"))
        graph_command(spark, a, edges).show(1000, truncate=False)


def graph_command(spark: SparkSession, a: argparse.Namespace, edges: DataFrame) -> DataFrame:
    adj = graph.adjacency(edges)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    if a.what == "hubs":
        return graph.hubs(nodes, adj, a.k)
    if a.what == "communities":
        numbered = adj.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
        found = graph.label_communities(nodes.select(F.xxhash64("node").alias("node")), numbered)
        return nodes.join(found.withColumnRenamed("node", "h"), F.xxhash64(nodes.node) == F.col("h")).groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first_node")).orderBy(F.desc("n"), "first_node").limit(a.k)
    if a.node is None:
        raise SystemExit(f"graph {a.what} needs --node")
    if a.what == "backlinks":
        return edges.where(F.col("target") == a.node).select("source").distinct()
    reached = graph.bfs(spark.createDataFrame([(a.node,)], "seed string"), adj, a.depth, paths=True)
    return reached.where(F.col("node") == a.to) if a.what == "path" else reached.where("hops > 0").select("node", "hops")


if __name__ == "__main__":
    main()

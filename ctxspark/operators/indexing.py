"""Building the knowledge graph from notes, entries and extracted facts, and finding its communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from .graph import merge_edges, saved, wikilinks

#: How sure an edge is, from the surest on.
PROVENANCE = ("extracted", "inferred", "ambiguous")


def note_graph(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(key, label, alias, kind, item), edges(source, target, relation, item)) of notes(id, title, tags, aliases):
    a node for each note, one for each of its aliases' names, and a `tagged` edge to each tag. Notes whose title has no
    key are left out."""
    n = notes.withColumn("key", normalize_key("title")).where("key is not null")
    names = F.array_distinct(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    own = n.select("key", F.col("title").alias("label"), F.explode(names).alias("alias"), F.lit("note").alias("kind"), F.col("id").alias("item"))
    tags = n.select(F.col("key").alias("source"), F.explode(F.array_distinct("tags")).alias("tag"), F.col("id").alias("item"))
    tags = tags.withColumn("target", normalize_key("tag")).where("target is not null")
    tagged = tags.select(F.col("target").alias("key"), F.col("tag").alias("label"), F.col("tag").alias("alias"), F.lit("tag").alias("kind"), "item")
    return own.unionByName(tagged), tags.select("source", "target", F.lit("tagged").alias("relation"), "item").distinct()


def link_edges(notes: DataFrame) -> DataFrame:
    """edges(source, target, relation links_to, item) of the notes' wikilinks; none to a note itself, each once a note."""
    keyed = wikilinks(notes).withColumn("target_key", normalize_key("target")).where("target_key is not null")
    own = notes.select("id", normalize_key("title").alias("source")).where("source is not null")
    e = keyed.join(own, "id").select("source", F.col("target_key").alias("target"), F.lit("links_to").alias("relation"), F.col("id").alias("item"))
    return e.where("source <> target").distinct()


def extracted_edges(answers: DataFrame) -> DataFrame:
    """edges(source, target, relation, item, provenance, confidence) of answers(item, answer): JSON with `relations` of
    (source, target, relation, provenance, confidence), as a model gives it. A confidence is clamped to [0, 1], an ambiguous
    edge's to 0.3; unknown provenances are ambiguous; what has no key at an end, or is no JSON, is left out."""
    schema = "struct<relations: array<struct<source: string, target: string, relation: string, provenance: string, confidence: double>>>"
    r = answers.select("item", F.explode(F.from_json("answer", schema)["relations"]).alias("r")).select("item", "r.*")
    known = F.when(F.col("provenance").isin(list(PROVENANCE)), F.col("provenance")).otherwise("ambiguous")
    keyed = r.withColumns({"source": normalize_key("source"), "target": normalize_key("target"), "relation": normalize_key("relation"), "provenance": known})
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    return keyed.where("source is not null and target is not null and relation is not null and source <> target").withColumn("confidence", F.when(F.col("provenance") == "ambiguous", F.least(sure, F.lit(0.3))).otherwise(sure)).select("source", "target", "relation", "item", "provenance", "confidence")


def index_graph(edges: DataFrame) -> DataFrame:
    """Edges merged by (source, target, relation): their items as evidence, the best confidence and provenance."""
    e = edges if "confidence" in edges.columns else edges.withColumns({"confidence": F.lit(1.0), "provenance": F.lit("extracted")})
    best = F.array_position(F.array(*map(F.lit, PROVENANCE)), F.col("provenance"))
    merged = merge_edges(e.withColumns({"evidence": F.col("item").cast("string"), "fact": F.lit(None).cast("string"), "seq": F.lit(0)}))
    sure = e.groupBy("source", "target", "relation").agg(F.min_by("provenance", best).alias("provenance"))
    return merged.drop("fact").join(sure, ["source", "target", "relation"])


def refresh(edges: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """edges(source, target, relation, item) in step with a store: those of changed(item) go, the new ones come."""
    return edges.join(changed.select("item").distinct(), "item", "left_anti").select(new.columns).unionByName(new).distinct()


def louvain(adj: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(node, community) by modularity gain: nodes move to the neighbouring community that gains most, then communities
    become nodes, until nothing moves. adj(a, b) holds both directions; a community's name is its smallest node.

    All nodes of one half, drawn anew each round by a hash, move at once, so two nodes never swap for ever; the result can
    differ from that of moving one node at a time. Joins and aggregates only; a level ends as soon as a round moves nothing.
    """
    links = saved(adj.select("a", "b", F.lit(1.0).alias("w")))
    m2 = links.agg(F.sum("w")).first()[0]
    nodes = adj.select(F.col("a").alias("node")).distinct()
    member = saved(nodes.select("node", F.col("node").alias("c")))  # original node to the present level's node
    if not m2:
        return member.withColumnRenamed("c", "community")
    for _ in range(levels):
        degree = saved(links.groupBy("a").agg(F.sum("w").alias("d")))
        label = saved(degree.select("a", F.col("a").alias("c")))
        moved = 0
        for n in range(rounds):
            own = label.join(degree, "a")
            total = own.groupBy("c").agg(F.sum("d").alias("tot"))
            near = links.where("a <> b").join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("inside"))
            stay = own.select("a", "c", F.lit(0.0).alias("inside"))
            options = near.unionByName(stay).groupBy("a", "c").agg(F.max("inside").alias("inside"))
            seen = options.join(total, "c").join(own.select("a", F.col("c").alias("now"), "d"), "a")
            rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("d")).otherwise(0.0)
            gain = F.round(F.col("inside") - F.col("d") * rest / F.lit(m2), 9)
            best = seen.groupBy("a").agg(F.max_by("c", F.struct(gain, F.col("c") == F.col("now"))).alias("best"), F.first("now").alias("now"))
            turn = F.pmod(F.xxhash64("a", F.lit(n)), F.lit(2)) == 0
            label = saved(best.select("a", F.when(turn, F.col("best")).otherwise(F.col("now")).alias("c"), (turn & (F.col("best") != F.col("now"))).alias("moved")))
            steps = label.where("moved").count()
            moved += steps
            label = label.drop("moved")
            if not steps and n % 2:
                break
        name = saved(label.groupBy("c").agg(F.min("a").alias("name")).join(label, "c").select("a", F.col("name").alias("to")))
        member = saved(member.join(name, member.c == name.a).select("node", F.col("to").alias("c")))
        if not moved:
            break
        links = saved(links.join(name.select("a", F.col("to").alias("ta")), "a").join(name.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b").groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.sum("w").alias("w")))
    lowest = member.groupBy("c").agg(F.min("node").alias("community"))
    return member.join(lowest, "c").select("node", "community")

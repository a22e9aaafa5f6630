"""Knowledge-graph operators over edge tables: merge, visibility, walks, ranking, communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import shared_folder, sound_unions


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder that executors share."""
    sound_unions(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, target, relation): all evidence, the best confidence, the first fact."""
    return edges.groupBy("source", "target", "relation").agg(F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"), F.max("confidence").alias("confidence"), F.min_by("fact", "seq").alias("fact"), F.count("*").alias("merged"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).where("a <> b")


def adjacency(edges: DataFrame) -> DataFrame:
    """both_ways() without repeats."""
    return both_ways(edges).distinct()


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    return nodes.join(adj.groupBy("a").agg(F.count("*").alias("d")), nodes.node == F.col("a"), "left").select("node", F.coalesce("d", F.lit(0)).alias("degree"))


def hubs(nodes: DataFrame, adj: DataFrame, k: int) -> DataFrame:
    return degrees(nodes, adj).orderBy(F.desc("degree"), "node").limit(k)


def visible(nodes: DataFrame, node_items: DataFrame, edges: DataFrame, edge_items: DataFrame, items: DataFrame, seen: Column, root_seen: bool, live: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes with a visible item (or, if the root is visible, with none at all), and the live edges between them whose evidence is none or visible."""
    ok = items.where(seen).select("item")
    good = node_items.join(ok, "item", "left_semi").select("node").distinct()
    bare = nodes.join(node_items.select("node").distinct(), "node", "left_anti").select("node")
    shown = good.union(bare) if root_seen else good
    proven = edge_items.join(ok, "item", "left_semi").select("edge").distinct()
    free = edges.select("edge").join(edge_items.select("edge").distinct(), "edge", "left_anti")
    e = edges.where(live).join(proven.union(free), "edge", "left_semi")
    for end in ("source", "target"):
        e = e.join(shown.withColumnRenamed("node", end), end, "left_semi")
    return shown, e


def bfs(seeds: DataFrame, adj: DataFrame, depth: int, paths: bool = False) -> DataFrame:
    """(seed, node, hops[, path]) within `depth` hops, the seed at 0; of equally short paths the smallest by text stays."""
    start = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hops"), F.col("seed").cast("string").alias("path"))
    reached, front = start, start
    for hop in range(1, depth + 1):
        step = front.join(adj, front.node == adj.a).select("seed", F.col("b").alias("node"), F.lit(hop).cast("long").alias("hops"), F.concat("path", F.lit(">"), F.col("b").cast("string")).alias("path"))
        new = step.groupBy("seed", "node").agg(F.first("hops").alias("hops"), F.min("path").alias("path"))
        front = saved(new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        reached = reached.union(front)
    return reached if paths else reached.drop("path")


def paths_to(seeds: DataFrame, targets: DataFrame, adj: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops, path) of bfs() for the nodes of targets(node) alone; adj may have repeats.

    A walk back from the targets, with one row a node, tells how many hops a node is from the nearest of them. Seeds then
    go only where a target is still within their depth, so what they reach on the way is as much as lies near the targets.
    """
    goal = saved(targets.select("node").where("node is not null").distinct())
    left = [goal]  # those within 0, 1, ... hops of a target
    for _ in range(1, depth):
        back = _ending(adj, left[-1]).select(F.col("a").alias("node"))
        left.append(saved(back.union(left[-1]).distinct()))
    start = saved(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hops"), F.col("seed").cast("string").alias("path")))
    reached, front = start, start
    for hop in range(1, depth + 1):
        near = _ending(adj, left[depth - hop])
        step = front.join(near, front.node == near.a).select("seed", F.col("b").alias("node"), F.concat("path", F.lit(">"), F.col("b").cast("string")).alias("path"))
        new = step.groupBy("seed", "node").agg(F.min("path").alias("path")).select("seed", "node", F.lit(hop).cast("long").alias("hops"), "path")
        front = saved(new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        reached = reached.union(front)
    return reached.join(_few(goal), "node", "left_semi").select("seed", "node", "hops", "path")


def _few(nodes: DataFrame, most: int = 100_000) -> DataFrame:
    """Saved nodes, to be broadcast where they are counted to be few."""
    return F.broadcast(nodes) if nodes.limit(most + 1).count() <= most else nodes


def _ending(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    return adj.join(_few(nodes.withColumnRenamed("node", "b")), "b", "left_semi").select("a", "b")


def pagerank(seeds: DataFrame, adj: DataFrame, damping: float = 0.5, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """(query, node, score) of personalised PageRank; seeds(query, node) share the restart, dangling mass goes to them.

    Nodes with the same links from and to others get the same flow, so rounds run over classes of such nodes, and queries
    whose seeds lie in the same classes share their rounds. A round is one join with the links between classes, which are
    partitioned by their source once, and one aggregate: the mass of nodes without links comes out of it under a null
    class. Each round is checkpointed, so plans don't grow; with a tolerance they stop once no query's L1 change exceeds
    it. Scores are spread to the nodes last, by a join that shuffles no scores of single nodes.
    """
    restart = saved(seeds.distinct().withColumn("p", 1.0 / F.count("*").over(W.partitionBy("query"))))
    kind = saved(node_classes(restart.select("node"), adj))
    size = saved(kind.groupBy("class").agg(F.count("*").alias("size"), F.min("node").alias("one")))
    out = adj.groupBy("a").agg(F.count("*").alias("deg"))
    told = size.select(F.col("one").alias("a"), F.col("class").alias("ca")).join(adj, "a").join(out, "a")  # one node stands for its class
    links = saved(told.join(kind.select(F.col("node").alias("b"), F.col("class").alias("cb")), "b").select("ca", "cb", (damping / F.col("deg")).alias("share")).distinct().repartition("ca"))
    own = saved(restart.join(kind, "node").select("query", "node", "p", "class"))
    base = own.groupBy("query", "class").agg(F.sum("p").alias("p"), F.count("*").alias("seeds"))
    alike = base.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("class", "p", "seeds"))).alias("same"))
    asked = saved(alike.withColumn("lead", F.min("query").over(W.partitionBy("same"))).select("query", "lead"))
    start = saved(base.join(asked.where("query = lead").select("query"), "query"))
    mass = start.select("query", "class", F.col("p").alias("m"))
    before = None
    for _ in range(rounds):
        moved = mass.join(links, mass["class"] == links.ca, "left").select("query", F.col("cb").alias("class"), (F.col("m") * F.coalesce("share", F.lit(damping))).alias("m"))
        flow = saved(moved.groupBy("query", "class").agg(F.sum("m").alias("f")))
        lost = flow.where("class is null").select("query", F.col("f").alias("lost"))
        back = start.join(lost, "query", "left").select("query", "class", "seeds", (((1 - damping) + F.coalesce("lost", F.lit(0.0))) * F.col("p")).alias("b"))
        now = flow.where("class is not null").join(back, ["query", "class"], "full").join(size.select("class", "size"), "class")
        mass = now.select("query", "class", (F.coalesce("f", F.lit(0.0)) * F.col("size") + F.coalesce("b", F.lit(0.0))).alias("m"), "f", "b", "seeds", "size")
        if tolerance:
            mass = saved(mass)
            f, b, x, y = (F.coalesce(c, F.lit(0.0)) for c in ("f", "b", "f0", "b0"))
            old = start.select("query", "class", F.lit(0.0).alias("f0"), F.col("p").alias("b0")) if before is None else before.select("query", "class", F.col("f").alias("f0"), F.col("b").alias("b0"))
            k = F.coalesce("seeds", F.lit(0))
            # the seeds of a class and query have equal restarts
            moved = (F.col("size") - k) * F.abs(f - x) + F.when(k > 0, k * F.abs(f - x + (b - y) / k)).otherwise(0.0)
            gap = mass.join(old, ["query", "class"], "left").groupBy("query").agg(F.sum(moved).alias("d")).agg(F.max("d")).first()[0]
            before = mass
            if gap is not None and gap <= tolerance:
                break
    if not rounds:
        return restart.select("query", "node", F.col("p").alias("score"))
    last = saved(mass.select(F.col("query").alias("lead"), "class", "f", (F.col("b") / F.col("seeds")).alias("b")))
    mine = own.select("query", "class", "node").join(asked, "query").join(last, ["lead", "class"])
    held = mine.groupBy("query", "class").agg(F.map_from_entries(F.collect_list(F.struct("node", "b"))).alias("held"))
    part = asked.join(last.where("f is not null").select("lead", "class", "f"), "lead").join(held, ["query", "class"], "left").select("query", "class", "f", "held")
    # members of large classes are dealt over SPREAD shards, and a class's scores go to each of them
    wide = size.select("class", F.least(F.lit(SPREAD), F.ceil(F.col("size") / 64)).cast("int").alias("ways"))
    left = part.join(wide, "class").select("query", "class", "f", "held", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    right = kind.join(wide, "class").select("class", "node", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int").alias("way"))
    # by rows that come out: those that go in are so few that adaptive execution would make one task of them
    rows = part.join(size, "class").agg(F.sum("size")).first()[0] or 0
    tasks = max(adj.sparkSession.sparkContext.defaultParallelism, rows // SPREAD_ROWS + 1)
    left, right = left.repartition(tasks, "class", "way"), right.repartition(tasks, "class", "way")
    spread = left.join(right.hint("shuffle_hash"), ["class", "way"]).select("query", "node", (F.col("f") + F.coalesce(F.col("held")[F.col("node")], F.lit(0.0))).alias("score"))
    return spread.union(mine.where("f is null").select("query", "node", F.col("b").alias("score")))


#: Shards that a large class of nodes is dealt over when scores are spread to its members, and rows that a task makes of them.
SPREAD, SPREAD_ROWS = 64, 2_000_000


def node_classes(more: DataFrame, adj: DataFrame) -> DataFrame:
    """(node, class) of the nodes of adj(a, b) and of more(node): those with the same links, both ways, share a class.

    Sets of neighbours are told apart by their number and 128 bits of hashes, classes by 64 bits of those.
    """
    ends = lambda end, other, mark: adj.select(F.col(end).alias("node"), F.col(other).alias("other")).groupBy("node").agg(*neighbour_marks("other")).select("node", F.xxhash64(F.lit(mark), "n", "x", "y").alias("h"))
    both = ends("a", "b", 0).union(ends("b", "a", 1)).union(more.select("node", F.lit(None).cast("long")))
    return both.groupBy("node").agg(F.xxhash64(F.sort_array(F.collect_list("h"))).alias("class"))


def modularity(adj: DataFrame, communities: DataFrame) -> DataFrame:
    """Sum over communities of in / 2m - (tot / 2m)^2; adj holds both directions, communities(node, community)."""
    c = communities
    e = adj.join(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    per = e.groupBy("ca").agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"), F.count("*").alias("tot"))
    tot = F.col("tot").cast("double")
    sums = per.agg(F.sum("inside").alias("inside"), F.sum("tot").alias("m2"), F.sum(tot * tot).alias("squares"))
    return sums.select((F.col("inside") / F.col("m2") - F.col("squares") / F.col("m2") / F.col("m2")).alias("modularity"))


def label_communities(nodes: DataFrame, adj: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes its neighbours' commonest label, the smallest at a tie."""
    label = nodes.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = adj.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("new"))
        label = saved(label.join(best, label.node == best.a, "left").select("node", F.coalesce("new", "community").alias("community")))
    return label


def mentions(texts: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """(id, node): aliases(alias, node) that stand in a text as n-grams of up to `longest` words (case folded)."""
    w = F.split(F.trim(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{M}\p{N}#_]+", " ")), " ")
    base = texts.select("id", w.alias("w"))

    def grams_of(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("w") - n + 1)
        return base.where(F.size("w") >= n).select("id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("alias"))

    grams = grams_of(1)
    for n in range(2, longest + 1):
        grams = grams.union(grams_of(n))
    return grams.join(aliases, "alias").select("id", "node").distinct()


def wikilinks(notes: DataFrame) -> DataFrame:
    """(id, target) of [[target#part|label]] links, embeds included; folders and .md dropped; no links to itself (notes has `title`)."""
    raw = F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]\|#]+)"), 1))
    base = notes.select("id", "title", raw.alias("t")).withColumn("target", F.regexp_replace(F.substring_index(F.trim("t"), "/", -1), r"\.md$", ""))
    return base.where("target <> '' and target <> title").select("id", "target").distinct()


def query_items(seeds: DataFrame, edges: DataFrame, links: DataFrame, k: int = 10, damping: float = 0.5, rounds: int = 10, digits: int = 9) -> DataFrame:
    """(query, item, score, norm, rank): items ranked by a walk over entities and items, an item being adjacent to every
    node it stands for. seeds(query, node or item), links(node, item); norm is the score by the query's best."""
    node = lambda c: F.concat(F.lit("n:"), F.col(c).cast("string"))
    item = F.concat(F.lit("i:"), F.col("item").cast("string"))
    both = edges.select(node("source").alias("source"), node("target").alias("target")).union(links.select(node("node"), item))
    start = seeds.select("query", node("node").alias("node"))
    if "item" in seeds.columns:
        start = seeds.select("query", F.coalesce(node("node"), item).alias("node"))
    rank = item_scores(start.distinct(), saved(adjacency(both)), k, damping, rounds, digits).where("score > 0")
    found = rank.select("query", F.substring("node", 3, 1 << 30).alias("item"), F.round("score", digits).alias("score"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).withColumn("norm", F.col("score") / F.max("score").over(W.partitionBy("query")))


def branches(adj: DataFrame) -> DataFrame:
    """(node, kind, host, top, m, deg) of the nodes of adj, which holds both directions.

    A leaf has one neighbour. A stem (R) has leaves (RL), m of them, and one neighbour besides, its host. Leaves of other
    nodes (L) have those as hosts; what is left is the core (C). top is the stem of a stem and its leaves, else the node.
    """
    deg = adj.groupBy("a").agg(F.count("*").alias("deg"))
    ends = adj.join(deg.select(F.col("a").alias("b"), F.col("deg").alias("db")), "b")
    seen = saved(ends.groupBy("a").agg(F.count("*").alias("deg"), F.count(F.when(F.col("db") == 1, 1)).alias("m"), F.max(F.when(F.col("db") > 1, F.col("b"))).alias("host")))
    stem = seen.where("deg > 1 and m > 0 and deg - m = 1")
    # of two that are each other's host, none is a stem
    stem = saved(stem.join(stem.select(F.col("a").alias("host")), "host", "left_anti").select("a", "host", "m", "deg"))
    leaf = seen.where("deg = 1 and m = 0").select("a", F.col("host").alias("up")).join(stem.select(F.col("a").alias("up"), F.col("host").alias("far"), F.col("m").alias("ms")), "up", "left")
    low = leaf.select(F.col("a").alias("node"), F.when(F.col("far").isNull(), "L").otherwise("RL").alias("kind"), F.coalesce("far", "up").alias("host"), F.when(F.col("far").isNull(), F.col("a")).otherwise(F.col("up")).alias("top"), F.coalesce("ms", F.lit(0)).alias("m"), F.lit(1).cast("long").alias("deg"))
    mid = stem.select(F.col("a").alias("node"), F.lit("R").alias("kind"), "host", F.col("a").alias("top"), "m", "deg")
    core = seen.where("not (deg = 1 and m = 0)").join(stem.select("a"), "a", "left_anti").select(F.col("a").alias("node"), F.lit("C").alias("kind"), F.col("a").alias("host"), F.col("a").alias("top"), F.lit(0).cast("long").alias("m"), "deg")
    return low.union(mid).union(core)


def item_scores(seeds: DataFrame, adj: DataFrame, k: int, damping: float, rounds: int, digits: int) -> DataFrame:
    """(query, node, score) by pagerank(), of the nodes i:...; those that can't be among a query's k best by rounded score
    and node may be left out.

    Stems of one host with equally many leaves, and their leaves, have equal scores, apart from a query's own branches.
    Rounds run over classes of such nodes, each query's own branches beside them: a link to a query's own stem or leaf
    is taken from the class's links. Queries with seeds that are leaves of stems or have no links take pagerank().
    """
    part = saved(branches(adj).withColumn("class", F.xxhash64("kind", "host", "m")))
    at = saved(seeds.join(part, "node", "left").withColumn("p", 1.0 / F.count("*").over(W.partitionBy("query"))))
    if not at.where("kind is null or kind = 'RL'").isEmpty():
        return pagerank(seeds, adj, damping, rounds).where("node like 'i:%'")
    share = F.lit(damping) / F.col("deg")
    one = part.groupBy("class").agg(F.min("node").alias("b"))
    into = adj.join(one, "b").select("a", F.col("class").alias("to"))
    links = saved(into.join(part.select(F.col("node").alias("a"), "class", "deg"), "a").groupBy(F.col("class").alias("from"), "to").agg(F.sum(share).alias("w")).repartition("from"))
    own = saved(at.where("kind <> 'C'").select("query", "top", "host", "kind", "m", "deg", "class").distinct())
    hosts = part.where("kind = 'C'").select(F.col("node").alias("host"), F.col("class").alias("hc"), (damping / F.col("deg")).alias("hs"))
    mine, low = F.xxhash64(F.lit("own"), "top"), F.xxhash64(F.lit("low"), "top")
    link = lambda a, b, w: F.struct(a.alias("from"), b.alias("to"), w.cast("double").alias("w"))
    hc, stem = F.col("hc"), F.col("kind") == "R"
    told = F.array(link(hc, mine, F.col("hs")), link(mine, hc, share), link(F.col("class"), hc, -share))
    told = F.when(stem, F.concat(told, F.array(link(mine, low, share), link(low, mine, damping * F.col("m"))))).otherwise(told)
    apart = saved(own.join(hosts, "host").select("query", F.explode(told).alias("l")).select("query", "l.*"))
    start = saved(at.select("query", F.when(F.col("kind") == "C", F.col("class")).otherwise(mine).alias("id"), "p"))
    rank = start.select("query", "id", F.col("p").alias("r"))
    for _ in range(rounds):
        moved = rank.join(links, rank.id == links["from"]).select("query", F.col("to").alias("id"), (F.col("r") * F.col("w")).alias("r"))
        beside = rank.withColumnRenamed("id", "from").join(apart, ["query", "from"]).select("query", F.col("to").alias("id"), (F.col("r") * F.col("w")).alias("r"))
        back = start.select("query", "id", ((1 - damping) * F.col("p")).alias("r"))
        rank = saved(moved.union(beside).union(back).groupBy("query", "id").agg(F.sum("r").alias("r")))
    branch = own.groupBy("query").agg(F.collect_set("top").alias("tops"))
    most = branch.agg(F.max(F.size("tops"))).first()[0] or 0
    items = part.where("node like 'i:%'")
    first = items.withColumn("n", F.row_number().over(W.partitionBy("class").orderBy("node"))).where(F.col("n") <= k + most * F.greatest("m", F.lit(1)))
    first = saved(first.select(F.col("class").alias("id"), "node", "top", "n"))
    # a class's items have one score, so the k best items are in the k best classes by score and least item, or in as many more as lose items to own branches
    best = rank.join(first.where("n = 1").select("id", F.col("node").alias("least")), "id").withColumn("s", F.round("r", digits))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("s"), "least"))).where(F.col("n") <= k + most).select("query", "id", "r")
    others = best.join(first, "id").join(branch, "query", "left").where("tops is null or not array_contains(tops, top)").select("query", "node", F.col("r").alias("score"))
    kept = items.join(own.select("top").distinct(), "top", "left_semi").withColumn("n", F.row_number().over(W.partitionBy("top", "kind").orderBy("node"))).where(F.col("n") <= k)
    kept = own.select("query", "top").join(kept.select("top", F.when(F.col("kind") == "RL", low).otherwise(mine).alias("id"), "node"), "top")
    return others.union(kept.join(rank, ["query", "id"]).select("query", "node", F.col("r").alias("score")))


def neighbourhoods(seeds: DataFrame, adj: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops) as bfs() has them, for many seeds; adj holds both directions.

    Seeds with the same neighbours are as far from every node but themselves, so only one of them is walked from. What it
    reaches is spread to the others by a last join that shuffles none of the rows that come out.
    """
    if depth < 2:
        return bfs(seeds, adj, depth)
    led = saved(leads(seeds, adj))
    reached = saved(bfs(led.select(F.col("lead").alias("seed")).distinct(), adj, depth).withColumnRenamed("seed", "lead"))
    size = saved(reached.groupBy("lead").agg(F.count("*").alias("size")).withColumn("ways", F.least(F.lit(SPREAD), F.ceil(F.col("size") / 64)).cast("int")))
    told = led.join(size, "lead").agg(F.sum("size").alias("rows"), F.sum(F.when(F.col("seed") == F.col("lead"), F.col("ways"))).alias("shards")).first()
    tasks = max(adj.sparkSession.sparkContext.defaultParallelism, min((told["rows"] or 0) // SPREAD_ROWS + 1, told["shards"] or 0))
    left = led.join(size, "lead").select("seed", "lead", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    right = reached.join(size, "lead").select("lead", "node", "hops", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int").alias("way"))
    left, right = left.repartition(tasks, "lead", "way"), right.repartition(tasks, "lead", "way")
    # the seed itself is two hops from its lead, as its lead is from it
    hops = F.when(F.col("node") == F.col("seed"), 0).when(F.col("node") == F.col("lead"), 2).otherwise(F.col("hops")).cast("long")
    return left.join(right.hint("shuffle_hash"), ["lead", "way"]).select("seed", "node", hops.alias("hops"))


def leads(seeds: DataFrame, adj: DataFrame) -> DataFrame:
    """(seed, lead): of seeds with the same neighbours the smallest leads; one without neighbours leads itself."""
    own = seeds.select("seed").distinct()
    near = own.join(adj, own.seed == adj.a).groupBy("seed").agg(*neighbour_marks("b"))
    alike = F.struct("n", "x", "y", F.when(F.col("n").isNull(), F.col("seed")).alias("alone"))
    kinds = saved(own.join(near, "seed", "left").select("seed", alike.alias("kind")))
    return kinds.join(kinds.groupBy("kind").agg(F.min("seed").alias("lead")), "kind").select("seed", "lead")


def related_items(seeds: DataFrame, adj: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, item, hops): the items linked to a seed or to what it reaches within `depth`, by the fewest hops."""
    return bfs(seeds, adj, depth).join(links, "node").groupBy("seed", "item").agg(F.min("hops").alias("hops"))


def related_counts(seeds: DataFrame, adj: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, items): how many items related_items() has of each seed that has any.

    adj holds both directions. Seeds with the same neighbours reach the same nodes within two hops or more, themselves
    included, so only one of them is walked from.
    """
    if depth < 2:
        return related_items(seeds, adj, links, depth).groupBy("seed").agg(F.count("*").alias("items"))
    own = seeds.select("seed").distinct()
    near = own.join(adj, own.seed == adj.a).groupBy("seed").agg(*neighbour_marks("b"))
    marked = saved(own.join(near, "seed", "left"))
    alike = F.struct("n", "x", "y", F.when(F.col("n").isNull(), F.col("seed")).alias("alone"))  # a seed without neighbours is its own kind
    kinds = marked.select("seed", alike.alias("kind"))
    lead = kinds.groupBy("kind").agg(F.min("seed").alias("lead"))
    reached = bfs(lead.select(F.col("lead").alias("seed")), adj, depth)
    found = reached.select(F.col("seed").alias("lead"), "node").join(links, "node").select("lead", "item").distinct().groupBy("lead").agg(F.count("*").alias("items"))
    return kinds.join(lead, "kind").join(found, "lead").select("seed", "items")


def neighbour_marks(node: str) -> list[Column]:
    """Aggregates that tell sets of distinct nodes apart: their number and two 64-bit hashes."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(node)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), node)).alias("y")]


def backlinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, source): what links to each of nodes(node)."""
    return edges.select(F.col("target").alias("node"), "source").join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def explain(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node, hop, a, b, relation): the first edge (by seq), in either direction, of every hop of bfs() paths."""
    w = F.split("path", ">")
    hops = paths.withColumn("w", w).where("size(w) > 1").select("seed", "node", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("hop"))
    hops = hops.select("seed", "node", F.col("hop").cast("long").alias("hop"), F.element_at("w", F.col("hop")).alias("a"), F.element_at("w", F.col("hop") + 1).alias("b"))
    first = edges.groupBy(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")).agg(F.min_by("relation", "seq").alias("relation"))
    return hops.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(first, ["low", "high"]).select("seed", "node", "hop", "a", "b", "relation")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a key of nodes(key, label, alias, kind, seq): all aliases, the first label that isn't the key, the last kind."""
    real = F.when(F.col("label") != F.col("key"), F.col("seq"))
    return nodes.groupBy("key").agg(F.coalesce(F.min_by("label", real), F.first("key")).alias("label"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"), F.max_by("kind", "seq").alias("kind"), F.count("*").alias("merged"))


def unlink_items(evidence: DataFrame, removed: DataFrame) -> DataFrame:
    """(edge, evidence_left, invalidated) of evidence(edge, item) once items are removed: an edge that loses all is invalid."""
    marked = evidence.distinct().join(removed.select("item", F.lit(1).alias("out")).distinct(), "item", "left")
    return marked.groupBy("edge").agg(F.count(F.when(F.col("out").isNull(), 1)).alias("evidence_left")).withColumn("invalidated", F.col("evidence_left") == 0)

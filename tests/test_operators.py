"""Operators on small frames, against plain Python where order matters."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ctxspark.functions import text as T
from ctxspark.operators import assemble, chunking, evaluate, fold, graph, memory, predicates, retrieval
from ctxspark.plans.pipeline import Pipeline
from ctxspark.sources import files


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0]), ([0.1] * 2, [0.1] * 2)], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(retrieval.cosine("a", "b")).collect()] == [1, -1, 0, 1]


def test_knn_ties_zero_and_sizes(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0]), (5, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.id, r.score, r.rank) for r in retrieval.knn(q, items, 3).orderBy("rank").collect()] == [(1, 1.0, 1), (3, 1.0, 2), (2, 0.0, 3)]
    assert retrieval.knn(q.limit(0), items).count() == 0


def test_knn_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    items = spark.createDataFrame([(i, vec()) for i in range(60)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, vec()) for i in range(7)], "query_id long, embedding array<double>")
    whole = sorted(retrieval.knn(q, items, 5).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(retrieval.knn(q, items, 5).collect()) == whole


def test_rrf_single_and_ties(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, id long, score double, rank long")
    assert retrieval.rrf([ranked([(1, 5, 0.1, 1)])]).first().score == 1.0
    tied = retrieval.rrf([ranked([(1, 5, 0.1, 1)]), ranked([(1, 6, 0.1, 1)])]).collect()
    assert [r.score for r in tied] == [0.0, 0.0]


def test_where_semantics(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": "5"}'), (3, "{}")], "id long, p string").withColumn("v", F.parse_json("p"))
    ids = lambda c: sorted(r.id for r in df.where(predicates.where(c, predicates.variant_field("v"))).collect())
    assert ids({"k": {"$ne": 7}}) == [1, 2, 3] and ids({"k": {"$nin": [5]}})[-1] == 3
    assert ids({"z": {"$gt": 1}}) == [] and ids({"z": None}) == [1, 2, 3] and ids({"k": {"$in": []}}) == []
    with pytest.raises(ValueError):
        ids({"k": {"$like": 1}})


def test_scopes():
    s = predicates.Scope(("/a",)).intersect(predicates.Scope(("/a/b", "/c")))
    assert s.include == ("/a/b",)
    assert predicates.Scope(("/a",)).intersect(predicates.Scope(("/b",))).exclude == ("/",)
    assert predicates.normalize_namespace("a//b/") == "/a/b"
    with pytest.raises(ValueError):
        predicates.validate_vault("a/b")


def test_scope_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("/a/x", 1), ("/ab", 2)], "ns string, n long").write.parquet(path)
    df = spark.read.parquet(path).where(predicates.Scope(("/a",)).column("ns")).select("n")
    assert "StringStartsWith(ns,/a/)" in df._jdf.queryExecution().toString()
    assert [r.n for r in df.collect()] == [1]


def test_pack_is_greedy(spark):
    rnd = random.Random(2)
    rows = [(q, i, rnd.randrange(1, 4), rnd.random(), rnd.randrange(1, 60)) for q in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, id long, priority int, score double, tokens long")
    got = {(r.query_id, r.id) for r in assemble.pack(df, 200, 20).where("included").collect()}
    want = set()
    for q in range(5):
        used = 0
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], -r[3], r[1])):
            if used + r[4] <= 180:
                used += r[4]
                want.add((q, r[1]))
    assert got == want
    with pytest.raises(ValueError):
        assemble.pack(df, 10, 10)


def test_sliding_memory_is_the_window(spark):
    rnd = random.Random(3)
    turns = spark.createDataFrame([(c, t, rnd.randrange(1, 90)) for c in range(4) for t in range(30)], "conv_id long, turn long, tokens long")
    last = {r.conv_id: 30 - r.evicted_so_far for r in memory.sliding_memory(turns, 100).where("turn = 29").collect()}
    assert last == {r.conv_id: r["count"] for r in memory.fifo_window(turns, 100).groupBy("conv_id").count().collect()}


def test_ordered_fold_streams_a_hot_key(spark):
    df = spark.range(30_000).selectExpr("1L as k", "id as n")
    out = fold.ordered_fold(df, ["k"], ["n"], ["n"], lambda: {"s": 0}, lambda s, r: s.update(s=s["s"] + r["n"]) or s["s"], "total", LongType())
    assert out.agg(F.max("total")).first()[0] == 30_000 * 29_999 // 2


def test_fixed_chunks(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 57, 100])]
    df = spark.createDataFrame(texts, "id long, content string")
    got = {(r.id, r.chunk_index): r.content for r in chunking.fixed(df, 10, 3).collect()}
    want = {}
    for i, t in texts:
        w, at, n = t.split(), 0, 0
        while w and (at == 0 or at + 3 < len(w)):
            want[i, n] = " ".join(w[at : at + 10])
            at, n = at + 7, n + 1
    assert got == want


def test_text_chunkers():
    text = "One two. Three four five! Six? Seven eight nine ten. Eleven."
    chunks = chunking.sentence_chunks(text, 5, 1)
    assert chunks[0].startswith("One two.") and all(len(c.split()) <= 9 for c in chunks)
    assert all(len(c.split()) <= 4 for c in chunking.recursive_chunks("a b c d e f\n\ng h\n\ni j k l m", 4))
    md = chunking.markdown_chunks("# A\nx\n## B\ny\n# C\nz")
    assert md == ["A\nx", "A > B\ny", "C\nz"]
    code = chunking.code_chunks("import a\ndef f():\n  pass\ndef g():\n  pass\n", 4)
    assert any(c.startswith("def g") for c in code)
    table = "| h | i |\n| --- | --- |\n" + "\n".join(f"| {k} | x |" for k in range(20))
    parts = chunking.table_chunks("before\n" + table + "\nafter", 40)
    assert sum(p.startswith("| h | i |") for p in parts) > 1 and parts[-1].strip() == "after"


def test_parsers(spark, tmp_path):
    html = "<html><title>T &amp; U</title><script>no()</script><p>a</p><p>b<br>c</p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td></tr></table></html>"
    text, title = files.html_text(html)
    assert title == "T & U" and "no()" not in text and text.startswith("T & U\na\n") and "\n\n\n" not in text
    assert files.html_tables(html) == ["| x | y |\n| --- | --- |\n| 1 |  |"]
    assert files.markdown("---\ntitle: Note\n---\n# Head\nx")[1:] == ("Note", {"title": "Note", "headings": ["Head"]})
    (tmp_path / "a.csv").write_text("n,m\n1,\n2,z\n")
    (tmp_path / "b.md").write_text("# Top\nbody")
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.txt").write_bytes("caf\xe9".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.ingest_directory(spark, str(tmp_path)).collect()}
    assert got["a.csv"].text == "n: 1\nn: 2; m: z" and got["b.md"].title == "Top" and got["d.txt"].text == "caf\xe9"
    assert got["c.json"].error.startswith("JSONDecodeError") and len(got["b.md"].doc_id) == 16


def test_bfs_and_pagerank(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(30)]
    adj = graph.adjacency(spark.createDataFrame(pairs, "source long, target long"))
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seed = min(near)
    want, front = {seed: 0}, {seed}
    for h in (1, 2, 3):
        front = {b for a in front for b in near[a]} - set(want)
        want |= dict.fromkeys(front, h)
    got = graph.bfs(spark.createDataFrame([(seed,)], "seed long"), adj, 3).collect()
    assert {r.node: r.hops for r in got} == want
    rank = {seed: 1.0}
    for _ in range(12):
        new = {seed: 0.5}
        for n, r in rank.items():
            for b in near[n]:
                new[b] = new.get(b, 0) + 0.5 * r / len(near[n])
        rank = new
    got = {r.node: r.score for r in graph.pagerank(spark.createDataFrame([(1, seed)], "query long, node long"), adj, 0.5, 12).collect()}
    assert all(math.isclose(got[n], rank[n], abs_tol=1e-9) for n in rank)


def test_pagerank_classes(spark):
    """Directed links, dangling and isolated nodes, several seeds and twins; rounds run over few classes of twins."""
    rnd = random.Random(12)
    links = {(rnd.randrange(9), rnd.randrange(12)) for _ in range(25)} | {(k, 3) for k in range(20, 60)} | {(3, k) for k in range(20, 60)} | {(4, k) for k in range(70, 75)}
    adj = spark.createDataFrame(sorted(links), "a long, b long")
    seeds = {1: [0, 1, 21], 2: [22], 3: [23], 4: [23, 24, 3], 5: [99], 6: [70, 99], 7: [11]}
    frame = spark.createDataFrame([(q, n) for q, ns in seeds.items() for n in ns], "query long, node long")
    assert graph.node_classes(frame.select("node"), adj).where("node >= 20 and node < 60").select("class").distinct().count() == 1
    to = {}
    for a, b in links:
        to.setdefault(a, []).append(b)

    def walk(ns, rounds, tolerance=0.0):
        rank = {n: 1 / len(ns) for n in ns}
        for _ in range(rounds):
            lost = sum(0.5 * r for n, r in rank.items() if n not in to)
            new = {n: (0.5 + lost) / len(ns) for n in ns}
            for n, r in rank.items():
                for b in to.get(n, ()):
                    new[b] = new.get(b, 0) + 0.5 * r / len(to[n])
            gap, rank = sum(abs(new.get(n, 0) - rank.get(n, 0)) for n in {*new, *rank}), new
            yield rank, gap

    for rounds in (1, 6):
        got = graph.pagerank(frame, adj, 0.5, rounds).collect()
        want = {(q, n): r for q, ns in seeds.items() for n, r in list(walk(ns, rounds))[-1][0].items()}
        assert len(got) == len(want) and all(math.isclose(r.score, want[r.query, r.node], abs_tol=1e-12) for r in got)
    walks = {q: list(walk(ns, 40)) for q, ns in seeds.items()}
    stop = next(k for k in range(40) if all(w[k][1] <= 1e-4 for w in walks.values()))
    got = graph.pagerank(frame, adj, 0.5, 40, 1e-4).collect()
    assert stop > 2 and all(math.isclose(r.score, walks[r.query][stop][0][r.node], abs_tol=1e-12) for r in got)


def test_item_scores_by_classes(spark):
    """The k best items are those of pagerank(), with seeds in the core, in stems, in leaves and several at once."""
    rnd = random.Random(17)
    edges = [(f"c{k}", f"n{k % 3}") for k in range(24)] + [("n0", "r0"), ("n1", "r0"), ("n2", "r1"), ("r1", "n0"), ("x1", "x2"), ("n1", "n2")]
    links = [(f"c{k}", 100 * k + j) for k in range(24) for j in range(rnd.choice([0, 1, 2, 2, 5]))] + [("c1", 9000), ("c2", 9000), ("n1", 9001), ("r1", 9002), ("x1", 9003)]
    seeds = [(k, f"c{k}") for k in range(24)] + [(30, "n1"), (31, "c3"), (31, "c6"), (31, "n0"), (32, "x1"), (33, "x2")]
    e = spark.createDataFrame(edges, "source string, target string")
    item = spark.createDataFrame(links, "node string, item long")
    q = spark.createDataFrame([(q, f"n:{n}") for q, n in seeds], "query long, node string")
    both = e.selectExpr("'n:' || source source", "'n:' || target target").union(item.selectExpr("'n:' || node", "'i:' || item"))
    adj = graph.saved(graph.adjacency(both))
    assert {r.kind for r in graph.branches(adj).select("kind").distinct().collect()} == {"C", "L", "R", "RL"}
    want, got = {}, {}
    for r in graph.pagerank(q, adj, 0.5, 6).where("node like 'i:%' and score > 0").collect():
        want.setdefault(r.query, []).append((-round(r.score, 9), r.node))
    for r in graph.item_scores(q, adj, 4, 0.5, 6, 9).collect():
        got.setdefault(r.query, []).append((-round(r.score, 9), r.node))
    assert len(want) > 24
    for key, rows in want.items():
        assert [x[1] for x in sorted(got[key])[:4]] == [x[1] for x in sorted(rows)[:4]], key
        assert all(math.isclose(x[0], y[0], abs_tol=2e-9) for x, y in zip(sorted(got[key])[:4], sorted(rows)[:4], strict=True))


def test_related_counts(spark):
    """As related_items() counts, also for seeds without neighbours or items, repeated links, and items of several nodes."""
    rnd = random.Random(8)
    pairs = [(rnd.randrange(30), 100 + rnd.randrange(4)) for _ in range(40)] + [(100, 200), (101, 200)]
    adj = graph.adjacency(spark.createDataFrame(pairs, "source long, target long")).localCheckpoint()
    links = spark.createDataFrame([(rnd.randrange(34), rnd.randrange(25)) for _ in range(60)] + [(33, 99), (33, 99)], "node long, item long")
    seeds = spark.createDataFrame([(k,) for k in [*range(34), 5]], "seed long")
    walked = []
    bfs = graph.bfs
    for depth in (1, 2, 3):
        want = graph.related_items(seeds.distinct(), adj, links, depth).groupBy("seed").count()
        graph.bfs = lambda s, *a, **b: walked.append(s.count()) or bfs(s, *a, **b)
        try:
            got = graph.related_counts(seeds, adj, links, depth)
        finally:
            graph.bfs = bfs
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert walked[1] < 30


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, id long, rank long")
    rel = spark.createDataFrame([(1, 11), (1, 99)], "query_id long, id long")
    m = evaluate.retrieval_metrics(ranked, rel, 10).first()
    assert (round(m.precision, 6), m.recall, m.mrr, m.hit_rate) == (0.333333, 0.5, 0.5, 1.0)
    assert math.isclose(m.ndcg, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    same = spark.createDataFrame([(1.0, 1.0)] * 3, "a double, b double")
    assert evaluate.ab_test(same).first().winner == "tie"


def test_pipeline_skips_failing_steps(spark):
    q = spark.createDataFrame([(1,)], "query_id long")

    def bad(queries, items):
        raise RuntimeError("no")

    p = Pipeline(100).system_prompt("be brief", 2).step("bad", bad, on_error="skip")
    assert p.build(q).first().included
    with pytest.raises(RuntimeError):
        Pipeline(100).step("bad", bad).build(q)


def test_keys_and_overlap(spark):
    df = spark.createDataFrame([(" Big-Red  Car_ ", "red car", "a RED thing")], "k string, q string, c string")
    r = df.select(T.normalize_key("k").alias("k"), T.keyword_overlap("q", "c").alias("o")).first()
    assert r.k == "big_red_car" and r.o == 0.5


def test_items_by_vault_and_upsert(spark, tmp_path):
    items = spark.createDataFrame([("v1", 1, "a"), ("v2", 2, "b")], "vault string, id long, content string")
    files.write_items(items, str(tmp_path / "items"))
    back = spark.read.parquet(str(tmp_path / "items"))
    assert [r.id for r in back.where("vault = 'v1'").collect()] == [1]
    new = files.upsert(items, spark.createDataFrame([("v1", 1, "z")], "vault string, id long, content string"), ["vault", "id"])
    assert sorted(r.content for r in new.collect()) == ["b", "z"]

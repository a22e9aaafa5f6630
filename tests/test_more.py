"""What SQL has no form for: chunkers, parsers, folds, stores, streams and graphs against plain Python on small inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ctxspark import cli
from ctxspark.functions import text as T
from ctxspark.operators import assemble, chunking, evaluate, graph, indexing, memory, observe, predicates, retrieval
from ctxspark.plans import catalog, more  # noqa: F401
from ctxspark.plans.pipeline import Pipeline
from ctxspark.sources import files, stores

SF = "/root/testdata/sf0.001"


def texts(spark, n=60):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()
    return {r.doc_id: r.text or "" for r in rows}


def chunks_of(spark, name):
    got = {}
    for r in catalog.queries()[name](spark, SF).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    return got


def test_sliding_memory_brute(spark):
    turns = catalog.turns(spark, SF).collect()
    got = {(r.conv_id, r.turn): r.evicted_so_far for r in catalog.queries()["sliding_memory"](spark, SF).collect()}
    assert len(got) == len(turns)
    for conv in {t.conv_id for t in turns}:
        held, out = [], 0
        for t in sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.turn):
            held.append(min(t.tokens, 120))
            while sum(held) > 120:
                held.pop(0)
                out += 1
            assert got[conv, t.turn] == out


def test_folds_take_a_null_key_for_one_group(spark):
    rows = [(k, i, 50, "same") for k in (None, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, tokens long, call string")
    out = memory.sliding_memory(df, 100)
    assert out.schema["conv_id"].dataType.simpleString() == "bigint"
    got = {(r.conv_id, r.turn): r.evicted_so_far for r in out.collect()}
    assert [got[None, i] for i in range(6)] == [got[1, i] for i in range(6)] == [0, 0, 1, 2, 3, 4]
    packed = assemble.pack(df.withColumnsRenamed({"conv_id": "query_id", "turn": "id"}).withColumns({"priority": F.lit(1), "score": F.lit(1.0)}), 120)
    assert sorted((str(r.query_id), r.id) for r in packed.where("included").collect()) == [("1", 0), ("1", 1), ("None", 0), ("None", 1)]
    assert observe.stuck(df, "conv_id", ["turn"], "call", 3).count() == 8
    none = spark.createDataFrame([(1, 0, None), (1, 1, 5)], "conv_id long, turn long, tokens long")
    assert [r.evicted_so_far for r in memory.sliding_memory(none, 4).orderBy("turn").collect()] == [0, 0]


def test_sentence_chunks_brute(spark):
    got = chunks_of(spark, "chunk_sentence")
    for i, t in texts(spark).items():
        parts, want, at = chunking.sentences_of(t), [], 0
        while at < len(parts):
            fits = [n for n in range(1, len(parts) - at + 1) if n == 1 or len(" ".join(parts[at : at + n]).split()) <= 128]
            n = next((k for k in range(1, len(parts) - at + 1) if k + 1 not in fits), len(parts) - at)
            want.append(" ".join(parts[at : at + n]))
            at += max(1, n - 1)
        assert got.get(i, []) == want


def test_recursive_chunks_hold_every_word(spark):
    got = chunks_of(spark, "chunk_recursive")
    for i, t in texts(spark).items():
        assert " ".join(" ".join(got.get(i, [])).replace(". ", " ").replace(".", " ").split()) == " ".join(t.replace(".", " ").split())
        assert all(0 < len(c.split()) <= 128 for c in got.get(i, []))
    words = " ".join(f"w{k}" for k in range(30))
    plain = chunking.recursive_chunks(words, 10)
    assert plain == [" ".join(f"w{k}" for k in range(a, a + 10)) for a in (0, 10, 20)]
    assert chunking.recursive_chunks(words, 10, overlap=3) == plain  # no room for more words
    parted = "\n\n".join(" ".join(f"{p}{k}" for k in range(6)) for p in "abc")
    assert chunking.recursive_chunks(parted, 10, overlap=2)[1] == "a4 a5 b0 b1 b2 b3 b4 b5"
    assert chunking.recursive_chunks("x" * 50 + " " + "y", 1, tokens=len) == ["x" * 50, "y"]
    with pytest.raises(ValueError):
        chunking.recursive_chunks("a", 5, overlap=5)


def test_markdown_chunks_carry_their_headings(spark):
    got = chunks_of(spark, "chunk_markdown")
    for r in catalog.items(spark, SF).limit(30).collect():
        body = [c.split("\n", 1) for c in got[r.id]]
        heads = {h for h, *_ in body}
        assert all(h.startswith(f"{r.lang} > {r.source}") or h.startswith(f"{r.lang}") for h in heads)
        assert sum(len(b[0].split()) if b else 0 for _, *b in body) <= len((r.content or "").split()) + 1
    text = "intro\n# A\nx\n## B\ny\n# C\nz"
    assert chunking.markdown_chunks(text) == ["intro", "A\nx", "A > B\ny", "C\nz"]


def test_code_chunks():
    py = "import os\n\n@cached\ndef a():\n    pass\n\nclass B:\n    def m(self):\n        pass\n\nasync def c():\n    pass\n"
    assert chunking.code_chunks(py, 6) == ["import os\n\n@cached\ndef a():\n    pass", "class B:\n    def m(self):\n        pass", "async def c():\n    pass"]
    assert chunking.code_chunks(py, 100) == [py.strip()]
    ts = "const x = 1\nlet y = 2\nexport default function f() {}\ninterface I {}\n"
    assert chunking.code_chunks(ts, 4, "typescript") == ["const x = 1\nlet y = 2", "export default function f() {}\ninterface I {}"]
    assert chunking.code_chunks("type T int\nfunc f() {\n}\nvar v = 1\n", 4, "go") == ["type T int", "func f() {\n}\nvar v = 1"]
    assert chunking.code_chunks("struct S;\npub fn f() {}\nimpl S {}\n", 3, "rust") == ["struct S;", "pub fn f() {}", "impl S {}"]
    long = "def a():\n" + "    x = 1\n" * 40
    assert chunking.code_chunks(long, 10) == [long.strip()]  # a definition stays whole
    assert chunking.code_chunks("a b c d e f", 4, None, overlap=1) == chunking.recursive_chunks("a b c d e f", 4, overlap=1)
    assert {chunking.LANGUAGES[e] for e in (".py", ".jsx", ".tsx", ".go", ".rs")} == set(chunking.BOUNDARIES)


def test_code_query(spark):
    got = chunks_of(spark, "chunk_code")
    for i, t in texts(spark, 30).items():
        first, second = f"def a():\n    {t}\n", "def b():\n    pass\n"
        want = [(first + second).strip()] if len((first + second).split()) <= 256 else [first.strip(), second.strip()]
        assert got[i] == want


def test_table_chunks():
    md = "before\n\n| a | b |\n| --- | --- |\n" + "".join(f"| {k} | x |\n" for k in range(6)) + "\nafter"
    whole = chunking.table_chunks(md, 100)
    assert whole[0] == "before" and whole[2] == "after" and whole[1].count("\n") == 7
    cut = chunking.table_chunks(md, 20)
    assert all(c.startswith("| a | b |\n| --- | --- |\n") for c in cut[1:-1]) and sum(c.count("| x |") for c in cut) == 6
    html = "x <TABLE class=t><tr><td>1 2 3</td></tr>\n<tr><td>4 | 5</td></tr></TABLE> y"
    assert chunking.table_chunks(html, 50) == ["x", "<TABLE class=t><tr><td>1 2 3</td></tr>\n<tr><td>4 | 5</td></tr></TABLE>", "y"]
    assert chunking.table_chunks(html, 4) == ["x", "<tr><td>1 2 3</td></tr>", "<tr><td>4 | 5</td></tr>", "y"]


def test_table_query(spark):
    pages = {r.id: r for r in files.parse_html(catalog.table(spark, SF, "pages")).limit(20).collect()}
    got = chunks_of(spark, "chunk_table")
    for i, r in pages.items():
        assert got.get(i, []) == chunking.table_chunks("\n\n".join([*r.tables, r.text]), 128)


def test_semantic_chunks(spark):
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    rows = [(1, n, f"{k}{n} x y z", vec[k]) for n, k in enumerate("aaabbbaab")] + [(2, 0, "short one", vec["a"]), (2, 1, "and two", vec["b"])]
    df = spark.createDataFrame(rows, "id long, n long, sentence string, vector array<double>")
    got = {}
    for r in chunking.semantic(df, size=12, least=5).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got[2] == ["short one and two"]  # fits as a whole
    groups = ["a0 x y z a1 x y z a2 x y z", "b3 x y z b4 x y z b5 x y z", "a6 x y z a7 x y z b8 x y z"]
    assert got[1] == groups
    assert chunking.semantic_groups(["a b c d e f", "g"], 4, 2) == ["a b c d", "e f g"]
    assert chunking.semantic_groups([], 4, 2) == []


def test_html(spark):
    html = "<html><head><title>A &amp; b</title><style>x</style></head><body><p>one<br>two<script>3</script><ul><li>f</ul><table><tr><th>h<th>i</tr><tr><td>1</td></tr></table>"
    text, title = files.html_text(html)
    assert title == "A & b" and text == "A & b\none\ntwo\nfhi1"
    pages = catalog.table(spark, SF, "pages").collect()
    got = {r.page_id: r for r in catalog.queries()["parse_html"](spark, SF).collect()}
    for p in pages:
        text, title = files.html_text(p.html or "")
        assert (got[p.page_id].title, got[p.page_id].chars, got[p.page_id].tables) == (title, len(text), len(files.html_tables(p.html or "")))
        assert "<" not in title and (not title or title in text)
    assert files.markdown_table("| a | b\\|c |\n|---|:-:|\n| 1 |  |") == [["a", "b|c"], ["1", ""]]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\naliases: [x, y]\n---\n# H1\ntext\n## H2\n")
    (tmp_path / "b.csv").write_text("k,v\n1,\n2,x\n")
    (tmp_path / "c.json").write_text('{"a": 1, "b": [2]}')
    (tmp_path / "d.txt").write_text("l1\nl2")
    (tmp_path / "e.json").write_text("{")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.ingest_directory(spark, str(tmp_path)).collect()}
    meta = {k: json.loads(r.meta) for k, r in got.items() if r.meta}
    assert got["a.md"].title == "T" and meta["a.md"]["aliases"] in (["x", "y"], "[x, y]") and meta["a.md"]["headings"] == ["H1", "H2"]
    assert got["b.csv"].text == "k: 1\nk: 2; v: x" and (meta["b.csv"]["columns"], meta["b.csv"]["row_count"]) == (["k", "v"], 2)
    assert meta["c.json"]["top_level_keys"] == ["a", "b"] and meta["d.txt"]["line_count"] == 2
    assert got["e.json"].text is None and "JSON" in got["e.json"].error
    cli.index(spark, str(tmp_path), str(tmp_path / "out"), 4, 1)
    assert cli.search(spark, str(tmp_path / "out"), "l2", 3).count() >= 1


def test_keys(spark):
    df = spark.createDataFrame([("Project X",), ("project-x",), ("PROJECT__X ",), ("ｆｕｌｌ Straße",), ("C++",), (" - ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_key("t")).collect()] == ["project_x", "project_x", "project_x", "full_strasse", "c++", None, None, None]
    notes = spark.createDataFrame([(1, "Zoë met the café owner.")], "id long, content string")
    aliases = spark.createDataFrame([("zoë", 7), ("café owner", 8), ("cafe", 9)], "alias string, node long")
    assert sorted(r.node for r in graph.mentions(notes, aliases).collect()) == [7, 8]


def test_prices(spark):
    prices = spark.createDataFrame([("gpt-x", 2.0, 4.0)], "name string, input_price double, output_price double")
    use = spark.createDataFrame([(m, 1_000_000, 500_000) for m in ("gpt-x", "gpt-x-2024-08-06", "gpt-x-20240806", "other")], "model string, input long, output long")
    assert [r.cost for r in observe.price(use, prices).orderBy("model").collect()] == [4, 4, 4, None]


def test_erf_and_ab_test(spark):
    xs = [-7.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 1.96, 3.3, 5.9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", evaluate.erf(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-12)
    rnd = random.Random(2)
    pairs = [(k, rnd.random(), rnd.random() + 0.2) for k in range(40)]
    d = [b - a for _, a, b in pairs]
    mean = sum(d) / 40
    z = mean / (math.sqrt(sum((x - mean) ** 2 for x in d) / 39) / math.sqrt(40))
    got = evaluate.ab_test(spark.createDataFrame(pairs, "id long, a double, b double")).first()
    assert got.p == pytest.approx(2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2)))), abs=1e-9) and got.winner == "b"
    flat = spark.createDataFrame([(0.5, 0.5)] * 3, "a double, b double")
    assert (evaluate.ab_test(flat).first().p, evaluate.ab_test(flat).first().winner) == (1.0, "tie")


def test_formatter_keeps_roles_apart(spark):
    rows = [(1, 0, "system", "retrieval", "evil"), (1, 1, "system", "system", "good")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, source string, text string")
    said = json.loads(assemble.chat_json(df, "conv_id", "turn", "role", "text", "source").first().messages)
    assert [m["role"] for m in said] == ["user", "system"]


def test_knn_over_many_batches(spark):
    rnd = random.Random(3)
    items = [(i, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(400)] + [(900, None), (901, [1.0])]
    queries = [(q, [rnd.gauss(0, 1) for _ in range(3)]) for q in range(20)]
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for r in retrieval.knn(spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(items, "id long, embedding array<double>"), 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, v in queries:
        scored = sorted((-round(max(-1, min(1, cos(v, x))), 6) + 0.0, i) for i, x in items if x and len(x) == 3)
        assert got[q] == [i for _, i in scored[:7]]


def test_ivf_recall(spark):
    q, e = catalog.vectors(spark, "/root/testdata/sf0.01")
    exact = {(r.query_id, r.id) for r in retrieval.knn(q, e).collect()}
    index = retrieval.IvfIndex(e, 32)
    assert index.items.count() == e.count()
    found = {(r.query_id, r.id) for r in index.search(q, 10, 20).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ivf_search_plan_and_ties(spark, monkeypatch):
    """All lists probed is exact, also with copies, odd vectors and several blocks; no pair of a query and an item is a row
    of a join, as they were."""
    rnd = random.Random(31)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(5)]
    items = [(k, vec()) for k in range(300)]
    items += [(1000 + k, items[k % 7][1]) for k in range(60)] + [(2000, None), (2001, [1.0]), (2002, [0.0] * 5)]
    e = spark.createDataFrame(items, "id long, embedding array<double>")
    q = spark.createDataFrame([(k, v) for k, v in items if k % 3 == 0 and v and len(v) == 5], "query_id long, embedding array<double>")
    index = retrieval.IvfIndex(e, 8, sample=200)
    monkeypatch.setattr(retrieval, "SEARCH_BLOCK", 50)
    got = index.search(q, 10, 8)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert key(got) == key(retrieval.knn(q, e.where("size(embedding) = 5")))
    empty = retrieval.IvfIndex(e.limit(0), 8)
    assert empty.items.count() == 0 and empty.search(q).count() == 0


def test_streams_over_part_files(spark, tmp_path):
    """Tables that are folders of part files, as larger ones are, stream as single files do; empty ones give no rows."""
    for name in ("conversations", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/parts/{name}.parquet")
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name in ("stream_conversation_window", "stream_tumbling"):
        run = lambda folder, fn=catalog.queries()[name]: sorted(map(str, fn(spark, folder).collect()))
        assert len(run(SF)) > 10 and run(f"{tmp_path}/parts") == run(SF) and not run(f"{tmp_path}/none")


def test_embed_hashed(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    vec = {r.doc_id: np.array(retrieval.hashed_words(64)([r.text])[0]) for r in rows if r.text is not None}
    for r in catalog.queries()["embed_hashed"](spark, SF).collect():
        scores = sorted(((-round(float(vec[r.query_id] @ v), 6), i) for i, v in vec.items()))
        assert abs(-scores[r.rank - 1][0] - r.score) < 2e-6
    df = spark.createDataFrame([(1, None), (2, "a b")], "id long, content string")
    assert [r.embedding is None for r in retrieval.embed(df, retrieval.hashed_words(8), batch=1).orderBy("id").collect()] == [True, False]


def test_analyzer(spark):
    df = spark.createDataFrame([("The Cats, running to cats' beds",)], "t string")
    tokens = retrieval.analyzer(retrieval.STOP_WORDS, lambda w: w.removesuffix("s"))
    assert df.select(tokens(F.col("t"))).first()[0] == ["cat", "running", "cat", "bed"]
    found = retrieval.bm25(spark.createDataFrame([(1, "the cat")], "query_id long, text string"), spark.createDataFrame([(1, "cats sleep"), (2, "the dog")], "id long, content string"), tokens=tokens)
    assert [r.id for r in found.collect()] == [1]


def test_rerank_with_a_service(spark):
    rows = [(q, "find b", i, float(9 - i), i + 1, c) for q in (1, 2) for i, c in enumerate(["a", "b", "bb"])]
    df = spark.createDataFrame(rows, "query_id long, text string, id long, score double, rank long, content string")
    service = lambda q, texts: [(i, texts[i].count("b") / 3) for i in sorted(range(len(texts)), key=lambda i: -texts[i].count("b"))] + [(7, 1.0)]
    got = [(r.query_id, r.id, r.rank) for r in retrieval.rerank_with(df, service, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 1, 2), (2, 2, 1), (2, 1, 2)]
    with pytest.raises(Exception, match="candidates"):
        retrieval.rerank_with(df, service, most=2).collect()


def test_routes(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, text string")
    hit = lambda n: lambda d: d.select("query_id", F.lit(n).alias("id"))
    label = F.when(F.col("text") == "x", "a")
    assert sorted(map(tuple, retrieval.routed(q, label, {"a": hit(1), "b": hit(2)}, "b").collect())) == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="no retriever"):
        retrieval.routed(q, label, {"a": hit(1)}).collect()


def test_pipeline_steps(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    item = lambda n, source, tokens: lambda d: d.select("query_id", F.lit(n).cast("long").alias("id"), F.lit(source).alias("source"), F.lit(5).alias("priority"), F.lit(0.5).alias("score"), F.lit(tokens).cast("long").alias("tokens"))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    links = spark.createDataFrame([("c", 11), ("b", 12), ("y", 13)], "node string, item long")
    held = spark.createDataFrame([(i, f"e{i}", 0.4, 3) for i in (11, 12, 13)], "id long, content string, relevance_score double, tokens long")
    seeds = lambda d: d.where("query_id = 1").select("query_id", F.lit("a").alias("node"))
    p = Pipeline(20).classified("route", F.when(F.col("text") == "one", "l"), {"l": item(1, "retrieval", 4), "m": item(2, "retrieval", 4)}, "m").graph_memory("graph", edges, links, held, seeds, most=5)
    p = p.retrieve("more", item(3, "chat", 6)).retrieve("too much", item(4, "chat", 6)).cap_source("chat", 8)
    got = sorted((r.query_id, r.id) for r in p.build(q).where("included").collect())
    assert got == [(1, 1), (1, 3), (1, 11), (1, 12), (2, 2), (2, 3)]
    dropped = Pipeline(20).retrieve("a", item(3, "chat", 6)).retrieve("b", item(4, "chat", 6)).cap_source("chat", 8, "drop").retrieve("c", item(5, "tool", 1))
    assert sorted({r.id for r in dropped.build(q).where("included").collect()}) == [5]


def test_budget():
    b = assemble.TokenBudget.preset("rag", 1000)
    assert (b.allocation("retrieval"), b.allocation("nobody"), b.shared_pool, b.strategy("system")) == (400, 200, 200, "truncate")
    for bad in (lambda: assemble.TokenBudget(10, 10), lambda: assemble.TokenBudget(10, 0, {"a": 11}), lambda: assemble.TokenBudget(10, 0, {}, {"a": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_store(spark, tmp_path):
    store = stores.TableStore(spark, str(tmp_path / "s"), "id long, v string", ["id"], vault="a")
    assert store.rows().count() == 0 and store.version() is None
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    store.put(rows((1, "x"), (2, "y")))
    store.put(rows((2, "z"), (3, "w")))
    store.delete(rows((1, ""), (9, "")))
    assert sorted(map(tuple, store.rows().collect())) == [(2, "z"), (3, "w")]
    assert [r.v for r in store.get(rows((3, ""))).collect()] == ["w"]
    assert store.vacuum() == 2 and store.rows().count() == 2
    other = stores.TableStore(spark, str(tmp_path / "s"), "id long, v string, more int", ["id"], vault="b")
    assert other.rows().count() == 0
    store.clear()
    assert store.rows().count() == 0
    wide = stores.TableStore(spark, str(tmp_path / "s"), "id long, v string, more int", ["id"], vault="a")
    assert wide.rows().columns == ["id", "v", "more"]
    stores.save_json(spark, [{"b": 1}], str(tmp_path / "x.json"))
    stores.save_json(spark, [{"b": 2}], str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == [{"b": 2}]
    with pytest.raises(ValueError):
        predicates.same_vault(spark.createDataFrame([("a",), ("b",)], "vault string"))
    assert predicates.same_vault(spark.createDataFrame([("a",)], "vault string")) == "a"


def test_golden(spark, tmp_path):
    f = tmp_path / "g.jsonl"
    f.write_text('{"type": "add", "text": "x"}\n\n{"type": "del", "id": 3}\n')
    got = stores.read_golden(spark, str(f), "", {"add": "text string", "del": "id long"}).collect()
    assert [(r.kind, r.add and r.add.text, r["del"] and r["del"].id) for r in got] == [("add", "x", None), ("del", None, 3)]
    f.write_text('{"type": "no"}\n')
    with pytest.raises(Exception, match="g.jsonl"):
        stores.read_golden(spark, str(f), "", {"add": "text string"}).collect()
    f.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="not json"):
        stores.read_golden(spark, str(f), "a long").collect()


def test_cache_brute(spark):
    rnd = random.Random(5)
    log = [(rnd.choice([None, 1]), n, rnd.choice(["get", "get", "set", "set", "drop", "clear"] if n % 9 == 0 else ["get", "set"]), rnd.randrange(4), n * rnd.random()) for n in range(300)]
    df = spark.createDataFrame(log, "vault long, seq long, op string, key long, at double")
    got = {r.seq: r.hit for r in observe.cache_replay(df, 30.0, 3).collect()}
    for v in (None, 1):
        held = {}
        for _, n, op, key, at in sorted((x for x in log if x[0] == v), key=lambda x: x[1]):
            assert got[n] == (op == "get" and key in held and at - held[key] <= 30)
            if op == "clear":
                held = {}
            if op in ("drop", "set"):
                held.pop(key, None)
            if op == "set":
                held = {k: t for k, t in held.items() if at - t <= 30}
                if len(held) == 3:
                    held.pop(next(iter(held)))
                held[key] = at
    rows = catalog.queries()["cache_replay"](spark, SF)
    assert rows.where("hit and op <> 'get'").count() == 0 and rows.where("hit").count() > 0


def test_progressive(spark):
    rows = [(1, n, f"turn{n} said. fact {n % 60}", 4) for n in range(200)]
    t = memory.tiers(spark.createDataFrame(rows, "conv_id long, turn long, text string, tokens long"), 100)
    per = {r.tier: r.n for r in t.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 12, 1: 25, 2: 50, 3: 113}  # 50 tokens as they are, 100 and 200 more behind summaries
    out = memory.progressive(t, 100, lambda text, n: F.lit(None).cast("string"), lambda text: F.regexp_extract_all(text, F.lit(r"fact \d+"), F.lit(0)), most_facts=20, fact_tokens=30)
    got = {r.tier: r for r in out.collect()}
    assert len(got[1].content.split()) == 25 and len(got[2].content.split()) == 12 and got[0].content.count("turn") == 12
    want = [f"fact {n % 60}" for n in range(113)]
    newest = list(dict.fromkeys(reversed(want)))[:15][::-1]
    assert got[3].facts == newest and got[3].content is None
    held = catalog.queries()["memory_progressive"](spark, SF).collect()
    assert all((r.content is None) == (r.tier == 3) for r in held)


def test_memory_object(spark):
    turns = spark.createDataFrame([(1, n, "user", f"t{n}", 10) for n in range(5)], "conv_id long, turn long, role string, text string, tokens long")
    facts = spark.createDataFrame([(1, 1, "likes tea", 0.9, None)], "conv_id long, id long, content string, relevance_score double, expires_at timestamp")
    more_facts = spark.createDataFrame([(1, 2, "likes tea", 0.1, None), (1, 3, "has a dog", 0.5, None)], facts.schema)
    m = memory.Memory(turns, facts, 30).add_facts(more_facts)
    assert sorted(r.id for r in m.facts.collect()) == [1, 3]
    rows = m.context().orderBy(F.desc("priority"), "place").collect()
    assert [r.content for r in rows] == ["likes tea", "has a dog", "t2", "t3", "t4"] and [r.score for r in rows[2:]] == [0.5, 0.75, 1.0]
    assert [r.id for r in m.delete_facts(facts).relevant("DOG", 5, F.lit("2024-01-01").cast("timestamp")).collect()] == [3]


def modularity_of(adj, label):
    m2, total = len(adj), 0.0
    for c in set(label.values()):
        inside = sum(label[a] == label[b] == c for a, b in adj)
        tot = sum(label[a] == c for a, _ in adj)
        total += inside / m2 - (tot / m2) ** 2
    return total


def test_louvain_finds_planted_communities(spark):
    rnd = random.Random(8)
    edges = {(f"{g}{a}", f"{g}{b}") for g in "pqrs" for a in range(8) for b in range(a) if rnd.random() < 0.8} | {("p0", "q0"), ("q1", "r1"), ("r2", "s2"), ("s3", "p3")}
    adj = graph.adjacency(spark.createDataFrame(sorted(edges), "source string, target string"))
    label = {r.node: r.community for r in indexing.louvain(adj).collect()}
    both = [tuple(r) for r in adj.collect()]
    planted = modularity_of(both, {n: n[0] for n in label})
    assert modularity_of(both, label) >= planted - 0.02
    assert all(c <= n for n, c in label.items()) and all(label[c] == c for c in set(label.values()))
    assert indexing.louvain(adj.limit(0)).count() == 0


def test_communities_queries(spark):
    adj = [tuple(r) for r in graph.adjacency(catalog.edges(spark, SF)).collect()]
    found = {r.node: r.community for r in catalog.queries()["louvain"](spark, SF).collect()}
    assert set(found) == {a for a, _ in adj} and modularity_of(adj, found) > 0.3
    spread = catalog.queries()["label_communities"](spark, SF).collect()
    assert len(spread) == len(found) and len({r.community for r in spread}) < len(found)


def test_span_tree_circles(spark):
    rows = [("t", "a", None, 0, 9), ("t", "b", "a", 1, 3), ("t", "c", "b", 1, 2), ("t", "d", "e", 0, 1), ("t", "e", "d", 0, 1), ("t", "f", "gone", 0, 1)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, s long, e long").select("trace_id", "span_id", "parent_id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    got = {r.span_id: (r.depth, r.own_seconds) for r in observe.span_tree(df).collect()}
    assert got == {"a": (0, 7.0), "b": (1, 1.0), "c": (2, 1.0), "d": (None, 0.0), "e": (None, 0.0), "f": (0, 1.0)}


def test_consolidation_replay_and_extraction(spark):
    cases = spark.createDataFrame([(1, ["Tea"], ["coffee"], 2), (2, ["tea"], [], 1), (3, [], [], None), (4, [], ["tea"], None)], "case long, must_have array<string>, must_not array<string>, most int")
    after = spark.createDataFrame([(1, "likes tea"), (2, "x"), (2, "tea"), (4, "TEA")], "case long, content string")
    got = {r.case: tuple(r)[1:] for r in evaluate.replay_consolidation(cases, after).collect()}
    assert got == {1: (True, 0, 0, True), 2: (False, 0, 0, False), 3: (True, 0, 0, True), 4: (False, 0, 1, True)}
    rel = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 1)], "query long, item string, rating long")
    assert [(r.item, r.mean_rating) for r in evaluate.relevant_by_rating(rel).collect()] == [("a", 2.0)]


def small_graph(spark, folder, customers=600):
    """A folder of tables for the graph's queries, in which every customer is a seed, 4 nations and 2 regions."""
    frame = lambda rows, cols, name: spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    frame([(50 * i, i % 4) for i in range(customers)], "c_custkey long, c_nationkey long", "customer")
    frame([(i, i % 4) for i in range(9)], "s_suppkey long, s_nationkey long", "supplier")
    frame([(i, i % 2) for i in range(4)], "n_nationkey long, n_regionkey long", "nation")
    return str(folder)


@pytest.fixture
def saved_rows(monkeypatch):
    """Rows of each frame that a graph operator checkpoints."""
    rows, save = [], graph.saved

    def counted(df):
        out = save(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "saved", counted)
    return rows


def test_neighbourhoods_of_many_seeds(spark, tmp_path, saved_rows):
    """As bfs() has them, also for seeds without links and on paths; no checkpoint holds the rows that come out, as one did."""
    rnd = random.Random(5)
    pairs = [(f"c{i}", f"n{rnd.randrange(4)}") for i in range(90)] + [(f"n{i}", f"r{i % 2}") for i in range(4)] + [("r1", "x"), ("x", "y"), ("y", "y")]
    adj = graph.saved(graph.adjacency(spark.createDataFrame(pairs, "source string, target string")))
    seeds = spark.createDataFrame([(f"c{i}",) for i in range(0, 90, 3)] + [("n1",), ("x",), ("lonely",)], "seed string")
    key = lambda df: sorted((r.seed, r.node, r.hops) for r in df.collect())
    for depth in (1, 2, 3):
        assert key(graph.neighbourhoods(seeds, adj, depth)) == key(graph.bfs(seeds, adj, depth))
    assert graph.neighbourhoods(seeds.limit(0), adj, 2).count() == 0
    saved_rows.clear()
    got = catalog.queries()["neighbors_2hop"](spark, small_graph(spark, tmp_path)).collect()
    assert len(got) == 600 * (1 + 1 + 149 + 1) + sum(2 + (i % 4 == 0) for i in range(600)) and max(saved_rows) < 1000


def test_paths_to_targets(spark):
    """As bfs() has them for these nodes, also where adj has repeats and a seed is a target or has no links."""
    rnd = random.Random(7)
    edges = spark.createDataFrame([(f"k{rnd.randrange(40)}", f"k{rnd.randrange(40)}") for _ in range(70)] + [("k1", "k2")] * 3, "source string, target string")
    seeds = spark.createDataFrame([(f"k{i}",) for i in range(0, 40, 2)] + [("lonely",)], "seed string")
    targets = spark.createDataFrame([("k3",), ("k4",), ("k10",), ("k10",), ("nowhere",), ("lonely",), (None,)], "node string")
    key = lambda df: sorted((r.seed, r.node, r.hops, r.path) for r in df.collect())
    for depth in (1, 2, 4):
        whole = graph.bfs(seeds, graph.adjacency(edges), depth, paths=True)
        assert key(graph.paths_to(seeds, targets, graph.both_ways(edges), depth)) == key(whole.join(targets.distinct(), "node", "left_semi"))
    assert graph.paths_to(seeds, targets.limit(0), graph.both_ways(edges), 2).count() == 0


@pytest.mark.parametrize("name", ["explain_path", "shortest_path"])
def test_paths_go_to_their_targets_only(spark, tmp_path, saved_rows, name):
    """600 seeds have 1200 nodes on their paths; a checkpoint held the 91,350 of two hops."""
    got = catalog.queries()[name](spark, small_graph(spark, tmp_path)).collect()
    assert len(got) == (1200 if name == "explain_path" else 600) and max(saved_rows) <= 600
    assert {(r.seed, r.node) for r in got} == {(f"c{50 * i}", f"r{i % 2}") for i in range(600)}


def test_documents_are_embedded_once(spark, tmp_path, monkeypatch):
    """However many blocks of queries there are; a document without a text is neither a query nor found."""
    docs = [(i, None if i in (50, 77) else f"w{i} w{i % 7} w{i % 30}", "en", "s") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain, log = retrieval.hashed_words, str(tmp_path / "log")

    def logged(size):
        fn = plain(size)

        def embed(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return fn(texts)

        return embed

    monkeypatch.setattr(retrieval, "hashed_words", logged)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = catalog.queries()["embed_hashed"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in range(0, 400, 50) if q != 50 for n in (1, 2)]
    assert sum(map(int, open(log).read().split())) == 398


def test_knn_near_ties_and_odd_vectors(spark, monkeypatch):
    """Scores that single precision can't tell apart are ranked by double precision; vectors with NaN are not found and hide none."""
    import numpy as np

    rnd = np.random.default_rng(11)
    base = rnd.normal(size=16)
    rows = [(i, (base + rnd.normal(size=16) * 10.0 ** -rnd.integers(1, 7)).tolist()) for i in range(1500)] + [(5000 + i, [math.nan] * 16) for i in range(5)]
    items = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame(rows[:40], "query_id long, embedding array<double>")
    x = np.array([v for _, v in rows[:1500]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 16 * 7)
    for digits in (6, 9):
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.knn(q, items, 4, digits=digits).collect()}
        assert len(got) == 160
        for one in range(40):
            score = np.round(np.clip((x * x[one]).sum(axis=1), -1, 1), digits)
            order = np.lexsort((np.arange(1500), -score))
            assert [got[one, n + 1][1] for n in range(4)] == pytest.approx(score[order[:4]].tolist(), abs=1.1 * 10.0**-digits)
            if digits == 6:
                assert [got[one, n + 1][0] for n in range(4)] == order[:4].tolist()


def test_ndcg_graded_without_all_pairs(spark, tmp_path):
    """By plain Python, with null labels, few items of a grade and negative ids; no join makes the pairs of queries and items, as one did."""
    rnd = random.Random(13)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.choice([0, 0, 0, 1, 2, None])) for i in range(-120, 181)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalog.queries()["ndcg_graded"](spark, str(tmp_path))
    q, e = catalog.vectors(spark, str(tmp_path))
    label = {i: x for i, _, x in rows}
    grade = lambda one, i: 3 if label[i] is not None and label[i] == label[one] else int(math.fmod(i, 3))
    gain = lambda grades: sum((2.0**g - 1) / math.log2(n + 2) for n, g in enumerate(grades))
    ranked = {}
    for r in retrieval.knn(q, e).orderBy("rank").collect():
        ranked.setdefault(r.query_id, []).append(grade(r.query_id, r.id))
    want = {one: gain(g) / gain(sorted((grade(one, i) for i in label), reverse=True)[:10]) for one, g in ranked.items()}
    got = {r.query_id: r.ndcg for r in df.collect()}
    assert set(got) == {-100, -50, 0, 50, 100, 150} and got == pytest.approx(want, abs=1e-6)
    grades = spark.createDataFrame([(one, i, grade(one, i)) for one in want for i in label], "query_id long, id long, grade int")
    assert {r.query_id: r.ndcg for r in evaluate.ndcg_graded(retrieval.knn(q, e), grades, 10).collect()} == pytest.approx(want, abs=1e-9)
    plan, made = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        made = max(made, node.metrics().apply("numOutputRows").value() if "Join" in kind else 0)
        plan += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < made < len(rows)

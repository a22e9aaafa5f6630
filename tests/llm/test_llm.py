"""The operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and repeats."""

import hashlib
import random
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ctxspark.llm import bpe, chat, decontam, langid, licenses, quality, simhash, suffix_dedup, token_counts, urls
from ctxspark.llm.util import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string"


def docs(spark, texts):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts], DOCS)


ODD = [(5, None), (6, ""), (7, "   \n\t "), (None, "a null id has text " * 12), (9, "same " * 60), (9, "same " * 60), (10, "same " * 60), (11, "é中😀" * 200)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixBpe(bpe.load_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)


def texts_with_copies(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randrange(20, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = " ".join(word() for _ in range(rnd.randrange(0, 80)))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(max(1, len(p) - 100))
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + p[a : a + rnd.randrange(60, 200)] + t[at:]
        out.append(t)
    for k in range(20):
        t = out[rnd.randrange(n)]
        at = rnd.randrange(len(t) + 1)
        out.append(t if k % 2 else t[:at] + "X" + t[at + 1 :])
    return out


def dedup_rows(spark, rows):
    got = suffix_dedup.digests(suffix_dedup.dedup(docs(spark, rows))).collect()
    return {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got}, len(got)


@pytest.mark.parametrize(("shard", "many", "pivot", "stretch"), [(3_000_000, 2000, 200_000, 4_000_000), (400, 1, 50, 700), (3000, 3, 2, 900), (400, 100, 200_000, 700)])
def test_suffix_dedup_brute(spark, monkeypatch, shard, many, pivot, stretch):
    for name, value in (("SHARD", shard), ("MANY", many), ("PIVOT_ROWS", pivot), ("STRETCH", stretch)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = dict(enumerate(t.encode() for t in texts_with_copies(1)))
    texts[500] = ("ab" * 300).encode()
    texts[501] = ("na\u00efve caf\u00e9 " * 40).encode()
    got = list(run_local(texts))
    assert {g[0]: g[1:] for g in got} == suffix_dedup.brute_force(texts, 100)


def run_local(texts):
    """The steps of dedup() without Spark, so that limits can be changed."""
    import pyarrow as pa

    tab = lambda rows, names, kinds: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names) if rows else None
    many = [(i, 0, i * 7, t) for i, t in texts.items()]
    first = [tab(many[a : a + 40], ["id", "tk", "doc", "text"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]) for a in range(0, len(many), 40)]
    half = len(first) // 2
    out = [b for part in (first[:half], first[half:]) for b in suffix_dedup._pivot_rows(100)(iter(part))]
    rows = pa.Table.from_batches(out).sort_by("h")
    needs = {}
    for b in suffix_dedup._by_pivot(100)(iter(rows.to_batches(50))):
        for r in b.to_pylist():
            needs.setdefault(r["doc"] // 7, []).append((r["route"], r["need"]))
    cut = [(i, 0, texts[i], [r for r, _ in x], [n for _, n in x]) for i, x in needs.items()]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    found = []
    for dealt in (False, True):
        now = list(suffix_dedup._cut_contexts(100, dealt)(iter([tab(cut, ["id", "tk", "text", "routes", "needs"], kinds)] if cut else [])))
        for _ in range(1 + dealt):  # the second round sorts what is left of dealt routes
            by = [(k, "ascending") for k in ("route", "id", "tk", "start")]
            now = list(suffix_dedup._sort_contexts(100)(iter(pa.Table.from_batches(now).sort_by(by).to_batches(70) if now else [])))
        found += [(r["id"], r["start"], r["stop"]) for b in now for r in b.to_pylist()]
        assert all(r["context"] is None for b in now for r in b.to_pylist())
    for i, t in texts.items():
        gone = bytearray(len(t))
        for j, a, b in found:
            if i == j:
                gone[a:b] = b"\1" * (b - a)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        yield i, sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


def test_suffix_dedup_spark(spark):
    texts = texts_with_copies(2)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + (i or -2000), t) for i, t in ODD[:4]]
    got, n = dedup_rows(spark, rows)
    want = suffix_dedup.brute_force({i: (t or "").encode() for i, t in rows}, 100)
    assert n == len(rows) and got == want


def test_suffix_dedup_odd(spark):
    got, n = dedup_rows(spark, ODD)
    want = suffix_dedup.brute_force({-1: ODD[3][1].encode(), 9: ODD[4][1].encode(), 10: ODD[6][1].encode(), 11: ODD[7][1].encode()}, 100)
    assert n == len(ODD)
    assert got[None] == want[-1] and got[9] == want[9] and got[10] == want[10] and got[11] == want[11] and got[5][0] == 0
    assert suffix_dedup.dedup(docs(spark, ODD[:0] or [(1, None)])).count() == 1
    assert suffix_dedup.dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_suffix_dedup_texts_of_one_id(spark):
    """Texts of one id whose hashes agree in their low 19 bits are different documents all the same."""
    import xxhash

    rnd = random.Random(14)
    said = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, seen = said(150), {}
    while True:
        text = passage + said(130)
        key = xxhash.xxh64_intdigest(text.encode(), 42)
        if key & 0x7FFFF in seen:
            break
        seen[key & 0x7FFFF] = text
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    pair = sorted([text, seen[key & 0x7FFFF]], key=signed)
    for i in (None, 3):
        got = suffix_dedup.digests(suffix_dedup.dedup(docs(spark, [(i, t) for t in pair]))).collect()
        want = suffix_dedup.brute_force({k: t.encode() for k, t in enumerate(pair)}, 100)
        assert sorted((r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want.values()) and want[1][0] >= 150


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(3)
    parts = [bytes(rnd.integers(97, 99, rnd.integers(1, 90)).astype(np.uint8)) for _ in range(40)] + [b"a\0\0b", b"a", b"a\0"]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    rest = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
    sa = suffix_dedup.suffix_array(raw, rest)
    key = lambda p: bytes(raw[p : p + rest[p]])
    assert sa.tolist() == sorted(range(len(raw)), key=lambda p: (key(p), p))
    lcp = suffix_dedup.common_prefixes(raw, rest, sa)
    for i in range(1, len(sa)):
        a, b = key(sa[i - 1]), key(sa[i])
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert ends[-1] == len(raw)


def test_language_id(spark):
    rnd = random.Random(4)
    say = {"xx": ["the", "of", "and", "ing", "tion"], "yy": ["der", "und", "sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(rnd.choices(say[lang], k=2)) for _ in range(30)), lang) for i in range(120) for lang in [rnd.choice(sorted(say))]]
    train = spark.createDataFrame([(t, lang) for i, t, lang in rows[:80]] + [("x " * 20, None)], "text string, lang string")
    pieces = langid.piece_list(RANKS)
    langs, prob = langid.fit(train, pieces, per_language=30)
    assert langs == ["xx", "yy"] and np.allclose(prob.sum(axis=0), 1)
    got = {r.doc_id: r for r in langid.predict(docs(spark, [(i, t) for i, t, _ in rows[80:]] + [(900, None), (901, "12 34"), (None, "der und")]), pieces, langs, prob).collect()}
    assert all(got[80 + k].lang_pred == lang for k, (_, _, lang) in enumerate(rows[80:]))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    pieces = sorted([b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba", b"abababababab"])
    lattice, p = langid.Lattice(pieces), np.random.default_rng(1).random((len(pieces), 2))
    index = {x: i for i, x in enumerate(pieces)}

    def total(s, n, have):
        if s not in have:
            have[s] = 1.0 if not s else sum(p[index[s[:k]], n] * total(s[k:], n, have) for k in range(1, len(s) + 1) if s[:k] in index)
        return have[s]

    words = ["abab", "b", "aabba", "ab" * 20, "abba" * 9]
    want = [[total((" " + w).encode(), n, {}) for n in range(2)] for w in words]
    assert np.allclose(np.exp(lattice.scores(words, p)), want)


def test_forward_long_words():
    """A run of many thousand letters is summed whole: nothing is cut and nothing vanishes."""
    from fractions import Fraction

    pieces = [b" ", b"a", b"aa"]
    p = np.array([[0.5, 0.25], [2.0**-20, 2.0**-30], [2.0**-41, 2.0**-50]])
    n = 3000
    want = []
    for lang in range(2):
        one, two = Fraction(p[1, lang]), Fraction(p[2, lang])
        x, y = Fraction(1), one
        for _ in range(n - 1):
            x, y = y, y * one + x * two
        y *= Fraction(p[0, lang])
        want.append((len(bin(y.numerator)) - len(bin(y.denominator))) * np.log(2))
    got = langid.Lattice(pieces).scores(["a" * n, "a"], p)
    assert np.allclose(got[0], want, atol=2) and np.allclose(got[1], np.log(p[0] * p[1]))
    assert np.isfinite(got).all()


def test_expected_counts_of_pieces():
    """Expected counts over all segmentations, against every segmentation written out."""
    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"ba"])
    p = np.random.default_rng(2).random((len(pieces), 1))
    index = {x: i for i, x in enumerate(pieces)}
    cuts = lambda s: [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) if s[:k] in index for r in cuts(s[k:])]
    want = np.zeros(len(pieces))
    words, weight = ["abab", "ba", "a"], np.array([2.0, 1.0, 3.0])
    for w, c in zip(words, weight, strict=True):
        every = [(x, np.prod([p[index[y], 0] for y in x])) for x in cuts((" " + w).encode())]
        for x, q in every:
            for y in x:
                want[index[y]] += c * q / sum(q for _, q in every)
    assert np.allclose(langid.Lattice(pieces).edges(words).expected(p, weight), want)


def test_simhash(spark):
    import xxhash

    def plain(t):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["Alpha", "beta", "gam", "del", "eps", "zeta"]) for _ in range(200)) for _ in range(12)]
    rows = list(enumerate(base + [b.replace("zeta", "eta", 1) for b in base] + base[:3])) + [(100 + i, t) for i, (_, t) in enumerate(ODD)] + [(None, base[0])]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fp = {i: plain(t) for i, t in rows}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fp
    ids = [i for i in fp if i is not None]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i].component_id for i in ids} == root and got[None].component_id == root[0]
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_bk_forest_finds_all_links():
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(0b11111)]))
    group = np.sort(rnd.integers(0, 3, len(fps)))
    label = simhash.BkForest(fps, group).links(3, block=7)
    want = np.arange(len(fps))
    for _ in range(6):
        for a in range(len(fps)):
            for b in range(len(fps)):
                if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= 3:
                    want[a] = want[b] = min(want[a], want[b])
    assert np.array_equal(label, want)


@pytest.mark.parametrize(("radius", "crowd"), [(3, 8000), (3, 5), (1, 5), (5, 3)])
def test_shards_meet(spark, radius, crowd):
    """Any two fingerprints within the radius meet in a shard, also where crowded shards are split again."""
    rnd = random.Random(22)
    base = [rnd.getrandbits(64) for _ in range(8)]
    fps = {0, 2**64 - 1} | {(x & ~0xFFFF) | (base[0] & 0xFFFF) for x in base}  # many agree in the lowest block
    for x in base * 6:
        for k in rnd.sample(range(64), rnd.randrange(radius + 1)):
            x ^= 1 << k
        fps.add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = {}
    for r in simhash.shards(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), radius, crowd).collect():
        got.setdefault(r.fp & (2**64 - 1), set()).add(r.shard)
    assert set(got) == fps
    assert all(got[a] & got[b] for a in fps for b in fps if (a ^ b).bit_count() <= radius)


def test_components(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == root


def test_bpe(spark, encoder):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aàé ñ  \n\t\x1c\x85\u3000ßthe'sre12³中文😀.,#") for _ in range(rnd.randrange(80))) for _ in range(400)] + ["ab" * 3000]
    assert all(list(chain.from_iterable(encoder.encode(t))) == want.encode_ordinary(t) for t in texts)
    got = bpe.decode(bpe.encode(docs(spark, ODD), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.encode(docs(spark, ODD), RANKS, public_tokenizers.PATTERN, decoded=True).collect()))
    assert sorted((str(r.doc_id), bytes(r.bytes).decode(), r.ids) for r in got) == sorted((str(i), t or "", want.encode_ordinary(t or "")) for i, t in ODD)


def test_empty_tables_and_long_texts(spark):
    """Operators over rows: no rows in, none out; a text of a megabyte and repeated rows come out whole."""
    long = "word and more " * 80_000
    rows = [(1, long), (2, "twice the same"), (2, "twice the same"), (None, None)]
    df = docs(spark, rows)
    edited = df.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))
    pieces = langid.piece_list(RANKS)
    langs, prob = langid.fit(spark.createDataFrame([("word and more", "en"), ("twice le m\u00eame", "fr")], "text string, lang string"), pieces)
    ops = {
        "encode": (lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN), df),
        "count": (lambda d: token_counts.count_edited(d, RANKS, public_tokenizers.PATTERN), edited),
        "scan": (licenses.scan, df),
        "judge": (lambda d: quality.judge(d, quality.PRIOR), df),
        "predict": (lambda d: langid.predict(d, pieces, langs, prob), df),
        "dedup": (suffix_dedup.dedup, df),
        "near": (simhash.near_duplicates, df),
        "representatives": (simhash.representatives, df),
    }
    for name, (op, frame) in ops.items():
        got = op(frame).collect()
        assert len(got) == (len(rows) if name != "representatives" else 3), name
        assert op(frame.limit(0)).count() == 0, name
    assert [r.lang_pred for r in langid.predict(df, pieces, [], np.zeros((len(pieces), 0))).collect()] == ["und"] * 4


def test_prefix_table(encoder):
    rnd = random.Random(9)
    for _ in range(200):
        w = bytes(rnd.choice(b"thenrea ") for _ in range(rnd.randrange(300)))
        table = bpe.PrefixTable(encoder, w)
        i = rnd.randrange(len(w) + 1)
        j, new = min(len(w), i + rnd.randrange(5)), bytes(rnd.choice(b"thenrea ") for _ in range(rnd.randrange(5)))
        table.edit(i, j, new)
        table.append(b"ing")
        assert table.piece == w[:i] + new + w[j:] + b"ing" and table.last == encoder.last_tokens(table.piece)


URLS = [("http://a.Example.com/en/7x?q", "example.com/en/7", "allow"), ("http://example.com/en/", "com/en/", "block"), ("x://xexample.com/en/7", "com/en/", "block"), ("http://m.example.net/de/8#", "example.net/de/8", "block"), ("http://net/de/9", "net/de/", "allow"), ("http://a.org/es", None, "allow"), ("http://org/es/", "org/es/", "block"), ("nothing", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://com.:80/en/", None, "allow"), ("http://.com/en/\n", "com/en/", "block")]


@pytest.mark.parametrize("samples", [25, 1])
def test_urls(spark, monkeypatch, samples):
    from ctxspark.llm.queries import URL_RULES

    monkeypatch.setattr(urls, "SAMPLES", samples)
    pages = spark.createDataFrame([(i, u, "") for i, (u, _, _) in enumerate(URLS * 2)] + [(None, URLS[0][0], "")], "page_id long, url string, rule string")
    rules = urls.rules_frame(spark, URL_RULES)
    got = urls.apply_rules(pages, rules).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.rule, r.verdict) for r in got) == sorted([(i, *x[1:]) for i, x in enumerate(URLS * 2)] + [(-1, *URLS[0][1:])])
    assert urls.apply_rules(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.apply_rules(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_urls_brute(spark):
    """Nested rules across hosts and paths, one hot host, one hot url, and very long urls, against every rule tried."""
    rnd = random.Random(21)
    label = lambda: rnd.choice(["a", "b", "ab", "x-y", "www", "", "a0"])
    host = lambda n: ".".join([*(label() for _ in range(n)), rnd.choice(["com", "net"])])
    path = lambda n: "".join(rnd.choice(["/a", "/b", "/ab", "x"]) for _ in range(n))
    rules = list({(host(rnd.randrange(3)), path(rnd.randrange(3))): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    found = ["http://" + host(rnd.randrange(5)) + path(rnd.randrange(5)) + rnd.choice(["", "?q/a", "#/b"]) for _ in range(300)]
    found += ["http://hot.a.com/a" + path(2) for _ in range(400)] + ["http://b.com/a/b"] * 400 + ["http://a.com/" + "x" * 100_000, "http://" + "a." * 2000 + "com/a"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(found)], "page_id long, url string")
    got = urls.apply_rules(frame, urls.rules_frame(spark, [(h, p, v) for (h, p), v in rules])).collect()
    assert len(got) == len(found)
    for r in got:
        h, p = re.match(r"http://([^/?#]*)([^?#]*)", found[r.page_id]).groups()
        fits = [(len(a + b), len(a), v == "allow", a + b, v) for (a, b), v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, *want), (found[r.page_id], want)


def test_licenses(spark):
    rows = [(1, "words\nReleased under the MIT license\nmore words"), (2, "Released under the MIT-ish Licence of nobody"), (3, None), (4, ""), (5, "\n".join(licenses.TEMPLATES[4][1].split("; ")) + "\n\nx"), (None, licenses.TEMPLATES[5][1].upper())]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i].license for i in (1, 2, 3, 4, 5, None)] == ["MIT", None, None, None, "Apache-2.0", "GPL-3.0"]
    assert got[1].spans[0]["first"] == 1 and got[1].score == 1.0
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(10)
    pool = " ".join(t for _, t in licenses.TEMPLATES).split()
    for _ in range(300):
        a = rnd.randrange(len(pool))
        unit = " ".join(w for w in pool[a : a + rnd.randrange(2, 40)] if rnd.random() < 0.97)
        scores = [(-licenses.dice(licenses.bigrams(unit), licenses.bigrams(t)), n) for n, t in licenses.TEMPLATES]
        want = (min(scores)[1], -min(scores)[0]) if -min(scores)[0] >= 0.8 else None
        assert scanner.best(unit) == want


def test_licenses_inside_lines_and_runs(spark):
    long = licenses.TEMPLATES[6][1]
    other = "plain words of a text that goes on and on without any notice at all "
    wrapped = "\n".join([other, *re.findall(r".{1,50}(?:\s|$)", long), other, other])
    rows = [(1, "a b\nLicensed under CC BY-NC 4.0.\nc d"), (2, other * 3 + "Released under the MIT License. " + other * 3), (3, wrapped), (4, other * 9), (5, other + "Licensed under the ISC License. " + other + "Licensed under CC BY-NC-SA 4.0. " + other), (6, "Licensed under the GNU things of the Lesser world"), (7, long.replace("GNU", "GNU Affero"))]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [(got[i].license, got[i].score, got[i].n_matches) for i in range(1, 8)] == [("CC-BY-NC-4.0", 1, 1), ("MIT", 1, 1), ("GPL-3.0", 1, 1), (None, None, 0), ("CC-BY-NC-SA-4.0", 1, 2), (None, None, 0), ("AGPL-3.0", 1, 1)]
    assert (got[3].spans[0]["first"], got[3].spans[0]["last"]) == (1, len(wrapped.split("\n")) - 3)


def test_licenses_recall(spark):
    """Notices and whole licences with noise, reflowed, quoted and in the middle of prose: at least 0.9 are found."""
    rnd = random.Random(24)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES * 3):
        words = text.split()
        for _ in range(len(words) // 25):
            words[rnd.randrange(len(words))] = rnd.choice(["X", "Corp", "2019"])
        wide = rnd.choice([30, 60, 10_000])
        form = rnd.choice(["\n", "\n\n", "\n# ", " "]) if len(words) > 60 else rnd.choice([" ", " *"])
        lines = re.findall(rf".{{1,{wide}}}(?:\s|$)", " ".join(words))
        rows.append((k, prose(rnd.randrange(40)) + rnd.choice(["\n", " ", ". "]) + form.join(x.strip() for x in lines) + rnd.choice(["\n", " "]) + prose(rnd.randrange(1, 40))))
        want[k] = name
    rows += [(1000 + k, prose(300)) for k in range(50)] + [(2000, prose(60_000) + " Released under the MIT License. " + prose(10))]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    same = sum(got[k].license == name for k, name in want.items())
    assert same >= 0.9 * len(want), [(want[k], got[k].license) for k in want if got[k].license != want[k]]
    assert all(got[1000 + k].license is None for k in range(50)) and got[2000].license == "MIT"
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_licenses_whole_query(spark):
    """scan() against a scan of every window and unit without bounds, inverted lists or shortcuts."""
    rnd = random.Random(25)
    short = [t for t in licenses.TEMPLATES if len(t[1].split()) < 14]
    grams = [(n, licenses.bigrams(t)) for n, t in short]
    rows = []
    for k in range(60):
        parts = [rnd.choice(short)[1] if rnd.random() < 0.4 else " ".join(rnd.choice(["under", "the", "license", "version", "x", "y", "gnu"]) for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 5))]
        rows.append((k, "".join(p + rnd.choice([" ", "\n", "\n\n", "/"]) for p in parts)))
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows), short).collect()}
    for k, t in rows:
        best = 0.0
        for run in re.split(r"\n\s*\n", t):
            for unit in [run, *run.split("\n")]:
                words = licenses.WORD.findall(unit.lower())
                spans = [words] + [words[a : a + sum(g.values()) + 1] for _, g in grams for a in range(len(words))]
                best = max(best, *(licenses.dice(licenses.Counter(zip(w, w[1:], strict=False)), g) for w in spans for _, g in grams if len(w) == len(words) or len(w) == sum(g.values()) + 1))
        assert (got[k].score or 0) == pytest.approx(best if best >= 0.8 else 0), t


def plain_counts(t):
    words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rnd = random.Random(11)
    rows = [(i, "\n".join(" ".join(rnd.choice(["a", "bé", "#c", "d\x0b", "é\u00a0f"]) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(12)))) for i in range(60)] + [(100 + k, t) for k, (_, t) in enumerate(ODD)]
    good, bad = "It was a plain sentence of some words that end well.", "BUY!!! ***NOW*** $$$ ### %%%"
    weights = quality.fit_crf([f"{good}\n{good}x"] * 10 + [f"{bad}\n{bad}1"] * 10, [1] * 10 + [0] * 10)
    long = [(200, "\n".join(f"{good} {k}" for k in "abcdefgh")), (201, "\n".join(f"{bad} {k} {k}{k}" for k in "abcdefgh"))]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows + long), weights).collect()}
    for i, t in rows:
        r, want = got[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert got[200].content_share == 1 and got[201].content_share == 0
    assert quality.fit_crf([], []) is quality.PRIOR


def test_quality_learns_lines(spark):
    """Labels are those of documents; lines of mixed documents still get labels of their own, and the chain sees them."""
    rnd = random.Random(31)
    good = lambda: " ".join(rnd.choice("bdfgklmn") + rnd.choice(["river", "stone", "walks", "over", "old", "bridge"]) for _ in range(12)) + "."
    bad = lambda: " | ".join(rnd.choice("bdfgklmn") + rnd.choice(["home", "login", "share", "cart", "menu", "terms"]) for _ in range(10))
    mixed = lambda a, m, b, n: "\n".join(rnd.sample([*(a() for _ in range(m)), *(b() for _ in range(n))], m + n))
    texts = [mixed(good, 5, bad, k % 3) for k in range(40)] + [mixed(bad, 5, good, k % 3) for k in range(40)]
    labels = [1] * 40 + [0] * 40
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (None, good())], "doc_id long, text string")
    marks = [(i, q) for i, q in enumerate(labels)] + [(500, 1), (None, 0), (999, 1)]
    model = quality.train(frame, spark.createDataFrame(marks, "doc_id long, quality int"))
    _, label, share = quality.content_lines(["\n".join([good(), bad(), bad(), good(), good()]), good(), bad()], model)
    assert label.tolist() == [1, 0, 0, 1, 1, 1, 0] and 0.4 < share[0] < 0.8 and share[1:].tolist() == [1, 0]
    held_out = ["\n".join([*(good() for _ in range(3)), bad()]) for _ in range(30)] + ["\n".join([good(), *(bad() for _ in range(3))]) for _ in range(30)]
    got = {r.doc_id: r.kept for r in quality.judge(docs(spark, list(enumerate(held_out))), model).collect()}
    assert [got[i] for i in range(60)] == [True] * 30 + [False] * 30
    assert quality.train(frame, spark.createDataFrame([(0, 1)], "doc_id long, quality int")) is quality.PRIOR
    assert quality.train(frame.limit(0), spark.createDataFrame(marks, "doc_id long, quality int")) is quality.PRIOR
    assert quality.judge(frame.limit(0), model).count() == 0


def test_quality_held_out():
    """Accuracy on labelled documents that the model was not fitted on, against the hand-set weights."""
    import pandas as pd

    rows = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id").sort_values("doc_id")
    texts, q = [t or "" for t in rows.text], rows.quality.to_numpy()
    right = {"trained": 0, "hand-set": 0}
    for part in (0, 1):
        fit, ask = [i for i in range(len(q)) if i % 2 == part], [i for i in range(len(q)) if i % 2 != part]
        for name, model in (("trained", quality.fit_crf([texts[i] for i in fit], [int(q[i]) for i in fit])), ("hand-set", quality.PRIOR)):
            lines, _, share = quality.content_lines([texts[i] for i in ask], model)
            kept = ~quality.base_failed(lines.words, quality.repeat_words(lines.codes, lines.words)) & (share >= 0.5)
            right[name] += (kept == q[ask]).sum()
    assert right["trained"] >= max(0.965 * len(q), right["hand-set"] - 2)


def test_marginals_brute():
    from itertools import product

    rnd = np.random.default_rng(13)
    sizes = np.array([3, 1, 4])
    emit, move = rnd.normal(size=(sizes.sum(), 2)), rnd.normal(size=(2, 2))
    y, weight = rnd.integers(0, 2, sizes.sum()), rnd.random(sizes.sum())
    got, gradient = quality.marginals(emit, move, quality.grid(sizes), y, weight)
    at, want = 0, np.zeros((2, 2))
    for n in sizes:
        every = list(product((0, 1), repeat=int(n)))
        e = np.exp([sum(emit[at + k, x[k]] for k in range(n)) + sum(move[x[k], x[k + 1]] for k in range(n - 1)) for x in every])
        e /= e.sum()
        for k in range(n):
            assert np.isclose(got[at + k, 1], sum(p for p, x in zip(e, every, strict=True) if x[k]))
            if k + 1 < n:
                for p, x in zip(e, every, strict=True):
                    want[x[k], x[k + 1]] -= p * weight[at + k + 1]
                want[y[at + k], y[at + k + 1]] += weight[at + k + 1]
        at += n
    assert np.allclose(gradient, want)


def test_viterbi_brute():
    from itertools import product

    rnd = np.random.default_rng(12)
    sizes = np.array([3, 1, 5, 2])
    emit, trans = rnd.normal(size=(sizes.sum(), 2)), rnd.normal(size=(2, 2))
    got, at = quality.viterbi(emit, trans, sizes), 0
    for n in sizes:
        score = lambda y: sum(emit[at + k, y[k]] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
        assert tuple(got[at : at + n]) == max(product((0, 1), repeat=int(n)), key=score)
        at += n


def test_decontamination(spark):
    rnd = random.Random(13)
    w = lambda n: [rnd.choice("one two three four five six é7".split()) for _ in range(n)]
    items = [(i, " ".join(w(n))) for i, n in enumerate([30, 10, 4, 1, 12])] + [(7, None), (8, ""), (None, "x y")]
    items[3] = (3, "Unique")
    rows = []
    for i in range(80):
        t = w(rnd.randrange(40))
        src = (items[rnd.randrange(5)][1] or "").split()
        at = rnd.randrange(len(t) + 1)
        rows.append((i, "; ".join(t[:at] + src[: rnd.randrange(len(src) + 1)] + t[at:]).upper()))
    rows += [(100 + k, t) for k, (_, t) in enumerate(ODD)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in rows:
        words, hit, found = lower(t), set(), set()
        for j, b in items:
            if j is None:
                continue
            q = lower(b)
            for k in range(max(1, len(q) - 9) if q else 0):
                g = q[k : k + 10]
                for p in range(len(words) - len(g) + 1):
                    if words[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add(j)
        want[i] = (len(words), sorted(hit), sorted(found))
    for size in (8_000_000, 40):
        got = {r.doc_id: (r.n_words, r.hits, r.items) for r in decontam.contamination(docs(spark, rows), bench, block_bytes=size).collect()}
        assert got == want
    assert all(not r.items for r in decontam.contamination(docs(spark, rows), bench.limit(0)).collect())
    near = {r.doc_id: r.near_items for r in decontam.contamination(docs(spark, [(1, "b x a c"), (2, "a y y y y y y b c")]), spark.createDataFrame([(1, "a b c")], "item_id long, text string"), slack=2).collect()}
    assert near == {1: [1], 2: []}


def test_decontamination_rows_of_blocks(spark):
    """Rows without an id, of one id and repeated ones come out one by one, however many blocks the benchmark has."""
    rows = [(None, "a b c d"), (None, "x y z"), (3, "a b"), (3, "e f g h"), (3, "e f g h"), (4, None), (4, "")]
    bench = spark.createDataFrame([(1, "a b"), (2, "f g"), (5, "y")], "item_id long, text string")
    shape = lambda size: sorted(((r.doc_id, r.n_words, r.hits, r.items) for r in decontam.contamination(docs(spark, rows), bench, block_bytes=size).collect()), key=str)
    assert shape(1) == shape(8_000_000) and len(shape(1)) == len(rows)


def test_index_holds_every_token(spark):
    """The stored index gives back each document's words, whatever is looked for in it later."""
    rows = [(1, "One two one, THREE"), (2, None), (3, "two \u00e9\u00e9 two"), (None, "z " * 5000)]
    got = {}
    for r in decontam.build_index(docs(spark, rows), shard_bytes=40).collect():
        words = [None] * r.doc_starts[-1]
        for k, t in enumerate(r.terms):
            for x in r.positions[r.offsets[k] : r.offsets[k + 1]]:
                words[x] = bytes(t).decode()
        got |= {i: words[a:b] for i, a, b in zip(r.doc_ids, r.doc_starts, r.doc_starts[1:], strict=False)}
    assert got == {1: ["one", "two", "one", "three"], 2: [], 3: ["two", "\u00e9\u00e9", "two"], None: ["z"] * 5000}
    assert decontam.contamination(docs(spark, rows).limit(0), docs(spark, rows), item_col="doc_id").count() == 0


def test_decontamination_near(spark):
    from itertools import combinations

    rnd = random.Random(16)
    w = lambda n: [rnd.choice("abcdefgh") for _ in range(n)]
    items = [(1, "a b c"), (2, "p q r s t u v w x y one two three"), (3, "m m n")] + [(k, " ".join(w(4))) for k in range(4, 12)]
    rows = [(1, "z b z z a z c b"), (2, "three z two one y x w v u t s"), (3, "m n z z z z z z z m"), (4, "m n m"), (5, "one two three")] + [(k, " ".join(w(rnd.randrange(25)))) for k in range(6, 60)]

    def spans(words, text, slack):
        return any(sorted(text[i] for i in c) == sorted(words) for a in range(len(text)) for c in combinations(range(a, min(len(text), a + len(words) + slack)), len(words)) if c[0] == a)

    got = {r.doc_id: r.near_items for r in decontam.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), slack=2).collect()}
    assert got[2] == [2] and 3 not in got[3] and 3 in got[4] and got[5] == [] and 1 in got[1]
    small = [(i, q.split()) for i, q in items if len(q.split()) < 10]
    for k, t in rows:
        assert [i for i in got[k] if i != 2] == sorted(i for i, q in small if spans(q, t.split(), 2)), k


def test_token_counts(spark, encoder):
    rnd = random.Random(14)
    some = lambda n: "".join(rnd.choice(["the", " ", "  ", "\n", "é", "re", "'s", "'", "12", "!", " a", "s"]) for _ in range(n))
    for leaf in (1, 32):
        token_counts.LEAF = leaf
        for _ in range(200):
            t = some(rnd.randrange(120))
            tree = token_counts.CountTree(encoder, t)
            for _ in range(4):
                i = rnd.randrange(-1, len(t) + 3)
                j, new = i + rnd.randrange(6), some(rnd.randrange(4))
                tree.edit(i, j, new)
                a = max(0, min(i, len(t)))
                t = t[:a] + new + t[max(a, min(j, len(t))) :]
                assert tree.text() == t and tree.count == sum(map(len, encoder.encode(t)))
    df = docs(spark, ODD).withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(7).alias("end"), F.lit("new é").alias("text"))))
    for r in token_counts.count_edited(df, RANKS, public_tokenizers.PATTERN).collect():
        t = dict(ODD)[r.doc_id] or ""
        assert r.n_tokens == sum(map(len, encoder.encode(t))) and r.n_tokens_after == sum(map(len, encoder.encode(t[:3] + "new é" + t[7:])))
    big = token_counts.CountTree(encoder, "some words and more " * 5000)
    before = big.encoded
    big.edit(50_000, 50_003, "xyz")
    assert big.encoded - before < 40


def test_stored_trees(spark, encoder, tmp_path):
    """Trees that are written, read and edited twice: counts equal those of the whole text, untouched parts aren't encoded."""
    rows = [*ODD, (77, "some words and more " * 3000)]
    token_counts.trees(docs(spark, rows), RANKS, public_tokenizers.PATTERN).write.parquet(f"{tmp_path}/0")
    want = [(i, t or "") for i, t in rows]
    for n, (a, b, new) in enumerate([(30, 33, "xyz"), (2, 2, " é new")]):
        edit = F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("text")))
        token_counts.edit_trees(spark.read.parquet(f"{tmp_path}/{n}").withColumn("edits", edit), RANKS, public_tokenizers.PATTERN).write.parquet(f"{tmp_path}/{n + 1}")
        want = [(i, t[:a] + new + t[min(len(t), b) :]) for i, t in want]
        got = spark.read.parquet(f"{tmp_path}/{n + 1}").collect()
        assert sorted((str(r.doc_id), r.text, r.n_tokens) for r in got) == sorted((str(i), t, sum(map(len, encoder.encode(t)))) for i, t in want)
        assert all(r.n_encoded < 60 for r in got) and all("".join(r.text) == r.text and sum(r.sizes) == len(r.text) for r in got)
    assert token_counts.trees(docs(spark, rows).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "a\\<|b"), (1, 1, "assistant", "c\\n<"), (2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", ""), (-1, 0, "user", said), (-1, 1, "assistant", said), (3, 5, "system\nx", "é" * 5000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, parts int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.text_parts(df))).collect()}
    for conv in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == conv]
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|>"}, {"type": "image", "ref": "i1", "amount": 1.0}, {"type": "audio", "ref": "a1", "amount": 3.0}, {"type": "document", "ref": None, "amount": 2.0}]
    text, a, b, attached = chat.format_turn("assistant", parts)
    assert [(x["kind"], x["ref"], x["tokens"]) for x in attached] == [("image", "i1", 765), ("audio", "a1", 75), ("document", None, 1200)]
    assert all(text[x["at"] :].startswith(f"<|{x['kind']}:{k + 1}|>") for k, x in enumerate(attached))
    typed = [{"type": "text", "text": "no <|image:1|> here"}, {"type": "image", "ref": "x", "amount": 1.0}, {"type": "text", "text": "<|audio:2|>\\"}]
    assert chat.read_parts(chat.format_turn("user", typed)[0]) == [("user", [("text", "no <|image:1|> here"), ("image", "1"), ("text", "<|audio:2|>\\")])]
    assert chat.digests(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0
    assert text.count("<|im_end|>") == 1 and chat.unescape(text[a:b]).startswith("see <|im_end|><|image:1|>")


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, src)
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet(f"{src}/documents.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding"]


def test_pipeline_stages_odd_rows(spark, tmp_path):
    """Rows without an id, repeated ids and repeated rows: none is lost, multiplied or judged by another's text."""
    import corpus_pipeline

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = max((r.text for r in bench.collect()), key=len)
    rnd = random.Random(9)
    said = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d = said(60), said(60), said(60), said(60)
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, c), (9, None), (10, ""), (None, leak), (7, leak + " x y")]
    shape = lambda df: sorted(((r.doc_id, r.text) for r in df.select(corpus_pipeline.COLUMNS).collect()), key=str)
    kept = shape(corpus_pipeline.near_dedup(spark, docs(spark, rows), str(tmp_path)))
    assert [r for r in kept if r[1] not in (leak, leak + " x y")] == sorted([(None, a), (None, b), (7, c), (7, d), (9, None)], key=str)
    kept = shape(corpus_pipeline.decontaminate(spark, docs(spark, rows), str(tmp_path)))
    assert kept == sorted([r for r in rows if leak not in (r[1] or "")], key=str)
    tail = d + c[:200]
    kept = shape(corpus_pipeline.substring_dedup(spark, docs(spark, [(None, a), (None, b), (7, c), (7, d), (8, tail), (9, None), (10, ""), (11, a)]), str(tmp_path)))
    assert [r for r in kept if r[0] != 8] == sorted([(None, a), (None, b), (7, c), (7, d), (9, None), (10, "")], key=str)
    assert all(r[1] == "" or len(r[1]) < 100 for r in kept if r[0] == 8)


def test_pipeline_near_copies(spark, tmp_path):
    """Texts that share 0.8 of their 5-word shingles are near copies, also where SimHash is 4 to 10 bits away."""
    import corpus_pipeline

    rnd = random.Random(15)
    said = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want, close = [], [], 0
    for k in range(60):
        base = said(150)
        other = list(base)
        for _ in range(1 + k % 8):
            other[rnd.randrange(150)] = "changed"
        a, b = grams(base), grams(other)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want += [2 * k] if len(a & b) >= 0.8 * len(a | b) else [2 * k, 2 * k + 1]
        close += len(a & b) >= 0.8 * len(a | b)
    assert 15 < close < 45
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), str(tmp_path)).collect()) == want
    many = [" ".join(said(3) + [f"w{j}" for j in range(150)]) for _ in range(50)]
    kept = corpus_pipeline.near_dedup(spark, docs(spark, list(enumerate(many))), str(tmp_path)).collect()
    assert [r.doc_id for r in kept] == [0]


def test_near_copies_left_apart(spark, monkeypatch):
    """A large group of texts that share a band but are no near copies: the few that are get linked all the same."""
    rnd = random.Random(23)
    said = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shared = said(300)
    texts = [shared + said(110) for _ in range(60)]  # about 0.57 of each other
    texts += [[*t[:400], *said(10)] for t in texts[20:40]]  # near copies of twenty of them
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    grams = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in range(4):
        for a in range(len(texts)):
            for b in range(a):
                if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for chunk in (4000, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        kept = sorted(r.doc_id for r in simhash.representatives(docs(spark, rows)).collect())
        assert kept == sorted(set(root)) and len(kept) == 60
    low = [simhash.least_hashes(t.encode()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sum(low[a] == low[b]) >= 96]
    assert pairs and all(root[a] == root[b] for a, b in pairs)


def test_near_copies_by_simhash(spark, monkeypatch):
    """Fingerprints find near copies without any band of minimal hashes; what they link is checked by its shingles."""
    rnd = random.Random(15)
    said = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want, linked, apart = [], [], 0, 0
    for k in range(60):
        base = said(150)
        other = list(base)
        for _ in range(1 + k % 8):
            other[rnd.randrange(150)] = "changed"
        a, b, x, y = grams(base), grams(other), " ".join(base), " ".join(other)
        near = bin(simhash.fingerprint(x.encode()) ^ simhash.fingerprint(y.encode())).count("1") <= 3
        copy = len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * k, x), (2 * k + 1, y)]
        want += [2 * k] if near and copy else [2 * k, 2 * k + 1]
        linked, apart = linked + (near and copy), apart + (near and not copy)
    assert linked > 5 and apart
    count = simhash.BANDS
    monkeypatch.setattr(simhash, "bands", lambda low: low.reshape(count, -1)[:, 0] * 0 + low.sum() + np.arange(count, dtype=np.uint64))
    assert sorted(r.doc_id for r in simhash.representatives(docs(spark, rows)).collect()) == want


def test_language_sample_of_copies(spark):
    """A language of many copies of few texts is learned, and one that has short texts only."""
    pieces = langid.piece_list(RANKS)
    few = [k for k in range(4000) if hash_of(f"el perro corre por la calle {k}") % 2**30 > 2**29][:2]
    rows = [(f"el perro corre por la calle {few[k % 2]}", "es") for k in range(6000)] + [("the dog runs along the street", "en"), ("der Hund", "de"), (None, "fr")]
    langs, _ = langid.fit(spark.createDataFrame(rows, "text string, lang string"), pieces)
    assert {"es", "en", "de"} <= set(langs)


def hash_of(text):
    import xxhash

    return (xxhash.xxh64_intdigest(text.encode(), 42) + 2**63) % 2**64 - 2**63


def test_language_letters():
    assert langid.words_of("x\u00b2 \u00bd \u2167 Abc 12_d") == ["x", "abc", "d"]

"""SimHash near-duplicates: fingerprints, links by BK-trees, and the components of the links.

A link differs in at most 3 of 64 bits, so one of four 16-bit blocks agrees; fingerprints are sharded by block and
value, and each shard is a BK-tree whose children are keyed by integer Hamming distance to the parent. The trees
grow with the corpus, so a shard's tree goes to the tasks of that shard alone instead of to every executor. A shard of
more than CROWD fingerprints is split again by the blocks of what is left of the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import LOWER, components, forest, let_go, map_batches, record, saved, texts_of

RADIUS, BLOCKS, SHINGLE, SEED = 3, 4, 3, 42
#: Fingerprints in one tree; a larger shard is split by a second block.
CROWD = 8000


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text's UTF-8 bytes."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def text_key(text_col: str = "text") -> Column:
    """A number that tells apart the texts of rows that share an id."""
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, fp long): every whole text's fingerprint; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield record(id=batch.column("id"), text_key=batch.column("text_key"), fp=fps)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "id long, text_key long, fp long").withColumnRenamed("id", id_col)


class BkForest:
    """One BK-tree for each group of distinct fingerprints, built level by level and searched in batches."""

    #: Pairs of query and node that are looked at together.
    FRONT = 400_000

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """group: ascending ids; the first fingerprint of a group is its tree's root."""
        n = len(fps)
        self.fps, self.group = fps, group
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        links, keys = [], []
        rest = np.flatnonzero(~first)
        above = self.root[rest]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[above]).astype(np.int64)
            key = above * 65 + d
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.r_[True, key[1:] != key[:-1]]
            links.append(rest[head])
            keys.append(key[head])
            above = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))][~head]
            rest = rest[~head]
        self.child = np.concatenate(links) if links else np.zeros(0, np.int64)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.child, self.key = self.child[order], self.key[order]

    def links(self, radius: int, block: int = 8192) -> np.ndarray:
        """For each fingerprint, the first one of its group that links within `radius` reach (itself if none)."""
        n = len(self.fps)
        label = np.arange(n)
        for at in range(0, n, block):
            q = np.arange(at, min(n, at + block))
            waiting = [(q, self.root[q])]
            while waiting:
                q, node = waiting.pop()
                if len(q) > self.FRONT:
                    waiting.append((q[self.FRONT :], node[self.FRONT :]))
                    q, node = q[: self.FRONT], node[: self.FRONT]
                d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
                near = (d <= radius) & (node < q)
                if near.any():
                    label = forest(label[q[near]], label[node[near]], n)[label]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
                size = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
                if size.any():
                    node = self.child[np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                    waiting.append((np.repeat(q, size), node))
        return label


def shards(fps: DataFrame, radius: int = RADIUS, crowd: int | None = None) -> DataFrame:
    """(shard, fp): fps(fp) dealt so that any two within `radius` meet in a shard.

    Two such fingerprints agree in one of radius + 1 blocks. Where more than `crowd` agree in a block, what is left of
    them is cut into radius + 1 blocks once more, of which one agrees as well; a shard is then a pair of blocks.
    """
    parts = radius + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    cut = lambda x, a, b: F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < 64 else x
    banded = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), cut(F.col("fp"), edges[k], edges[k + 1]).alias("v")) for k in range(parts)))).alias("s")).select("s.k", "s.v", "fp")
    crowded = banded.groupBy("k", "v").count().where(F.col("count") > (CROWD if crowd is None else crowd)).select("k", "v", F.lit(True).alias("crowded"))

    def again(k: int) -> Column:
        """The second blocks of a fingerprint that is sharded by block k: cuts of the bits that k leaves."""
        rest = [(a, b) for a, b in ((0, edges[k]), (edges[k + 1], 64)) if a < b]
        bits = sum(b - a for a, b in rest)
        low = cut(F.col("fp"), *rest[0])
        left = low if len(rest) == 1 else low.bitwiseOR(F.shiftleft(cut(F.col("fp"), *rest[1]), rest[0][1] - rest[0][0]))
        at = [bits * j // parts for j in range(parts + 1)]
        return F.array(*(F.struct(F.lit(j).alias("j"), cut(left, at[j], at[j + 1]).alias("w")) for j in range(parts)))

    one = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w")))
    second = one
    if parts > 1:
        second = F.when(F.col("crowded").isNull(), one)
        for k in range(parts):
            second = second.when(F.col("k") == k, again(k))
    known = banded.join(crowded, ["k", "v"], "left")
    return known.withColumn("s", F.explode(second)).select(F.xxhash64("k", "v", "s.j", "s.w").alias("shard"), "fp")


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of fps(fp): enough of them that all within `radius` are connected."""
    banded = shards(fps, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, rows, size = [], [], 0

        def search(group: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            label = BkForest(x.view(np.uint64), group).links(radius)
            linked = label != np.arange(len(x))
            return record(a=x[linked], b=x[label[linked]])

        for batch in batches:
            owners.append(batch.column("shard").to_numpy())
            rows.append(batch.column("fp").to_numpy())
            size += len(rows[-1])
            if size >= 50_000 and owners[-1][-1] != owners[0][0]:  # search what is complete, keep the last shard
                group, x = np.concatenate(owners), np.concatenate(rows)
                cut = int(np.searchsorted(group, group[-1]))
                yield search(group[:cut], x[:cut])
                owners, rows, size = [group[cut:]], [x[cut:]], len(x) - cut
        if rows:
            yield search(np.concatenate(owners), np.concatenate(rows))

    return banded.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id, copies): a row for every document with the smallest id that it can reach by links.

    Equal fingerprints are one node, so groups of copies cost one row. Null and empty texts share fingerprint 0 and
    link like any other; repeated rows share their component; null ids stay and are no component's id unless it has
    no other; an empty table gives no rows.
    """
    fp = saved(fingerprints(df, id_col, text_col))
    node = fp.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("copies"))
    roots = saved(components(near_links(node.select("fp"))))
    known = node.join(roots, node.fp == roots.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    low = known.groupBy("root").agg(F.min("low").alias("component_id"))
    final = known.join(low, "root").select("fp", "component_id", "copies")
    return fp.join(final, "fp").select(id_col, "fp", "component_id", "copies")


#: Near copies of the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
COPY_SHINGLE, COPY_LEAST = 5, 0.8
#: Candidates agree in all of DEPTH minimal hashes of one of BANDS bands: a pair of 0.8 is missed with (1 - 0.8 ** 5) ** 24, 7 in 100,000.
BANDS, DEPTH = 24, 5
#: In the first round each text of a band's group is a candidate with this many first ones of the group and with the
#: one before it; what that leaves apart is compared in the second.
LEADERS = 4
#: The second round compares pairs by their shingles that agree in so many of the BANDS * DEPTH minimal hashes: one of 0.8 agrees in 96 of 120
#: on average, and in fewer than 74 less often than once in 100,000.
AGREE = 74
#: Texts of a band's group that are compared with each other at once.
CHUNK = 4000
_MULTIPLIERS = np.random.default_rng(20240301).integers(1, 2**63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles, with repeats; a shorter text is one shingle, also one without words."""
    words = text.translate(LOWER).split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))), np.uint64, len(words) - shingle + 1)


def least_hashes(text: bytes) -> np.ndarray:
    """The text's minimal shingle hashes, DEPTH for each band."""
    hashes = shingle_hashes(text)
    low = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            low = np.minimum(low, (hashes[at : at + 2048, None] * _MULTIPLIERS).min(axis=0))
        return low ^ low >> np.uint64(32)


def bands(low: np.ndarray) -> np.ndarray:
    """One number for each band of least_hashes()."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for x in low.reshape(BANDS, DEPTH).T:
            out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def copy_candidates(rows: DataFrame) -> DataFrame:
    """(crowd, a, b) of rows(band, key). Where crowd is null: a pair of keys that share a band, the first round's; see
    LEADERS. Else: the key a is in the group of band `crowd`, which is so large that the first round leaves out pairs.
    """
    most = LEADERS + 2  # in a group of so many the first round compares all pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, held, n, last = None, [], 0, None
        for batch in batches:
            crowd, a, b = [], [], []
            for x, key in zip(batch.column("band").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if x != band:
                    band, held, n, last = x, [key], 1, key
                    continue
                lead = held[:LEADERS]
                near = lead if last in lead else [*lead, last]
                crowd += [None] * len(near)
                a += near
                b += [key] * len(near)
                n, last = n + 1, key
                if n <= most:
                    held.append(key)
                else:
                    told = [*held, key] if n == most + 1 else [key]
                    crowd += [band] * len(told)
                    a += told
                    b += [0] * len(told)
            yield record(crowd=pa.array(crowd, pa.int64()), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "crowd long, a long, b long").distinct()


def copies_apart(crowds: DataFrame, lows: DataFrame, texts: DataFrame, roots: DataFrame, least: float = COPY_LEAST) -> DataFrame:
    """Links (a, b) between texts that share a crowded band and are not connected by roots(node, root): for each text
    and component one, if there is any, so that all within `least` are connected.

    crowds(band, key) are the members of large groups, lows(key, low) has the low byte of each minimal hash, texts(key,
    text) the texts. Only groups with texts of different components are looked at, without limit: those outside a group's
    largest component are compared with all texts of such groups, in blocks of CHUNK by CHUNK texts, each block a task's
    work. Texts that agree in AGREE minimal hashes are compared by their shingles there; no pair leaves a task but links.
    """
    member = crowds.join(roots, crowds.key == roots.node, "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    parts = member.groupBy("band", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    # groups of one largest component are one, so that a text comes once and not with each of its bands
    known = saved(member.join(sizes, "band").select("main", "key", "root").distinct())
    ways = known.groupBy("main").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("ways"), F.ceil(F.greatest(F.lit(1), F.count(F.when(F.col("root") != F.col("main"), 1))) / CHUNK).cast("int").alias("asks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(key=batch.column("key"), shingles=pa.array([np.unique(shingle_hashes(t)).tobytes() for t in texts_of(batch)], pa.binary()))

    needed = known.select("key").distinct()
    held = texts.join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    told = known.join(ways, "main").join(lows, "key").join(map_batches(held, sets, "key long, shingles binary"), "key")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    both = told.select("main", "key", "root", "low", "shingles", F.explode(F.concat(F.transform(every("asks"), lambda x: F.struct(deal("ways").alias("way"), x.alias("ask"), F.lit(False).alias("asks"))), F.when(F.col("root") != F.col("main"), F.transform(every("ways"), lambda x: F.struct(x.alias("way"), deal("asks").alias("ask"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<way:int,ask:int,asks:boolean>>")))).alias("p")).select("main", "p.*", "key", "root", "low", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, roots, lows, shingles, table = None, [], [], [], [], None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("main", "way", "ask", "asks", "key", "root", "low", "shingles"))
            for main, way, ask, asks, key, root, low, own in zip(*columns, strict=True):
                if (main, way, ask) != block:
                    block, keys, roots, lows, shingles, table = (main, way, ask), [], [], [], [], None
                if not asks:
                    keys.append(key)
                    roots.append(root)
                    lows.append(low)
                    shingles.append(own)
                elif keys:
                    if table is None:
                        table = np.array(roots, np.int64), np.frombuffer(b"".join(lows), np.uint8).reshape(len(lows), -1)
                    agree = (table[1] == np.frombuffer(low, np.uint8)).sum(axis=1)
                    near = np.flatnonzero((agree >= AGREE) & (table[0] != root))
                    done: set[int] = set()
                    mine = np.frombuffer(own, np.uint64)
                    for i in near[np.argsort(-agree[near], kind="stable")].tolist():  # the likeliest first: one link a component is enough
                        if roots[i] not in done and jaccard(np.frombuffer(shingles[i], np.uint64), mine) >= least:
                            done.add(roots[i])
                            out.append((min(keys[i], key), max(keys[i], key)))
            yield record(a=pa.array([x[0] for x in out], pa.int64()), b=pa.array([x[1] for x in out], pa.int64()))

    return map_batches(both.repartition("main", "way", "ask").sortWithinPartitions("main", "way", "ask", "asks"), run, "a long, b long").distinct()


def copy_links(pairs: DataFrame, texts: DataFrame, least: float = COPY_LEAST) -> DataFrame:
    """The pairs(a, b) whose texts(key, text) have a Jaccard similarity of `least` or more, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts_of(batch), strict=True):
                own = np.unique(shingle_hashes(text))
                if b is None:
                    now, first = a, own
                elif a == now and jaccard(first, own) >= least:
                    out.append((a, b))
            yield record(a=pa.array([x[0] for x in out], pa.int64()), b=pa.array([x[1] for x in out], pa.int64()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = saved(texts.join(needed, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    lead = pairs.select("a").distinct().join(held, F.col("a") == F.col("key")).select("a", F.lit(None).cast("long").alias("b"), "text")
    rows = pairs.join(held, F.col("b") == F.col("key")).select("a", "b", "text").union(lead)
    return map_batches(rows.repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()), run, "a long, b long")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, n): of each group of near copies one document, and how many rows repeat it exactly.

    Near copies share COPY_LEAST of their COPY_SHINGLE-word shingles; a group is what they link. The document is the
    one with the smallest id, nulls last, then the smallest text_key(). So rows without an id are kept apart by their
    texts, and so are different texts under one id. An empty table gives no rows. Long texts are hashed whole.
    Candidates are the texts whose fingerprints the BK-trees link (RADIUS bits, a component is one group), and for near
    copies that are farther apart, those that share a band of minimal hashes. All are checked by their shingles: the
    first round links large groups by few of their pairs, the second compares all that the first left apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = texts_of(batch)
            found = [least_hashes(t) for t in told]
            fps = np.array([fingerprint(t) for t in told], np.uint64).view(np.int64)
            values = np.concatenate([bands(x) for x in found]).view(np.int64) if found else np.zeros(0, np.int64)
            yield record(id=batch.column("id"), key=batch.column("key"), fp=fps, bands=pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, BANDS, dtype=np.int32)), pa.array(values)), low=pa.array([x.astype(np.uint8).tobytes() for x in found], pa.binary()))

    texts = df.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    marked = saved(map_batches(texts, run, "id long, key long, fp long, bands array<long>, low binary"))
    low = marked.groupBy("id", "key").agg(F.count("*").alias("n")).groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("key").alias("text_key"), "n")).alias("low"))
    keyed = texts.select("key", "text")
    near = components(saved(near_links(marked.select("fp").distinct())))
    let_go(df.sparkSession)
    linked = marked.select("key", "fp").distinct().join(near, F.col("fp") == near.node, "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"), "key")
    banded = marked.groupBy("key").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("band"), "key")
    found = saved(copy_candidates(linked.union(banded)))
    let_go(df.sparkSession)
    links = saved(copy_links(found.where("crowd is null").select("a", "b"), keyed))
    let_go(df.sparkSession)
    roots = saved(components(links))
    crowds = found.where("crowd is not null").select(F.col("crowd").alias("band"), F.col("a").alias("key"))
    lows = marked.select("key", "low").join(crowds.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("low").alias("low"))
    more = saved(copies_apart(crowds, lows, keyed, roots))
    let_go(df.sparkSession)
    if not more.isEmpty():
        roots = saved(components(links.union(more)))
    known = low.join(roots, low.key == roots.node, "left").select("low", F.coalesce("root", "key").alias("root"))
    return known.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.id").alias(id_col), "low.text_key", "low.n")

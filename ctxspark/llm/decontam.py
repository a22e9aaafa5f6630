"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each row is a shard that holds, for every term of its documents, the positions
of its postings. It is stored once and searched for any number of blocks of test items. A window's terms are taken from
the rarest on; the postings of each, moved back by the term's offset, are intersected into the starts of exact matches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_batches, record, released, saved, texts_of

WINDOW = 10
#: Benchmark text of this many bytes is one block of queries; a larger benchmark is searched block by block.
BLOCK_BYTES = 2_000_000
#: Windows of a block that are looked for at once in a shard.
WINDOWS_AT_ONCE = 50_000
#: A to Z lower-cased, digits, a to z and everything beyond ASCII kept, the rest made spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard string, doc_ids array<long>, text_keys array<long>, doc_starts array<int>, terms array<binary>, offsets array<int>, positions array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 2_000_000) -> DataFrame:
    """A row for each shard of about `shard_bytes` of text: documents, where each begins, and the postings of all terms.

    Positions count all words of the shard, so neighbours in a text are neighbours in the index; whole documents go
    to a shard, a longer one makes a larger shard. Null and empty texts have no words; an empty table has no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(docs: list, keys: list, starts: list[int], codes: list[np.ndarray], number: dict[bytes, int], n: int) -> pa.RecordBatch:
            code = np.concatenate(codes)
            if len(number) <= 65536:
                code = code.astype(np.uint16)  # sorted by radix
            order = np.argsort(code, kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(code, minlength=len(number)))
            key = hashlib.md5(f"{docs[0]} {docs[-1]} {n}".encode()).hexdigest()
            row = {"shard": key, "doc_ids": docs, "text_keys": keys, "doc_starts": [*starts, n], "terms": list(number), "offsets": np.r_[0, ends].astype(np.int32), "positions": order}
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        docs, keys, starts, codes, number, n, size = [], [], [], [], {}, 0, 0
        for batch in batches:
            for doc, text_key, text in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                docs.append(doc)
                keys.append(text_key)
                starts.append(n)
                codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                n += len(words)
                size += len(text) + 64
                if size >= shard_bytes:
                    yield shard(docs, keys, starts, codes, number, n)
                    docs, keys, starts, codes, number, n, size = [], [], [], [], {}, 0, 0
        if docs:
            yield shard(docs, keys, starts, codes, number, n)

    text = F.col(text_col).cast("string")
    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")), run, INDEX)


@dataclass
class Block:
    """Windows of test items by the numbers of their terms."""

    number: dict[bytes, int]
    #: Term numbers of each window, -1 behind its end.
    window: np.ndarray
    #: The different terms of each window and how often it has them; -1 and 0 behind their end.
    needs: np.ndarray
    times: np.ndarray
    #: Items of window w: owner[first[w]:first[w + 1]].
    first: np.ndarray
    owner: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return (self.window >= 0).sum(axis=1)


def block_of(items: list[tuple[int, bytes]], window: int = WINDOW) -> Block:
    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for item, text in items:
        codes = [number.setdefault(w, len(number)) for w in words_of(text)]
        for k in range(max(1, len(codes) - window + 1) if codes else 0):
            owners.setdefault(tuple(codes[k : k + window]), set()).add(item)
    shape = (len(owners), window)
    rows, needs, times = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    for i, codes in enumerate(owners):
        rows[i, : len(codes)] = codes
        count = Counter(codes)
        needs[i, : len(count)] = list(count)
        times[i, : len(count)] = list(count.values())
    owned = [sorted(x) for x in owners.values()]
    return Block(number, rows, needs, times, np.cumsum([0, *map(len, owned)]), np.array([i for x in owned for i in x], np.int64))


class Postings:
    """A shard's postings of the terms of a block, as one sorted list of term * wide + position."""

    def __init__(self, block: Block, terms: list[bytes], offsets: np.ndarray, positions: np.ndarray, begins: np.ndarray):
        self.begins, self.wide = begins.astype(np.int64), int(begins[-1]) + 1
        held = sorted((i, k) for k, t in enumerate(terms) if (i := block.number.get(t)) is not None)
        self.size = np.zeros(len(block.number) + 1, np.int64)  # the last one is for -1
        self.first = np.zeros(len(block.number) + 1, np.int64)
        lists = [positions[offsets[k] : offsets[k + 1]].astype(np.int64) + i * self.wide for i, k in held]
        own = np.array([i for i, _ in held], np.int64)
        self.size[own] = [len(x) for x in lists]
        self.first[own] = np.cumsum([0, *map(len, lists)])[:-1]
        self.places = np.concatenate(lists) if lists else np.zeros(0, np.int64)

    def rarest_first(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `terms` that have postings of all of their terms, and the order of each one's columns by postings."""
        size = np.where(terms >= 0, self.size[terms], np.iinfo(np.int64).max)
        alive = np.flatnonzero((size > 0).all(axis=1))
        return alive, np.argsort(size[alive], axis=1, kind="stable")

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `terms`, position) of all their postings."""
        size = self.size[terms]
        which = np.repeat(np.arange(len(terms)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.first[terms][which]
        return which, self.places[at] - terms[which].astype(np.int64) * self.wide

    def has(self, terms: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the position is in the term's list: binary search."""
        key = terms * self.wide + position
        return self.places[np.minimum(np.searchsorted(self.places, key), len(self.places) - 1)] == key

    def between(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of the term's positions are in [low, high)."""
        return np.searchsorted(self.places, terms * self.wide + high) - np.searchsorted(self.places, terms * self.wide + low)

    def documents(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, "right") - 1


def phrase_starts(post: Postings, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence inside one document."""
    out = [_phrase_starts(post, block, at) for at in range(0, len(block.window), WINDOWS_AT_ONCE)]
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(2))


def _phrase_starts(post: Postings, block: Block, at: int) -> tuple[np.ndarray, np.ndarray]:
    terms = block.window[at : at + WINDOWS_AT_ONCE]
    alive, order = post.rarest_first(terms)
    terms = terms[alive].astype(np.int64)
    row, position = post.of(terms[np.arange(len(alive)), order[:, 0]])
    start = position - order[row, 0]
    size = (terms >= 0).sum(axis=1)
    for k in range(terms.shape[1]):
        if k == 0:
            doc = post.documents(np.maximum(start, 0))
            keep = (start >= post.begins[doc]) & (start + size[row] <= post.begins[doc + 1])
        else:
            offset = order[row, k]
            term = terms[row, offset]
            keep = term < 0
            ask = np.flatnonzero(~keep)
            keep[ask] = post.has(term[ask], start[ask] + offset[ask])
        row, start = row[keep], start[keep]
        if not len(row):
            break
    return alive[row] + at, start


def near_spans(post: Postings, block: Block, slack: int) -> set[tuple[int, int]]:
    """(document, window): all words of the window, repeated ones as often as there, stand in one document within
    as many words and `slack` more, in any order.

    Every posting of a window's rarest word is tried: what lies in reach of it must hold enough of each other word,
    the rarest on, which leaves few places; there the shortest span is swept.
    """
    found: set[tuple[int, int]] = set()
    reach = block.size + slack
    for at in range(0, len(block.window), WINDOWS_AT_ONCE):
        terms, times = block.needs[at : at + WINDOWS_AT_ONCE], block.times[at : at + WINDOWS_AT_ONCE]
        alive, order = post.rarest_first(terms)
        terms, times, far = terms[alive].astype(np.int64), times[alive], reach[at : at + WINDOWS_AT_ONCE][alive]
        row, a = post.of(terms[np.arange(len(alive)), order[:, 0]])
        for k in range(terms.shape[1]):
            doc = post.documents(a)
            low, high = np.maximum(a - far[row] + 1, post.begins[doc]), np.minimum(a + far[row], post.begins[doc + 1])
            column = order[row, k]
            term = terms[row, column]
            keep = term < 0
            ask = np.flatnonzero(~keep)
            keep[ask] = post.between(term[ask], low[ask], high[ask]) >= times[row[ask], column[ask]]
            row, a = row[keep], a[keep]
            if not len(row):
                break
        for r, d, x in zip(row.tolist(), post.documents(a).tolist(), a.tolist(), strict=True):
            p = int(alive[r]) + at
            if (d, p) not in found:
                low, high = max(x - int(far[r]) + 1, int(post.begins[d])), min(x + int(far[r]), int(post.begins[d + 1]))
                if shortest_span(post, block.window[p], low, high) <= far[r]:
                    found.add((d, p))
    return found


def shortest_span(post: Postings, window: np.ndarray, low: int, high: int) -> int:
    """Words in the shortest span within [low, high) that holds all words of the window, repeated ones as often; 1 << 40
    if none does."""
    lack = Counter(window[window >= 0].tolist())
    stand = []
    for t in lack:
        a, b = np.searchsorted(post.places, [t * post.wide + low, t * post.wide + high])
        stand += [(int(x) - t * post.wide, t) for x in post.places[a:b]]
    stand.sort()
    missing, first, best = sum(lack.values()), 0, 1 << 40
    for x, w in stand:
        missing -= lack[w] > 0
        lack[w] -= 1
        while not missing:
            begin, v = stand[first]
            best = min(best, x - begin + 1)
            lack[v] += 1
            missing += lack[v] > 0
            first += 1
    return best


def benchmark_blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in blocks of bounded bytes, streamed to the driver a partition at a time."""
    block, size = [], 0
    for row in bench.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: list[tuple[int, bytes]], window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """(doc_id, text_key, n_words, hits, items, near_items) for every document of the index.

    hits: the words, counted from 0, inside an occurrence of any window of `window` consecutive words of an item; an
    item of fewer words, but not none, is one window. items: those with occurring windows. near_items, if `slack` is
    given: items of which any window's words stand together, in any order, within that many words more.
    """
    shared = index.sparkSession.sparkContext.broadcast(block_of(items, window))  # of at most BLOCK_BYTES of items

    def owners(block: Block, pairs: set[tuple[int, int]], docs: int) -> pa.Array:
        by_doc: dict[int, set[int]] = {}
        for d, p in pairs:
            by_doc.setdefault(d, set()).update(block.owner[block.first[p] : block.first[p + 1]].tolist())
        return pa.array([sorted(by_doc.get(d, ())) for d in range(docs)], pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sizes = block.size
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values  # noqa: B023, E731
                begins = get("doc_starts").to_numpy()
                post = Postings(block, get("terms").to_pylist(), get("offsets").to_numpy(), get("positions").to_numpy(zero_copy_only=False), begins)
                n, docs = int(begins[-1]), len(begins) - 1
                phrase, start = phrase_starts(post, block)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + sizes[phrase], -1)
                hit = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                counts = np.diff(np.searchsorted(hit, begins))
                local = hit - np.repeat(begins[:-1], counts)
                exact = owners(block, set(zip(post.documents(start).tolist(), phrase.tolist(), strict=True)), docs)
                near = owners(block, near_spans(post, block, slack) if slack is not None else set(), docs)
                yield record(doc_id=get("doc_ids"), text_key=get("text_keys"), n_words=np.diff(begins).astype(np.int64), hits=pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(local.astype(np.int32))), items=exact, near_items=near)

    return index.mapInArrow(released(run), "doc_id long, text_key long, n_words long, hits array<int>, items array<long>, near_items array<long>")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slack: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """search() of all of `bench` over all of `docs`: the index is stored once and searched block by block.

    Null texts have no words; null items are ignored; an empty benchmark contaminates nothing, an empty table of
    documents gives no rows. Long texts are indexed whole. Every row of docs gives one row: blocks are merged by id and
    hash of the text, and rows that agree in both come out as often as they went in.
    """
    index = saved(build_index(docs, id_col, text_col))
    found = None
    blocks = benchmark_blocks(bench, item_col, item_text, block_bytes)
    last = next(blocks, [])
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    n = 1
    for block in blocks:
        part = saved(search(index, last, window, slack))  # results of one block at a time; its broadcast can go
        found = part if found is None else found.unionByName(part)
        last, n = block, n + 1
    part = search(index, last, window, slack)
    if found is None:
        return part.drop("text_key").withColumnRenamed("doc_id", id_col)
    rows = (F.count("*") / n).cast("int").alias("rows")
    one = found.unionByName(part).groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), rows, *(merged(c) for c in ("hits", "items", "near_items")))
    return one.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).drop("row", "rows", "text_key").withColumnRenamed("doc_id", id_col)

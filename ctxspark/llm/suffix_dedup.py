"""Exact substring dedup: every byte covered by a string of `least` bytes that also starts earlier is removed.

Two equal windows of `least` bytes choose the same pivot inside them, the K-byte string of the smallest hash, at the
same place. So windows are only compared where their pivots agree:

1. pivots: each stretch of text gives its pivots and the windows each one stands for (about 3 in 100 bytes). Where
   the whole context was seen before in the stretch, byte for byte, the windows go no further.
2. By pivot: contexts whose pivot and half context no other place shares are unique. Hashes only rule places out here;
   whatever two places may share goes on.
3. These contexts are cut from the texts, dealt into shards by pivot and half context and sorted: a suffix array by
   Larsson-Sadakane refinement, common prefixes by Kasai's recurrence, classes of equal windows from both. A route that
   fills several shards has the later shards' windows looked up in the earlier suffix arrays by binary search; one of
   very many places is dealt over salted shards first, and only what is left of each is sorted again, by finer routes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import map_batches, record, saved

LEAST, K = 100, 24
#: Bytes of text whose pivots are looked for together, and of contexts in one suffix array.
STRETCH, SHARD = 1_500_000, 1_000_000
#: Contexts of one route that a shard takes; a route with more is dealt over several.
MANY = 1000
#: Earlier shards of a dealt route that one task searches; what it misses so the next round finds.
EARLIER = 4
#: Places of one pivot that are held at once.
PIVOT_ROWS = 200_000
#: Windows of a dealt route that go on together: they share least - STEP + 1 bytes.
STEP = 8
NO_ID = -(2**63)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            _POWERS[name] = have = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, STRETCH + 1000), base, np.uint64)])
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of a stretch, from one running sum."""

    def __init__(self, raw: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * _power(_B, len(raw), "b"), dtype=np.uint64)]
        self.back = _power(_INV, len(raw) + 1, "i")

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.back[a])


def pivots(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """The stretch's hashes; each pivot's place and the first and last window start that chose it."""
    hashes, n, width = Hashes(raw), len(raw), least - K + 1
    if n < least:
        none = np.zeros(0, np.int64)
        return hashes, none, none, none
    at = np.arange(n - K + 1)
    key = (hashes.of(at, at + K) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    size, low = 1, key
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    inside = np.zeros(n + 1, np.int32)
    fit = ends - starts >= least
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - least + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:n])[: len(low)] > 0)
    place = (low[window] & np.uint64(0xFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]) if len(place) else np.zeros(0, np.int64)
    tail = np.r_[head[1:], len(place)] - 1
    return hashes, place[head], window[head], window[tail]


def runs(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the same owner that touch or overlap, united: (start, end, owner)."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner.astype(np.int64) * wide) - owner.astype(np.int64) * wide
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])])
    return start[head], np.maximum.reduceat(end, head), owner[head]


def suffix_array(raw: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: order by 7 bytes, then double the sorted depth within the groups that are still equal.

    rest[p]: bytes from p to the end of its record. Records end in sentinels that precede every byte, the earlier
    record's first.
    """
    n = len(raw)
    padded = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(8) | np.where(rest > k, padded[k : n + k], np.uint64(0))
    key = key << np.uint64(8) | np.minimum(rest, 7).astype(np.uint64)
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else 0
    depth, slot = 7, np.flatnonzero(~(head & np.r_[head[1:], True])) if n else np.zeros(0, np.int64)
    while len(slot):
        p = sa[slot]
        ended = rest[p] <= depth
        second = np.where(ended, p, n + rank[np.minimum(p + depth, n - 1)])  # what has ended comes first
        both = rank[p] * (2 * n) + second
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[slot] = p
        head = np.r_[True, both[1:] != both[:-1]]
        rank[p] = slot[np.maximum.accumulate(np.where(head, np.arange(len(slot)), 0))]
        slot = slot[~(head & np.r_[head[1:], True])]
        depth *= 2
    return sa


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number, zeros behind the end: a view, without a copy of each."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw), ">u8", padded, strides=(1,))


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b agree, `most` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = (words[a[live] + out[live]] ^ words[b[live] + out[live]]).astype(np.uint64)
        add = np.full(len(live), 8)
        differ = x != 0
        top = x[differ]
        zeros = np.zeros(len(top), np.int64)
        for shift in (32, 16, 8):
            small = top < np.uint64(1 << (64 - shift))
            zeros[small] += shift // 8
            top = np.where(small, top << np.uint64(shift), top)
        add[differ] = zeros
        out[live] += add
        live = live[(add == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def common_prefixes(raw: np.ndarray, rest: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai: lcp[i] of the suffixes sa[i - 1] and sa[i]; lcp[0] is 0.

    In text order a suffix shares at least one byte less with its predecessor than the suffix before it; where the
    bytes before both agree it is exactly one less. The others are compared, the rest follow from a running maximum.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    first = np.r_[True, rest[1:] != rest[:-1] - 1]
    other = np.maximum(before, 0)
    own = first | (before < 0) | first[other] | (raw[np.arange(n) - 1] != raw[other - 1])
    p = np.flatnonzero(own)
    q = before[p]
    got = np.where(q < 0, 0, same_bytes(words8(raw), p, np.maximum(q, 0), np.where(q < 0, 0, np.minimum(rest[p], rest[np.maximum(q, 0)]))))
    far = np.full(n, -1, np.int64)
    far[p] = got + p
    by_place = np.maximum.accumulate(far) - np.arange(n)
    by_place[before < 0] = 0
    return by_place[sa]


class Shard:
    """Contexts of one shard with their suffix array; answers which windows are equal."""

    def __init__(self, contexts: list[bytes], least: int):
        self.least = least
        self.raw = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.array([len(c) for c in contexts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.record = np.repeat(np.arange(len(size)), size)
        self.rest = self.end[self.record] - np.arange(len(self.raw))
        self.sa = suffix_array(self.raw, self.rest)
        self.words = None

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows' places in the shard in suffix order, and for each the smallest place with the same window."""
        lcp = common_prefixes(self.raw, self.rest, self.sa)
        wide = self.rest[self.sa] >= self.least
        place, joined = self.sa[wide], (lcp >= self.least)[wide]
        if not len(place):
            return place, place
        head = np.flatnonzero(~joined | np.r_[True, np.zeros(len(place) - 1, bool)])
        return place, np.repeat(np.minimum.reduceat(place, head), np.diff(np.r_[head, len(place)]))

    def holds(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """Whether the other shard's windows at `places` stand here too: binary search in the suffix array."""
        if self.words is None:
            self.words = words8(self.raw)
            self.windows = self.sa[self.rest[self.sa] >= self.least]
        if other.words is None:
            other.words = words8(other.raw)
            other.windows = other.sa[other.rest[other.sa] >= other.least]
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.windows), np.int64)
        steps = [*range(0, self.least - 7, 8), self.least - 8]

        def order(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
            out = np.zeros(len(mine), np.int8)
            live = np.arange(len(mine))
            for s in steps:
                a, b = self.words[mine[live] + s], other.words[theirs[live] + s]
                out[live] = np.where(a < b, -1, np.where(a > b, 1, 0))
                live = live[a == b]
            return out

        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) // 2
            less = order(self.windows[mid], places[busy]) < 0
            low[busy] = np.where(less, mid + 1, low[busy])
            high[busy] = np.where(less, high[busy], mid)
        at = np.minimum(low, max(len(self.windows) - 1, 0))
        return (low < len(self.windows)) & (order(self.windows[at], places) == 0) if len(self.windows) else np.zeros(len(places), bool)


def owner_check(ids: np.ndarray) -> np.ndarray:
    """32 bits of a document's id, which a settled range brings along beside its document's key."""
    return mix(ids.view(np.uint64)) >> np.uint64(32)


def _pivot_rows(least: int):
    """Step 1: (h, doc, at) of every pivot: 48 bits of its hash and 16 of its left half context's; its place, what it
    stands for, and 18 bits of its right half context's hash.

    at < 0 marks a range that repeats an earlier one of the stretch, byte for byte: it begins at -1 - at and ends at the
    low half of h; the high half is owner_check().
    """
    half = (least - K) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretch(ids: list[int], tks: list[int], keys: list[int], bases: list[int], texts: list[bytes]) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(t) for t in texts], np.int64)
            end = np.cumsum(size)
            begin = end - size
            hashes, place, s0, s1 = pivots(raw, begin, end, least)
            doc = np.searchsorted(end, s0, "right")
            h = hashes.of(place, place + K) >> np.uint64(16) << np.uint64(16)
            left, right = s0 <= place - half, s1 > place - half
            e1 = np.where(left, hashes.of(np.where(left, place - half, 0), np.where(left, place + K, 0)) >> np.uint64(48), np.uint64(0))
            upto = np.where(right, place + K + half, 0)
            e2 = np.where(right, hashes.of(np.where(right, place, 0), upto) >> np.uint64(46), np.uint64(0))
            ids_, tks_, keys_, bases_ = (np.array(x, np.int64) for x in (ids, tks, keys, bases))
            pos = bases_[doc] + place - begin[doc]
            shape = ((place - s0) << 7 | (s1 - s0)).astype(np.uint64)
            near = mix(hashes.of(s0, s1 + least) + shape)  # puts contexts that may be equal side by side
            order = np.lexsort((pos, tks_[doc], ids_[doc], near, h))
            h, near, e1, e2, doc, pos, shape, s0, s1 = (x[order] for x in (h, near, e1, e2, doc, pos, shape, s0, s1))
            d0, own, i, t = (shape >> np.uint64(7)).astype(np.int64), s1 - s0, ids_[doc], tks_[doc]
            n = len(h)
            head = np.r_[True, (h[1:] != h[:-1]) | (near[1:] != near[:-1])] if n else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
            again = (i != i[first]) | (t != t[first]) | (pos != pos[first])
            ask = np.flatnonzero(again)
            if len(ask):
                long = own[ask] + least
                again[ask] = (own[first[ask]] == own[ask]) & (same_bytes(words8(raw), s0[ask], s0[first[ask]], long) >= long)
            a, b, o = runs((pos - d0)[again], (pos - d0 + own + least)[again], doc[again])
            keep = ~again
            at = pos[keep] << 32 | d0[keep] << 25 | own[keep] << 18 | e2[keep].astype(np.int64)
            stop = owner_check(ids_[o]) << np.uint64(32) | b.astype(np.uint64)
            return record(h=np.r_[h[keep] | e1[keep], stop].view(np.int64), doc=np.r_[keys_[doc[keep]], keys_[o]], at=np.r_[at, -1 - a])

        ids, tks, keys, bases, texts, size = [], [], [], [], [], 0
        for batch in batches:
            for i, t, key, x in zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "doc", "text")), strict=True):
                x = x or b""
                for base in range(0, max(len(x) - least + 1, 0), STRETCH):  # windows start in [base, base + STRETCH)
                    part = x[base : base + STRETCH + least - 1] if len(x) > STRETCH else x
                    ids.append(i)
                    tks.append(t)
                    keys.append(key)
                    bases.append(base)
                    texts.append(part)
                    size += len(part)
                    if size >= STRETCH:
                        yield stretch(ids, tks, keys, bases, texts)
                        ids, tks, keys, bases, texts, size = [], [], [], [], [], 0
        if texts:
            yield stretch(ids, tks, keys, bases, texts)

    return run


def _by_pivot(least: int):
    """Step 2, over rows sorted by h, those of one pivot together: ranges that are settled (need = at and route = h), and the contexts that share a
    pivot and half a context with another place: need packs their salt, where their windows begin, how many more there
    are, and how far the pivot is from the first.

    A pivot of more than PIVOT_ROWS places is passed on in parts, all of it, so memory is bounded.
    """
    half = (least - K) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: int | None = None  # the pivot that is passed on in parts
        passed = 0

        def settle(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            known = at < 0
            settled = h[known], doc[known], at[known]
            h, doc, at = h[~known], doc[~known], at[~known]
            order = np.lexsort((at, doc, h))
            h, doc, at = (x[order] for x in (h, doc, at))
            if len(h):  # repeated rows of the table: one document
                fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]
                h, doc, at = (x[fresh] for x in (h, doc, at))
            e1, h = h & 0xFFFF, h >> 16
            p, d0, own, e2 = at >> 32, at >> 25 & 127, at >> 18 & 127, at & 0x3FFFF
            s0, s1 = p - d0, p - d0 + own
            always = h == hot if hot is not None else np.zeros(len(h), bool)

            def shared(e: np.ndarray, has: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
                """Whether another place shares this side's half context, and the route of those that do."""
                route = mix(h.view(np.uint64) + e.astype(np.uint64) * np.uint64(4) + np.uint64(side))
                _, inverse, count = np.unique(route[has], return_inverse=True, return_counts=True)
                out = always & has
                out[has] |= count[inverse] > 1
                return out, route

            left, left_route = shared(e1, s0 <= p - half, 1)
            right, right_route = shared(e2, s1 > p - half, 2)
            # a small pivot's contexts go on whole; of a large one those with half a context or more before the pivot,
            # and the others, go on alone, by pivot and half context
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            large = (count[inverse] > MANY) | always if len(h) else always
            small = ~large & (left | right)
            outs = [(small, np.where(left, s0, np.maximum(s0, p - half + 1)), np.where(right, s1, np.minimum(s1, p - half)), h.view(np.uint64))]
            outs += [(large & left, s0, np.minimum(s1, p - half), left_route), (large & right, np.maximum(s0, p - half + 1), s1, right_route)]
            cols = []
            for go, a, b, route in outs:
                nth = np.zeros(int(go.sum()), np.int64)
                if go is not small and len(nth):
                    _, inverse, count = np.unique(route[go], return_inverse=True, return_counts=True)
                    nth[np.argsort(inverse, kind="stable")] = np.arange(len(nth)) - np.repeat(np.cumsum(np.r_[0, count[:-1]]), count)
                    salt = np.where(always[go], 1 + (passed + nth) // MANY, np.where(count[inverse] > MANY, 1 + nth // MANY, 0))
                else:
                    salt = nth
                cols.append((route[go].view(np.int64), doc[go], salt << 45 | a[go] << 14 | (b - a)[go] << 7 | (p - a)[go]))
            return record(**{name: np.concatenate([x[k] for x in (settled, *cols)]) for k, name in enumerate(("route", "doc", "need"))})

        parts, size = [], 0
        for batch in batches:
            parts.append([batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "doc", "at")])
            size += batch.num_rows
            if size >= PIVOT_ROWS:
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                cut = int(np.searchsorted(cols[0] >> 16, cols[0][-1] >> 16))
                if cut:
                    yield settle(*(x[:cut] for x in cols))
                    parts, size = [[x[cut:] for x in cols]], size - cut
                if size >= PIVOT_ROWS:  # all of one pivot
                    now = int(cols[0][-1] >> 16)
                    passed = passed if hot == now else 0
                    hot = now
                    yield settle(*(x[cut:] for x in cols))
                    passed += size
                    parts, size = [], 0
        if parts:
            yield settle(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


CONTEXT = "route long, salt int, id long, tk long, start int, d int, context binary, stop int"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
_NAMES = ("route", "salt", "id", "tk", "start", "d", "context", "stop")


def context_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Contexts, and settled ranges, which have a stop and no context."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return record(**{n: pa.array(c, k) for n, c, k in zip(_NAMES, cols, _KINDS, strict=True)})


def _cut_contexts(least: int, dealt: bool):
    """The contexts of routes that are dealt over several shards; or those of all others, and the settled ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            check = owner_check(batch.column("id").to_numpy()).tolist()
            for i, t, x, routes, needs, own in zip(*(batch.column(k).to_pylist() for k in ("id", "tk", "text", "routes", "needs")), check, strict=True):
                for route, n in zip(routes, needs, strict=True):
                    if n >= 0 and (n >> 45 > 0) == dealt:
                        start = n >> 14 & 0x7FFFFFFF
                        out.append((route, n >> 45, i, t, start, n & 127, x[start : start + (n >> 7 & 127) + least], 0))
                    elif n < 0 and not dealt and route >> 32 & 0xFFFFFFFF == own:
                        out.append((t, 0, i, t, -1 - n, 0, None, route & 0xFFFFFFFF))
            yield context_rows(out)

    return run


def finer(route: int, d: int, context: bytes, a: int, b: int, least: int) -> list[tuple[int, int, int]]:
    """Windows a to b of a context in parts (route, a, b) that share all but STEP - 1 bytes: windows whose distance to the
    pivot agrees in its multiple of STEP are equal only where those bytes are."""
    out = []
    while a <= b:
        step = (d - a) // STEP  # the windows begin STEP * step to STEP * step + STEP - 1 bytes before the pivot
        upto = min(b, d - STEP * step)
        common = d - STEP * step
        key = hashlib.blake2b(route.to_bytes(8, "little", signed=True) + step.to_bytes(4, "little", signed=True) + context[common : common + least - STEP + 1], digest_size=8)
        out.append((int.from_bytes(key.digest(), "little", signed=True), a, upto))
        a = upto + 1
    return out


def _sort_contexts(least: int):
    """Step 3, over contexts sorted by (route, id, tk, start): the duplicates among their windows as settled ranges,
    and of routes that are dealt over several shards (salt > 0) the windows that no earlier one here equals, for the next
    round; of such a route no more than EARLIER shards are held. Ranges that are settled already pass through.

    Equal contexts of a route, compared by their bytes, are sorted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: list[Shard] = []  # shards that hold contexts of the route that goes on
        going: int | None = None
        rows: list[tuple] = []
        where: set[tuple[int, bytes]] = set()
        equal: list[tuple] = []

        def settle() -> pa.RecordBatch:
            nonlocal earlier, going, rows, where, equal
            shard = Shard([r[6] for r in rows], least)
            place, low = shard.classes()
            ids, tks, starts = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
            rec, mine = shard.record[place], shard.record[low]
            pos, first = starts[rec] + place - shard.begin[rec], starts[mine] + low - shard.begin[mine]
            dup = (ids[rec] != ids[mine]) | (tks[rec] != tks[mine]) | (pos != first)
            if earlier and going == rows[0][0]:
                same = np.array([r[0] == going for r in rows], bool)
                ask = np.flatnonzero(~dup & same[rec])
                for other in earlier:
                    ask = ask[~dup[ask]]
                    dup[ask] = other.holds(shard, place[ask])
            else:
                earlier = []
            earlier = [*earlier, shard] if rows[0][0] == rows[-1][0] else [shard]
            if rows[-1][1]:
                earlier = earlier[-EARLIER:]
            going = rows[-1][0]
            a, b, o = runs(pos[dup], pos[dup] + least, rec[dup])
            found = zip(ids[o].tolist(), tks[o].tolist(), a.tolist(), b.tolist(), strict=True)
            more = []
            if any(r[1] for r in rows):
                dealt = np.array([r[1] > 0 for r in rows], bool)
                left = np.flatnonzero(~dup & dealt[rec])
                x, y, owner = runs(place[left], place[left] + 1, rec[left])  # consecutive windows of one context
                for u, v, k in zip(x.tolist(), (y - 1).tolist(), owner.tolist(), strict=True):
                    route, _, i, t, start, d, context = rows[k]
                    u, v = u - int(shard.begin[k]), v - int(shard.begin[k])
                    more += [(r, 0, i, t, start + f, d - f, context[f : g + least], 0) for r, f, g in finer(route, d, context, u, v, least)]
            out = context_rows([(t, 0, i, t, f, 0, None, g) for i, t, f, g in chain(found, equal)] + more)
            rows, where, equal = [], set(), []
            return out

        size, before = 0, None
        for batch in batches:
            settled = batch.column("context").is_null()
            yield batch.filter(settled)
            batch = batch.filter(pc.invert(settled))
            for row in zip(*(batch.column(k).to_pylist() for k in _NAMES[:-1]), strict=True):
                place = (row[0], *row[2:5])
                if place == before:  # a repeated row of the table: the same document
                    continue
                if size >= SHARD or len(equal) >= 100_000:
                    yield settle()
                    size = 0
                before = place
                key = (row[0], row[6])
                if key in where:
                    equal.append((row[2], row[3], row[4], row[4] + len(row[6])))
                else:
                    where.add(key)
                    rows.append(row)
                    size += len(row[6])
        if rows:
            yield settle()

    return run


def _remove(decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, found, own in zip(*(batch.column(c).to_pylist() for c in ("text", "found", "own")), strict=True):
                cut: list[list[int]] = []
                for r in sorted((r["start"], r["stop"]) for r in found or () if r["own"] == own):
                    if cut and r[0] <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], r[1])
                    else:
                        cut.append(list(r))
                edges = [0, *(e for c in cut for e in c), len(text)]
                kept.append(b"".join([text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)]) if cut else text)
                spans.append([{"start": a, "stop": b} for a, b in cut])
            more = {"more": batch.column("more")} if "more" in batch.schema.names else {}
            yield record(id=batch.column("id"), n_bytes=pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64()), kept=pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary()), spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), **more)

    return run


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tk"), F.coalesce(F.encode(text, "utf-8"), F.lit(b"")).alias("text")]


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, decoded: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_bytes, kept binary, spans): every document with the removed runs of bytes and what remains.

    decoded: kept is a string, without the bytes of characters that a run cut in two. carry: columns of df that each
    row brings along, in a struct `more`.
    Documents are ordered by id, nulls first. Matches never cross documents. A null text is empty. Repeated rows
    (equal id and text) are one document, each row gets its result; different texts under one id are different
    documents, ordered by a 64-bit hash of the text. `least` is from K + 2 to K + 127. An empty table gives no rows.
    """
    if not K + 2 <= least <= K + 127:
        raise ValueError("least is out of range")
    keyed = df.select(*_keys(id_col, text_col), *([F.struct(*carry).alias("more")] if carry else [])).withColumn("doc", F.xxhash64("id", "tk"))
    rows = map_batches(keyed.select("id", "tk", "doc", "text"), _pivot_rows(least), "h long, doc long, at long")
    judged = map_batches(rows.repartition(F.shiftright("h", 16)).sortWithinPartitions("h"), _by_pivot(least), "route long, doc long, need long")
    needs = judged.groupBy("doc").agg(F.collect_list("route").alias("routes"), F.collect_list("need").alias("needs"))  # both in the order of the rows
    found = None
    # all joins shuffle the same columns of the texts by doc alone, so that is done once
    for dealt, rounds in ((False, (("route",),)), (True, (("route", "salt"), ("route",)))):
        now = map_batches(keyed.hint("merge").join(needs, "doc"), _cut_contexts(least, dealt), CONTEXT)
        for by in rounds:
            now = map_batches(now.repartition(*by).sortWithinPartitions("route", "id", "tk", "start"), _sort_contexts(least), CONTEXT)
        found = now if found is None else found.union(now)
    found = found.select(F.xxhash64("id", "tk").alias("doc"), F.struct("start", "stop", F.hash("id", "tk").alias("own")).alias("range"))
    found = found.groupBy("doc").agg(F.collect_list("range").alias("found"))
    joined = keyed.hint("merge").join(found, "doc", "left").withColumn("own", F.hash("id", "tk"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.StringType() if decoded else T.BinaryType()), T.StructField("spans", T.ArrayType(span))])
    out = map_batches(joined, _remove(decoded), T.StructType([*schema.fields, keyed.schema["more"]]) if carry else schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def digests(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from dedup()'s."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return result.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], least: int) -> dict[int, tuple[int, int, str]]:
    """The definition, for tests: (removed, spans, digest of what remains) by id."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        t = texts[i]
        gone = bytearray(len(t))
        for s in range(len(t) - least + 1):
            w = t[s : s + least]
            if w in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out

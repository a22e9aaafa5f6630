"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token exactly one token can end its encoding. The table of these last tokens is the
encoding: walking back from the end gives the ids, appending extends the table exactly, and an edit keeps the
entries before it and recomputes those behind it only until they agree with the old ones again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_batches, no_cycles, record


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file's content."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBpe:
    """Encoder over fixed ranks. Caches are bounded and only save time."""

    PIECES, PAIRS = 250_000, 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.ends = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.ends.add_word(t.decode("latin-1"), (r, len(t)))
        self.ends.make_automaton()
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.counts: dict[str, int] = {}

    def forget(self) -> None:
        """Empties the large caches: a worker that goes on to other work shouldn't hold them."""
        self.pieces.clear()
        self.known.clear()
        self.counts.clear()

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a byte; (-1, -1) if merging never makes t."""
        if t not in self.split:
            b = self.token[t]
            if len(b) == 1:
                self.split[t] = None
            else:
                parts = [b[i : i + 1] for i in range(len(b))]
                while len(parts) > 2:
                    r, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if r >= 1 << 60:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                self.split[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.split[t]

    def fits(self, a: int, b: int) -> bool:
        """Whether the concatenation of tokens a and b is encoded as just these two.

        Undoes the later of the two tokens' merges again and again; a and b stay apart unless some pair that
        faced each other over the boundary would have merged before the merge that hid it.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        if self.halves(a) == (-1, -1) or self.halves(b) == (-1, -1):
            return False
        limit = 1 << 60  # a merge over the boundary of at least this rank comes too late
        token, ranks = self.token, self.ranks
        while True:
            if ranks.get(token[a] + token[b], 1 << 60) < limit:
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and a > b):
                limit, a = a, ha[1]  # at equal rank the left merge comes first, so a merge with it loses a tie
            else:
                limit, b = b + 1, hb[0]

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the token that ends the encoding of piece[:i + 1]. A given `last` is continued."""
        last = [] if last is None else last
        text, pairs, add = piece.decode("latin-1"), self.pairs, last.append
        done = len(last)
        for end, (rank, size) in self.ends.iter(text, max(0, done - self.longest)):  # at each end, longest first
            if end != done:
                continue
            if size > end:
                ok = size == 1 or self.halves(rank) != (-1, -1)
            else:
                before = last[end - size]
                ok = pairs.get(before << 20 | rank)
                if ok is None:
                    ok = self.fits(before, rank)
            if ok:
                add(rank)
                done += 1
        if done < len(piece):
            raise ValueError(f"no token ends prefix {piece[: done + 1]!r}")
        return last

    @property
    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.ranks))
        return self._longest

    def walk(self, last: list[int]) -> tuple[int, ...]:
        out, at, token = [], len(last) - 1, self.token
        while at >= 0:
            out.append(last[at])
            at -= len(token[last[at]])
        return tuple(reversed(out))

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        got = self.pieces.get(piece)
        if got is None:
            whole = self.ranks.get(piece)
            got = (whole,) if whole is not None else self.walk(self.last_tokens(piece))
            if len(piece) <= 64:
                if len(self.pieces) >= self.PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of every pre-token of the text, in order."""
        found, known = self.pattern.findall(text), self.known
        fresh = set(found).difference(known)
        if len(known) + len(fresh) > self.PIECES:
            known.clear()
            fresh = set(found)
        for p in fresh:
            piece = p.encode()
            whole = self.ranks.get(piece)
            known[p] = (whole,) if whole is not None else self.walk(self.last_tokens(piece))
        out = list(map(known.__getitem__, found))
        for p in fresh:
            if len(p) > 64:  # long pre-tokens are rare and would fill the cache
                del known[p]
        return iter(out)


class PrefixTable:
    """The last-token table of one pre-token, kept for exact appends and edits."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, bpe.last_tokens(piece)

    def ids(self) -> tuple[int, ...]:
        whole = self.bpe.ranks.get(self.piece)
        return (whole,) if whole is not None and self.piece else self.bpe.walk(self.last)

    def append(self, more: bytes) -> PrefixTable:
        self.piece += more
        self.bpe.last_tokens(self.piece, self.last)
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces piece[start:end]. Entries before start stay; returns how many were computed.

        Behind the edit, old entries hold again once `longest` of them in a row came out as before and none of
        their tokens reaches back over the edit: from there on the same tokens meet the same predecessors.
        """
        old, tail, shift = self.last, len(self.piece) - end, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last, done, same, sizes = old[:start], 0, 0, self.bpe.token
        step = 32
        while len(last) < len(self.piece):
            upto = min(len(self.piece), max(len(last), start + len(new)) + step)
            begin = len(last)
            self.bpe.last_tokens(self.piece[:upto], last)
            done += upto - begin
            for i in range(max(begin, start + len(new)), upto):
                inside = len(sizes[last[i]]) <= i - (start + len(new)) + 1
                same = same + 1 if inside and last[i] == old[i - shift] else 0
            if same >= self.bpe.longest and tail:
                last.extend(old[upto - shift :])
        self.last = last
        return done


_ENCODERS: dict[int, PrefixBpe] = {}


def encoder(data: bytes, pattern: str) -> PrefixBpe:
    """One encoder a worker and vocabulary."""
    key = hash((data, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixBpe(load_ranks(data), pattern)
    return _ENCODERS[key]


class Decoder:
    """Ids to bytes by array look-ups."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {r: t for t, r in ranks.items()}
        tokens = [token.get(i, b"") for i in range(max(token) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        return self.flat[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>): the token ids of every whole text, row by row, without a shuffle.

    With `decoded` the ids are decoded in the same pass, as decode() would, into `bytes` behind them: one Python
    worker a task instead of two. Null and empty texts give an empty array, null ids stay, repeated rows give
    repeated results, other columns are ignored; long texts are encoded whole, an empty table gives no rows. The rank file (under a megabyte) is read on the driver and sent
    with the function.
    """
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(data.value, pattern)
        back = Decoder(bpe.ranks) if decoded else None
        with no_cycles(bpe.forget):  # walking the caches costs a tenth of the time or more
            for batch in batches:
                rows = [np.fromiter(chain.from_iterable(bpe.encode(x or "")), np.int32) for x in batch.column("text").to_pylist()]
                sizes = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
                more = {"bytes": pa.array([back.decode(x) for x in rows], pa.binary())} if back else {}
                yield record(id=batch.column("id"), ids=pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), **more)

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, ids array<int>" + ", bytes binary" * decoded).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, bytes binary): the bytes of every row's ids; null or empty ids give no bytes."""
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(load_ranks(data.value))
        for batch in batches:
            rows = [back.decode(ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)) for ids in batch.column("ids")]
            yield record(id=batch.column("id"), ids=batch.column("ids"), bytes=pa.array(rows, pa.binary()))

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), "ids"), run, "id long, ids array<int>, bytes binary").withColumnRenamed("id", id_col)

"""Token counts that follow edits.

A document is cut into pre-tokens; the leaves of a segment tree hold runs of pre-tokens with their characters and
tokens, inner nodes the sums. An edit finds its leaves from the root, re-encodes the touched pre-tokens and the few
around them until a cut falls where one was before, and updates the sums above.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PrefixBpe, encoder
from .util import map_batches, no_cycles, record

#: Pre-tokens in a leaf when it is built.
LEAF = 32
#: Pre-tokens before an edit that are cut again: the pattern looks at most one character ahead.
CONTEXT = 2


class CountTree:
    """The segment tree of one document."""

    def __init__(self, bpe: PrefixBpe, text: str, stored: tuple[list[int], list[int]] | None = None):
        """stored: the pre-tokens' lengths and token counts, where the text was cut before."""
        self.bpe = bpe
        self.encoded = 0
        if stored is None:
            self.build(self.cut(text))
        else:
            ends = list(accumulate(stored[0]))
            self.build([(text[b - n : b], c) for b, n, c in zip(ends, *stored, strict=True)])

    def stored(self) -> tuple[list[int], list[int]]:
        every = [x for leaf in self.leaves for x in leaf]
        return [len(p) for p, _ in every], [n for _, n in every]

    def cut(self, text: str) -> list[tuple[str, int]]:
        pieces = self.bpe.pattern.findall(text)
        self.encoded += len(pieces)
        return self.counted(pieces)

    def counted(self, pieces: list[str]) -> list[tuple[str, int]]:
        known = self.bpe.counts
        if len(known) > self.bpe.PIECES:
            known.clear()
        ranks = self.bpe.ranks
        for p in set(pieces).difference(known):
            piece = p.encode()
            known[p] = 1 if piece in ranks else len(self.bpe.walk(self.bpe.last_tokens(piece)))
        return list(zip(pieces, map(known.__getitem__, pieces), strict=True))

    def build(self, pieces: list[tuple[str, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            if leaf:
                texts, counts = zip(*leaf, strict=True)
                self.chars[self.size + i], self.tokens[self.size + i] = len("".join(texts)), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and its first character's place; the last leaf for the text's end."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and before + self.chars[node] < self.length:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def set_leaf(self, i: int, pieces: list[tuple[str, int]]) -> None:
        self.leaves[i] = pieces
        node = self.size + i
        self.chars[node] = sum(len(p) for p, _ in pieces)
        self.tokens[node] = sum(n for _, n in pieces)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces characters start to end (clipped to the text) and returns the new count."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        first, before = self.find(max(0, start - 1))
        last, _ = self.find(end)
        while first > 0 and (start - before < 1 or self.place(first, before, start) < CONTEXT):
            first -= 1
            before -= self.chars[self.size + first]
        old = [p for i in range(first, last + 1) for p in self.leaves[i]]
        keep = max(0, self.place(first, before, start) - CONTEXT) if first or before == 0 else 0
        left = sum(len(p) for p, _ in old[:keep])
        while True:
            text = "".join(p for p, _ in old)
            region = text[left : start - before] + new + text[end - before :]
            found, again = self.meet(region, old, start - before - left + len(new), len(text) - (end - before))
            if again is not None or last + 1 >= len(self.leaves):
                break
            last += 1
            old += self.leaves[last]
        self.encoded += len(found)
        fresh = old[:keep] + self.counted(found) + (old[again:] if again is not None else [])
        spread = last - first + 1
        share = -(-len(fresh) // spread)
        for k in range(spread):
            self.set_leaf(first + k, fresh[k * share : (k + 1) * share])
        if max(map(len, self.leaves[first : last + 1])) > 8 * LEAF:
            self.build([p for leaf in self.leaves for p in leaf])
        return self.count

    def place(self, leaf: int, before: int, at: int) -> int:
        """Pre-tokens of the leaves from `leaf` on, which begins at `before`, that end at or before `at`."""
        n = 0
        for i in range(leaf, len(self.leaves)):
            for p, _ in self.leaves[i]:
                before += len(p)
                if before > at:
                    return n
                n += 1
        return n

    def tail_cuts(self, old: list[tuple[str, int]], tail: int) -> dict[int, int]:
        """Where the old pre-tokens within the last `tail` characters begin, counted from the end -> their index."""
        out, back = {}, 0
        for i in range(len(old) - 1, -1, -1):
            back += len(old[i][0])
            if back > tail:
                break
            out[back] = i
        return out

    def meet(self, region: str, old: list[tuple[str, int]], edited: int, tail: int) -> tuple[list[str], int | None]:
        """New pre-tokens up to the first cut behind the edit that an old one shares, two pre-tokens in a row; and that one's index."""
        cuts, fresh, agreed = self.tail_cuts(old, tail), [], 0
        for m in self.bpe.pattern.finditer(region):
            if m.start() >= edited:
                i = cuts.get(len(region) - m.start())
                agreed = agreed + 1 if i is not None and old[i][0] == m[0] else 0
                if agreed == 2 and m.end() < len(region):
                    return fresh, i
            fresh.append(m[0])
        return fresh, None


EDITS = "array<struct<start:int,end:int,text:string>>"


def count_edited(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id_col, n_tokens, n_tokens_after, n_encoded, n_reencoded): counts before and after df's edits, applied in order.

    Places count code points of the text as it stands when the edit comes, and are clipped to it. n_encoded: pre-tokens
    of the first encoding; n_reencoded: of all edits. Null and empty texts count 0, null edits are none, null ids
    stay, repeated rows give repeated results, long texts are counted whole, an empty table gives no rows.
    """
    with open(ranks_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(data.value, pattern)
        with no_cycles(bpe.forget):
            for batch in batches:
                rows = []
                for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                    tree = CountTree(bpe, text or "")
                    before, encoded = tree.count, tree.encoded
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    rows.append((before, tree.count, encoded, tree.encoded - encoded))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
                yield record(id=batch.column("id"), n_tokens=cols[0], n_tokens_after=cols[1], n_encoded=cols[2], n_reencoded=cols[3])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(EDITS).alias("edits")), run, "id long, n_tokens long, n_tokens_after long, n_encoded long, n_reencoded long").withColumnRenamed("id", id_col)


TREES = "id long, text string, sizes array<int>, counts array<int>, n_tokens long, n_encoded long"


def trees(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, sizes, counts, n_tokens, n_encoded): each text with its pre-tokens' lengths and token counts, the
    leaves of its tree, to be written and edited later. Null texts are empty; else as count_edited()."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("sizes", "array<int>"), ("counts", "array<int>"), ("edits", EDITS))))
    return _trees(rows, ranks_path, pattern).withColumnRenamed("id", id_col)


def edit_trees(stored: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """The trees() of a frame with `edits` behind its columns, after these edits: texts, lengths and counts for the next
    time. n_encoded: the pre-tokens that were encoded for it; what no edit touches is never encoded again."""
    rows = stored.select(F.col(id_col).cast("long").alias("id"), "text", "sizes", "counts", F.col(edits_col).cast(EDITS).alias("edits"))
    return _trees(rows, ranks_path, pattern).withColumnRenamed("id", id_col)


def _trees(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    with open(ranks_path, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(data.value, pattern)
        with no_cycles(bpe.forget):
            for batch in batches:
                out = []
                for text, sizes, counts, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "sizes", "counts", "edits")), strict=True):
                    tree = CountTree(bpe, text or "", None if sizes is None else (sizes, counts))
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    out.append((tree.text(), *tree.stored(), tree.count, tree.encoded))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
                yield record(id=batch.column("id"), **{n: pa.array(c, k) for n, c, k in zip(("text", "sizes", "counts", "n_tokens", "n_encoded"), cols, kinds, strict=True)})

    return map_batches(rows, run, TREES)

"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over
all its segmentations into pieces, of the product of the pieces' probabilities (forward algorithm); a text's is the
product over its words. The pieces' probabilities are fitted by expectation maximisation over the same lattice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .bpe import load_ranks
from .util import map_batches, record

WORDS = re.compile(r"[^\W\d_]+")
#: Letters of a run that the fit takes together; a prediction sums over whole runs, however long.
FIT_LETTERS = 16
#: Words and letters of words whose scores a worker keeps.
CACHE, CACHE_LETTERS = 300_000, 10_000_000
#: Bytes of words whose segmentations are summed together.
BLOCK = 300_000
#: Steps after which probabilities are scaled, so that those of long words don't vanish.
SCALE = 16


def words_of(text: str) -> list[str]:
    found = WORDS.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numerals such as \u00bd match \w and are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


class Lattice:
    """A trie over the pieces, walked from all places of many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        used = sorted({c for p in pieces for c in p})
        self.classes = np.zeros(256, np.int32)  # 0: a byte that no piece has
        self.classes[used] = np.arange(1, len(used) + 1)
        nodes: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.step = np.full((len(nodes), len(used) + 1), -1, np.int32)
        for p, n in nodes.items():
            if p:
                self.step[nodes[p[:-1]], self.classes[p[-1]]] = n
        self.piece_at = np.full(len(nodes), -1, np.int32)
        for i, p in enumerate(pieces):
            self.piece_at[nodes[p]] = i

    def edges(self, words: list[str]) -> Edges:
        """Every piece at every place of the words, each with a space before it."""
        raw = [b" " + w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        codes = self.classes[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        begin = np.cumsum(sizes) - sizes
        at = np.arange(len(codes)) - begin[word]  # bytes of the word before this place
        place, node = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        src, dst, piece, ends = [], [], [], []
        for k in range(self.longest):
            node = self.step[node, codes[place + k]]
            go = node >= 0
            place, node = place[go], node[go]
            found = self.piece_at[node]
            hit = np.flatnonzero(found >= 0)
            cell = place[hit] + word[place[hit]]  # a word of n bytes has n + 1 cells
            src.append(cell)
            dst.append(cell + k + 1)
            piece.append(found[hit])
            ends.append(at[place[hit]] + k + 1)
            more = at[place] + k + 1 < sizes[word[place]]
            place, node = place[more], node[more]
            if not len(place):
                break
        src, dst, piece, ends = (np.concatenate(x) for x in (src, dst, piece, ends))
        order = np.lexsort((src, dst, ends))
        wide = int(sizes.max())
        return Edges(src[order], dst[order], piece[order], np.searchsorted(ends[order], np.arange(wide + 2)), begin + np.arange(len(raw)), sizes)

    def scores(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        out = np.empty((len(words), prob.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            upto, size = at, 0
            while upto < len(order) and (upto == at or size + len(words[order[upto]]) <= BLOCK):
                size += len(words[order[upto]]) + 1
                upto += 1
            part = order[at:upto]
            e = self.edges([words[i] for i in part])
            alpha, log = e.forward(prob, self.longest)
            last = alpha[e.begin + e.sizes]
            with np.errstate(divide="ignore"):
                out[part] = np.where(last > 0, np.log(last) + log, -1e300)
            at = upto
        return out


@dataclass
class Edges:
    """Pieces by the bytes from their word's begin to their end, then by the cell of their end."""

    src: np.ndarray
    dst: np.ndarray
    piece: np.ndarray
    #: Edges that end i bytes behind a word's begin: first[i] to first[i + 1].
    first: np.ndarray
    #: First cell and bytes of each word.
    begin: np.ndarray
    sizes: np.ndarray

    def forward(self, prob: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell and language the sum over all segmentations before it, scaled, and each word's log of the scale.

        What a word has behind the place of its last scaling, and the `longest` cells before it, has one scale.
        """
        alpha = np.zeros((int(self.begin[-1] + self.sizes[-1]) + 1, prob.shape[1]))
        alpha[self.begin] = 1
        log = np.zeros((len(self.begin), prob.shape[1]))
        for i in range(1, len(self.first) - 1):
            a, b = self.first[i], self.first[i + 1]
            if a == b:
                continue
            dst = self.dst[a:b]
            head = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            alpha[dst[head]] = np.add.reduceat(alpha[self.src[a:b]] * prob[self.piece[a:b]], head, axis=0)
            if i % SCALE == 0:
                word = np.flatnonzero(self.sizes > i)
                cells = (self.begin[word] + i)[:, None] - np.arange(min(longest, i + 1))
                most = alpha[cells].max(axis=1)
                most[most <= 0] = 1
                alpha[cells] /= most[:, None]
                log[word] += np.log(most)
        return alpha, log

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, counted `weight` times, over all segmentations (one language,
        words of FIT_LETTERS at most)."""
        cells = self.forward(p, int(self.sizes.max()) + 1)[0][:, 0]  # scaled whole: all cells of a word alike
        got = np.zeros(len(p))
        beta = np.zeros(len(cells))
        beta[self.begin + self.sizes] = 1
        total = np.maximum(cells[self.begin + self.sizes], 1e-300)
        share = np.zeros(len(cells))
        share[self.begin + self.sizes] = weight / total
        word = np.repeat(np.arange(len(self.begin)), self.sizes + 1)
        share = share[(self.begin + self.sizes)[word]]
        for i in range(len(self.first) - 2, 0, -1):
            a, b = self.first[i], self.first[i + 1]
            src, piece = self.src[a:b], self.piece[a:b]
            flow = beta[self.dst[a:b]] * p[piece, 0]
            got += np.bincount(piece, cells[src] * flow * share[src], len(p))
            beta[src] += flow  # a cell begins one piece of each length
        return got


def fit(train: DataFrame, pieces: list[bytes], per_language: int = 300, rounds: int = 3, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """The languages of train(lang, text) and P(piece | language), fitted on at most `per_language` rows of each.

    The rows are those with the smallest hashes of their texts, of 20 to 20,000 characters, so that the sample is
    bounded and repeatable; a language without such texts is fitted on its others, 20,000 characters of each; copies
    count once; null langs are left out. Runs of letters are taken FIT_LETTERS at a time. The counts are expected counts
    over all segmentations. The model has a column for each language that the labels name.
    """
    usual = F.col("text").isNotNull() & F.length("text").between(20, 20000)
    known = train.where("lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counted = known.groupBy("lang").agg(F.approx_count_distinct(F.when(usual, F.col("h"))).alias("usual"), F.approx_count_distinct(F.when(F.length("text") > 0, F.col("h"))).alias("any")).collect()
    counts = {r.lang: max(1, r.usual or r.any) for r in counted}
    odd = [r.lang for r in counted if not r.usual]
    if not counts:
        return [], np.zeros((len(pieces), 0))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * per_language / n))))[F.col("lang")]
    rows = known.where(usual | (F.col("lang").isin(odd) & (F.length("text") > 0))).withColumn("text", F.substring("text", 1, 20000))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30)).distinct()  # about four times the sample; the rest is never sorted, and copies are one row
    sample: dict[str, list[str]] = {}
    for r in near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "text"))).where(F.col("n") <= per_language).orderBy("lang", "n").select("lang", "text").collect():
        sample.setdefault(r.lang, []).append(r.text)
    langs = sorted(sample)
    prob = np.zeros((len(pieces), len(langs)))
    lattice = Lattice(pieces)
    for n, lang in enumerate(langs):
        found: Counter[str] = Counter()
        for text in sample[lang]:
            found.update(w[i : i + FIT_LETTERS] for w in words_of(text) for i in range(0, len(w), FIT_LETTERS))
        p = np.full((len(pieces), 1), 1.0 / len(pieces))
        words = sorted(found, key=lambda w: (len(w), w))
        parts = [(lattice.edges(words[at : at + 4096]), np.array([found[w] for w in words[at : at + 4096]], float)) for at in range(0, len(words), 4096)]
        for _ in range(rounds):
            got = np.full(len(pieces), alpha)
            for e, weight in parts:
                got += e.expected(p, weight)
            p[:, 0] = got / got.sum()
        prob[:, n] = p[:, 0]
    return langs, prob


def piece_list(ranks_path: str) -> list[bytes]:
    """The vocabulary's single bytes and its pieces of letters, with or without a space before them."""
    with open(ranks_path, "rb") as f:
        tokens = load_ranks(f.read())

    def letters(t: bytes) -> bool:
        try:
            s = t.decode()
        except UnicodeDecodeError:
            return False
        return s.removeprefix(" ").isalpha() and s == s.lower()

    return sorted(t for t in tokens if len(t) == 1 or letters(t))


_LATTICES: dict[int, Lattice] = {}


def predict(df: DataFrame, pieces: list[bytes], langs: list[str], prob: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id_col, lang_pred, score), or with `keep` all of df's columns and these two: the most probable language of every whole text and its posterior, row by row.

    A text that is null, empty or without letters gets `und` and 0; with no language learned every text does. At
    equal posteriors the first language by name wins. Null ids stay and repeated rows give repeated results; an empty
    table gives no rows. Long texts and long words are scored whole.
    """
    model = df.sparkSession.sparkContext.broadcast((pieces, langs, prob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, prob = model.value
        key = hash(tuple(pieces))
        if key not in _LATTICES:
            _LATTICES[key] = Lattice(pieces)
        lattice = _LATTICES[key]
        known: dict[str, int] = {}
        table, letters = np.zeros((0, len(langs))), 0
        for batch in batches:
            if len(known) > CACHE or letters > CACHE_LETTERS:
                known, table, letters = {}, np.zeros((0, len(langs))), 0
            rows, fresh = [], []
            for x in batch.column(text_col if keep else "text").to_pylist():
                own = words_of(x) if x and langs else []
                for w in own:
                    if w not in known:
                        known[w] = len(known)
                        fresh.append(w)
                        letters += len(w)
                rows.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
            if fresh:
                table = np.concatenate([table, lattice.scores(fresh, prob)])
            preds, scores = [], []
            for ids in rows:
                if not len(ids):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                like = table[ids].sum(axis=0)
                post = np.exp(like - like.max())
                best = int(post.argmax())
                preds.append(langs[best])
                scores.append(float(post[best] / post.sum()))
            more = {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64())}
            yield record(**dict(zip(batch.schema.names, batch.columns, strict=True)), **more) if keep else record(id=batch.column("id"), **more)

    if keep:
        return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of the fit: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))

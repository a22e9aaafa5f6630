"""Quality rules: plain base counts, then a linear-chain CRF that labels lines as content or boilerplate.

Viterbi decoding gives the best label sequence of a document's lines; the share of characters on content lines
decides whether a document that passes the base rules is kept.

The CRF is trained on lines, but labels are those of documents. A kept document's content, and a rejected one's
boilerplate, holds at least half of its characters; which lines these are is found in turns with the weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import SEPARATORS, map_batches, record

SYMBOLS = "#*$%&|<>"
FEATURES = 13
#: Documents of the sample that must have a word for the lexicon, and the most words it has.
LEXICON_DOCS, LEXICON_WORDS = 3, 20_000


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SEP, _SYM, _PUNCT = _bytes(SEPARATORS), _bytes(SYMBOLS), _bytes("!?:;,/\\=_{}[]()+@~^-")
_UPPER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_ODD_END = _bytes(SYMBOLS + "!=_{}[+@~^")


@dataclass
class Model:
    """Emission weights (boilerplate, content) by feature, transition weights, and what words say for content."""

    emit: np.ndarray
    move: np.ndarray
    lexicon: dict[bytes, float] = field(default_factory=dict)


#: Used where the labels name fewer than two kinds of documents: symbols, capitals, digits, marks and odd words speak
#: for boilerplate.
PRIOR = Model(np.array([[0, 0.5], [0, 1], [6, -6], [3, -3], [3, -3], [0, 0.5], [4, -4], [0, 0], [0.5, 0], [3, -3], [3, -3], [0, 0], [0, 0]], float), np.array([[1, -1], [-1, 1]], float))


@dataclass
class Lines:
    """All lines of all texts: their features, characters (bytes without separators), lines and word numbers of each text."""

    features: np.ndarray
    chars: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    words: np.ndarray


def line_features(texts: list[str], lexicon: dict[bytes, float]) -> Lines:
    sizes = np.array([t.count("\n") + 1 for t in texts], np.int64)
    joined = "".join(t + "\n" for t in texts).encode()
    raw = np.frombuffer(joined, np.uint8)
    number: dict[bytes, int] = {}
    codes = [np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words)) for words in (t.encode().split() for t in texts)]
    count = np.array([len(c) for c in codes], np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    add = lambda mask: np.add.reduceat(mask.astype(np.int64), starts) if len(starts) else starts.astype(np.int64)
    sep = _SEP[raw]
    chars = add(~sep)
    head = ~sep & np.r_[True, sep[:-1]] if len(raw) else sep
    words = add(head)
    per, per_word = np.maximum(chars, 1), np.maximum(words, 1)
    line = np.repeat(np.arange(len(ends)), words)  # of each word
    by_word = lambda values: np.bincount(line, values, len(ends))
    tail = np.flatnonzero(~sep & np.r_[sep[1:], True]) if len(raw) else ends
    said = np.array([lexicon.get(w.lower(), 0.0) for w in number])
    again = np.zeros(len(code), bool)
    if len(code):
        again[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    repeated = np.zeros(len(ends), bool)
    at = 0
    for t in texts:
        seen: set[str] = set()
        for x in t.split("\n"):
            repeated[at] = x in seen and bool(x)
            seen.add(x)
            at += 1
    f = np.ones((len(ends), FEATURES))
    f[:, 1] = np.minimum(np.log1p(words) / 4, 1.5)
    f[:, 2] = add(_SYM[raw]) / per
    f[:, 3] = np.maximum(add(_UPPER[raw]) / per - 0.2, 0)
    f[:, 4] = add(_DIGIT[raw]) / per
    f[:, 5] = raw[np.maximum(ends - 1, 0)] == 46 if len(ends) else ends
    f[:, 6] = add(_PUNCT[raw]) / per
    f[:, 7] = repeated
    f[:, 8] = words < 3
    f[:, 9] = by_word(_ODD_END[raw[tail]]) / per_word
    f[:, 10] = by_word(again) / per_word
    f[:, 11] = by_word(said[code]) / per_word if len(code) else 0
    f[:, 12] = np.minimum(chars / per_word / 10, 3)
    return Lines(f, chars, sizes, code, count)


def grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines, where each one's lines begin, and for step k how many texts have a line k."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right") if len(sizes) else np.zeros(0, int)
    return order, begin, alive


def viterbi(emit: np.ndarray, trans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best labels of all lines; all texts take step k together. At a tie content wins."""
    order, begin, alive = grid(sizes)
    best = np.zeros((len(sizes), 2))
    back = np.zeros((len(emit), 2), np.int8)
    for k, n in enumerate(alive):
        line = begin[:n] + k
        if k:
            options = best[:n, :, None] + trans[None]
            back[line] = np.where(options[:, 1] >= options[:, 0], 1, 0)
            best[:n] = options.max(axis=1) + emit[line]
        else:
            best[:n] = emit[line]
    labels = np.zeros(len(emit), np.int8)
    now = np.where(best[:, 1] >= best[:, 0], 1, 0)
    for k in range(len(alive) - 1, -1, -1):
        line = begin[: alive[k]] + k
        labels[line] = now[: alive[k]]
        now[: alive[k]] = back[line, now[: alive[k]]]
    return labels


def marginals(emit: np.ndarray, move: np.ndarray, shape: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's label probabilities by forward and backward sums; with labels, the gradient of the transitions as well."""
    _, begin, alive = shape
    a, b, gradient = np.zeros_like(emit), np.zeros_like(emit), np.zeros((2, 2))
    for k, n in enumerate(alive):
        line = begin[:n] + k
        a[line] = emit[line] + (np.logaddexp.reduce(a[line - 1][:, :, None] + move[None], axis=1) if k else 0)
    for k in range(len(alive) - 1, 0, -1):
        line = begin[: alive[k]] + k
        ahead = emit[line] + b[line]
        b[line - 1] = np.logaddexp.reduce(move[None] + ahead[:, None, :], axis=2)
        if y is not None:
            pair = a[line - 1][:, :, None] + move[None] + ahead[:, None, :]
            p = -np.exp(pair - np.logaddexp.reduce(pair.reshape(-1, 4), axis=1)[:, None, None])
            p[np.arange(len(line)), y[line - 1], y[line]] += 1
            gradient += (p * weight[line][:, None, None]).sum(axis=0)
    both = a + b
    return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]), gradient


def lexicon_of(texts: list[str], labels: list[int]) -> dict[bytes, float]:
    """Log odds for content of the words (lower case) of at least LEXICON_DOCS of the documents, one count for each,
    drawn towards none as if five more of either kind had them."""
    counts = (Counter(), Counter())
    for t, q in zip(texts, labels, strict=True):
        counts[q].update(set(t.encode().lower().split()))
    total = [max(1, sum(q == k for q in labels)) for k in (0, 1)]
    often = (counts[0] + counts[1]).most_common(LEXICON_WORDS)
    return {w: math.log((counts[1][w] + 5) / (total[1] + 10)) - math.log((counts[0][w] + 5) / (total[0] + 10)) for w, n in often if n >= LEXICON_DOCS}


def line_targets(p: np.ndarray, chars: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each line's label: the more probable one, but a document's own label for as many of the lines that speak most for
    it as hold half of its characters."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = labels[owner]
    y = (p[:, 1] >= 0.5).astype(np.int64)
    order = np.lexsort((-p[np.arange(len(p)), own], owner))
    held = np.cumsum(chars[order]) - chars[order]
    first = np.cumsum(sizes) - sizes
    before = held - held[first][owner]  # order keeps the owners in place
    total = np.bincount(owner, chars, len(sizes))[owner]
    bound = order[2 * before <= total]
    y[bound] = own[bound]
    return y


def fit_crf(texts: list[str], labels: list[int], turns: int = 4, rounds: int = 80, rate: float = 0.1, decay: float = 0.002) -> Model:
    """CRF weights by gradient ascent on the lines' likelihood, in turns with the lines' labels (line_targets()).

    At first, while lines have their documents' labels, each line is taken alone: the chain would learn that labels
    never change.

    With fewer than two kinds of documents the result is PRIOR.
    """
    if not texts or len(set(labels)) < 2:
        return PRIOR
    label = np.array(labels, np.int64)
    lexicon = lexicon_of(texts, labels)
    lines = line_features(texts, lexicon)
    f, sizes, shape = lines.features, lines.sizes, grid(lines.sizes)
    share = np.bincount(label, minlength=2) / len(label)
    weight = np.repeat(1.0 / (np.maximum(sizes, 1) * share[label] * 2), sizes) / len(label)
    y = np.repeat(label, sizes)
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    for turn in range(turns):
        first, second, step = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)], 0
        for _ in range(rounds):
            p, gt = marginals(f @ w, t, shape, y, weight)
            step += 1
            for k, (x, g) in enumerate(((w, f.T @ ((np.eye(2)[y] - p) * weight[:, None]) - decay * w), (t, gt * (turn > 0) - decay * t))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                x += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        y = line_targets(marginals(f @ w, t, shape)[0], lines.chars, sizes, label)
    return Model(w, t, lexicon)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = 400) -> Model:
    """A model fitted on at most `most` labelled documents of each quality: those of under 20,000 characters with the
    smallest id hashes. Of these, documents that fail the base rules are left out: the rules settle them anyway.

    They are looked for under the 4 * most labelled ids of each quality with the smallest hashes, so only a bounded
    list of ids is broadcast and only their documents' texts move. Null ids and null texts are no examples. Where a
    quality has no documents, or there are none at all, the model is PRIOR.
    """
    order = F.xxhash64(id_col)
    labelled = labels.where(F.col(id_col).isNotNull()).select(id_col, F.col("quality").alias("q")).distinct()
    first = [labelled.where(F.col("q") == q).orderBy(order, id_col).limit(4 * most) for q in (0, 1)]
    rows = docs.where("length(text) < 20000").select(id_col, "text").join(F.broadcast(first[0].union(first[1])), id_col)
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(order, "text"))).where(F.col("n") <= most)
    got = ranked.orderBy("q", "n").select("text", "q").collect()
    lines = line_features([r.text for r in got], {})
    passed = ~base_failed(lines.words, repeat_words(lines.codes, lines.words))
    got = [r for r, ok in zip(got, passed.tolist(), strict=True) if ok]
    return fit_crf([r.text for r in got], [r.q for r in got])


def repeat_words(codes: np.ndarray, sizes: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text, how many of its words stand in a window of `width` words that the text has twice or more.

    codes: word numbers of all texts in a row. Windows are ranked exactly, by doubling: pairs, fours, fives.
    """
    n, total = len(codes), len(sizes)
    ends = np.cumsum(sizes)
    if n < width:
        return np.zeros(total, np.int64)
    doc = np.repeat(np.arange(total), sizes)
    rank = codes.astype(np.int64)

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    twos = pair(rank[:-1], rank[1:])
    fours = pair(twos[:-2], twos[2:])
    fives = pair(fours[:-1], rank[4:])
    start = np.flatnonzero(np.arange(n - width + 1) + width <= ends[doc[: n - width + 1]])
    _, inverse, count = np.unique(doc[start] * (int(fives.max()) + 1 if len(fives) else 1) + fives[start], return_inverse=True, return_counts=True)
    twice = start[count[inverse] > 1]
    edge = np.zeros(n + 1, np.int32)
    edge[twice] += 1
    edge[twice + width] -= 1
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(doc[covered], minlength=total)


def content_lines(texts: list[str], model: Model) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The texts' lines, their best labels (1: content), and each text's share of characters on content lines."""
    lines = line_features(texts, model.lexicon)
    label = viterbi(lines.features @ model.emit, model.move, lines.sizes)
    owner = np.repeat(np.arange(len(texts)), lines.sizes)
    good = np.bincount(owner, lines.chars * (label == 1), len(texts))
    return lines, label, good / np.maximum(np.bincount(owner, lines.chars, len(texts)), 1)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """A row for every document: base counts, base_failed, lines by label, content_share and kept.

    Null and empty texts have no words, fail the base rules and are not kept. Null ids stay, repeated rows give
    repeated results, an empty table gives none; long texts are judged whole. content_share is 0 where no character is
    on a content line.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_WORDS words at most
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            lines, label, share = content_lines(texts, shared.value)
            chars = np.array([len(x) - sum(x.count(c) for c in SEPARATORS) for x in texts], np.int64)
            symbols = np.array([sum(x.count(c) for c in SYMBOLS) for x in texts], np.int64)
            dup = np.array([sum(n - 1 for line, n in Counter(x.split("\n")).items() if n > 1 and line.strip(SEPARATORS)) for x in texts], np.int64)
            repeat = repeat_words(lines.codes, lines.words)
            content = np.bincount(np.repeat(np.arange(len(texts)), lines.sizes)[label == 1], minlength=len(texts))
            failed = base_failed(lines.words, repeat)
            yield record(id=batch.column("id"), **dict(zip(names, (lines.words, chars, symbols, dup, repeat), strict=True)), base_failed=failed, content_lines=content, boilerplate_lines=lines.sizes - content, content_share=share, kept=~failed & (share >= least_share))

    schema = "id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, content_lines long, boilerplate_lines long, content_share double, kept boolean"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema).withColumnRenamed("id", id_col)

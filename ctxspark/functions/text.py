"""Column expressions for texts, hashes and numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """Words between white space, as str.split() gives them."""
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def token_count(c: str | Column) -> Column:
    return F.size(words(F.coalesce(col(c), F.lit("")))).cast("long")


def clamp(c: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def r6(c: str | Column) -> Column:
    return F.round(col(c).cast("double"), 6)


def document_id(path: str | Column, content: str | Column) -> Column:
    """The first 16 hex digits of the SHA-256 of path and content."""
    return F.substring(F.sha2(F.concat(col(path), col(content)), 256), 1, 16)


def chunk_id(doc: str | Column, index: str | Column) -> Column:
    return F.concat(col(doc).cast("string"), F.lit("-chunk-"), col(index).cast("string"))


def normalize_key(c: str | Column) -> Column:
    """Entity key: NFKC, case folded, runs of white space, hyphens and underscores as one underscore, none at the ends;
    null where nothing is left. Plain ASCII stays in the JVM, other texts are folded in Arrow batches."""
    text = col(c)
    folded = F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(_nfkc()(text))
    key = F.regexp_replace(F.regexp_replace(folded, r"(?U)[\s\-_]+", "_"), "^_+|_+$", "")
    return F.nullif(key, F.lit(""))


def _nfkc():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold


def keyword_overlap(query: str | Column, content: str | Column) -> Column:
    """Share of the query's distinct terms that the content has as substrings; 0 without terms."""
    terms = F.array_distinct(words(F.lower(col(query))))
    text = F.lower(col(content))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)).otherwise(F.lit(0.0))


def decode_bytes(raw: bytes) -> str:
    """UTF-8, else Latin-1, which never fails."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def json_of(c: str | Column) -> Column:
    """The JSON in a model's answer: what stands in a fence, else from the first bracket to the last; null if none."""
    text = col(c)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def head_and_tail(c: str | Column, limit: int) -> Column:
    """A text of more than `limit` words cut to its first and last ones, with a mark that says how many are left out."""
    w = words(F.coalesce(col(c), F.lit("")))
    head, tail = limit // 2, limit - limit // 2
    cut = F.concat(F.array_join(F.slice(w, 1, head), " "), F.lit("\n[... "), (F.size(w) - limit).cast("string"), F.lit(" tokens left out ...]\n"), F.array_join(F.slice(w, -tail, tail), " "))
    return F.when(F.size(w) > limit, cut).otherwise(col(c))


def part_text(kind: str | Column, content: str | Column, description: str | Column) -> Column:
    """A content part as text: text and tables as they are, of an image or another kind its description, else its kind."""
    said = F.concat(F.lit("["), col(kind), F.coalesce(F.concat(F.lit(": "), col(description)), F.lit("")), F.lit("]"))
    return F.when(col(kind).isin("text", "table", "code"), F.coalesce(col(content), F.lit(""))).otherwise(said)

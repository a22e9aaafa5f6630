"""Chunkers. Over white-space tokens the fixed chunkers are arithmetic; the others walk one text at a time in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

#: Where a definition begins, by language, and the language by a file's ending.
BOUNDARIES = {
    "python": r"^(?:def |class |async def )",
    "javascript": r"^(?:function |class |const \w+ = |export (?:default )?(?:function|class))",
    "typescript": r"^(?:function |class |const \w+ = |export (?:default )?(?:function|class))",
    "go": r"^func ",
    "rust": r"^(?:fn |impl |pub fn |pub impl )",
}
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust"}


def fixed(df: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, chunk_index, total_chunks, content): windows of `size` tokens that share `overlap`; ends with the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    w = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / step)).cast("int")
    out = w.withColumn("total_chunks", count).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    return out.select("id", F.col("chunk_index").cast("long"), F.col("total_chunks").cast("long"), F.array_join(F.slice("w", F.col("chunk_index") * step + 1, size), " ").alias("content"))


def parent_child(df: DataFrame, parent: int, child: int, overlap: int = 0, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Child chunks with the id and text of the parent chunk they come from."""
    parents = fixed(df, parent, 0, id_col, text_col).withColumn("parent_id", F.substring(F.sha2("content", 256), 1, 16))
    keyed = parents.select(F.struct(F.col("id").alias("doc"), F.col("chunk_index").alias("parent_index"), "parent_id").alias("id"), "content")
    kids = fixed(keyed, child, overlap)
    return kids.select("id.doc", "id.parent_index", "id.parent_id", F.col("chunk_index").alias("child_index"), "content")


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits on children (doc, parent_id, child_index, score) as their parents: each parent once a document, with the place
    and score of its first child and the parent's own text; a hit whose parent is gone keeps a null text."""
    first = hits.groupBy("doc", "parent_id").agg(F.min(F.struct("child_index", "score")).alias("f"))
    text = parents.select("doc", "parent_id", "content").dropDuplicates(["doc", "parent_id"])
    return first.select("doc", "parent_id", "f.child_index", "f.score").join(text, ["doc", "parent_id"], "left")


def sentences(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, n, sentence): cut behind . ! or ? before white space."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.trim(F.regexp_replace(text_col, r"([.!?])\s+", "$1\u0001")), "\u0001")).alias("n", "sentence")).where("sentence <> ''").select("id", F.col("n").cast("long"), "sentence")


Count = Callable[[str], int]


def count(text: str) -> int:
    return len(text.split())


def sentences_of(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def sentence_chunks(text: str, size: int = 512, overlap: int = 1, tokens: Count = count) -> list[str]:
    """Windows of whole sentences within size, each beginning `overlap` sentences before the end of the last; a sentence
    that is too long stands alone. Windows move on by one sentence at least, up to the last one."""
    every, out, at = sentences_of(text), [], 0
    while at < len(every):
        end = at + 1
        while end < len(every) and tokens(" ".join(every[at : end + 1])) <= size:
            end += 1
        out.append(" ".join(every[at:end]))
        at += max(1, end - at - overlap)
    return out


def fixed_chunks(text: str, size: int, overlap: int = 0) -> list[str]:
    """fixed() for one text."""
    w = text.split()
    return [" ".join(w[k : k + size]) for k in range(0, max(1, len(w) - overlap), size - overlap)] if w else []


def recursive_chunks(text: str, size: int = 384, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), overlap: int = 0, tokens: Count = count) -> list[str]:
    """Splits at the coarsest separator, packs neighbours while they fit, and goes on with the next one in what doesn't;
    what no separator splits is cut to size. With an overlap each chunk begins with that many of the last words of the
    one before, where that still fits."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    def parts(text: str, level: int) -> Iterator[str]:
        if tokens(text) <= size:
            yield text
        elif level == len(separators):
            yield " ".join(text.split()[:size])
        else:
            packed = ""
            for piece in text.split(separators[level]):
                joined = packed + separators[level] + piece if packed else piece
                if tokens(joined) <= size:
                    packed = joined
                    continue
                yield packed
                packed = ""
                if tokens(piece) <= size:
                    packed = piece
                else:
                    yield from parts(piece, level + 1)
            yield packed

    found = [c.strip() for c in parts(text, 0) if c.strip()]
    if not overlap:
        return found
    out = found[:1]
    for before, now in zip(found, found[1:], strict=False):
        tail, used = [], 0
        for w in reversed(before.split()):
            used += tokens(w)
            if used > overlap:
                break
            tail.insert(0, w)
        joined = " ".join([*tail, now])
        out.append(joined if tokens(joined) <= size else now)
    return out


def markdown_chunks(text: str, size: int = 512, tokens: Count = count) -> list[str]:
    """Sections by heading, each led by its path of headings."""
    out, path, body = [], [], []

    def close() -> None:
        inside = "\n".join(body).strip()
        for c in recursive_chunks(inside, size, tokens=tokens) if inside else []:
            out.append((" > ".join(h for _, h in path) + "\n" if path else "") + c)
        body.clear()

    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            close()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2].strip()))
        else:
            body.append(line)
    close()
    return out


def code_chunks(text: str, size: int = 512, language: str | None = "python", overlap: int = 50, tokens: Count = count) -> list[str]:
    """Whole definitions, neighbours packed while they fit; a longer one stays whole. Other languages, and texts without
    definitions, are split recursively."""
    starts = [m.start() for m in re.finditer(BOUNDARIES[language], text, re.M)] if language in BOUNDARIES else []
    if not starts:
        return recursive_chunks(text, size, overlap=min(overlap, size - 1), tokens=tokens)
    edges = sorted({0, *starts, len(text)})
    packed: list[str] = []
    for block in (text[a:b] for a, b in zip(edges, edges[1:], strict=False)):
        if not block.strip():
            continue
        if packed and tokens(packed[-1] + block) <= size:
            packed[-1] += block
        else:
            packed.append(block)
    return [c.strip() for c in packed]


def table_chunks(text: str, size: int = 512, tokens: Count = count) -> list[str]:
    """Markdown and HTML tables stay whole; a Markdown one that is too long is cut by rows with its header repeated, an
    HTML one by its rows. Other text is split recursively."""
    out, at = [], 0
    for m in re.finditer(r"(?is:<table[\s>].*?</table>)|(?:^\|.*\|[ \t]*(?:\n|\Z))+", text, re.M):
        out += recursive_chunks(text[at : m.start()], size, tokens=tokens)
        at, table = m.end(), m[0].strip()
        if tokens(table) <= size:
            out.append(table)
            continue
        html = not table.startswith("|")
        rows = re.findall(r"(?is)<tr[\s>].*?</tr>", table) or [table] if html else table.split("\n")
        head, now = ([], []) if html else (rows[:2], [])
        for r in rows[len(head) :]:
            if now and tokens("\n".join([*head, *now, r])) > size:
                out.append("\n".join([*head, *now]))
                now = []
            now.append(r)
        out += ["\n".join([*head, *now])] if now else []
    return out + recursive_chunks(text[at:], size, tokens=tokens)


def semantic_breaks(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df(id, n, sentence, vector) with `chunk`: a new one where neighbours' cosine falls under the threshold."""
    from pyspark.sql import Window as W

    from .retrieval import cosine

    w = W.partitionBy("id").orderBy("n")
    new = (cosine("vector", "before") < threshold).cast("int")
    return df.withColumn("before", F.lag("vector").over(w)).withColumn("chunk", F.sum(F.coalesce(new, F.lit(0))).over(w)).drop("before")


def semantic_groups(parts: list[str], size: int, least: int, tokens: Count = count) -> list[str]:
    """Parts of a text between its breaks as chunks: all in one if that fits; else a part joins the one before where
    either is under `least`, and what is over size is cut into fixed chunks."""
    whole = " ".join(parts)
    if tokens(whole) <= size:
        return [whole] if whole else []
    merged: list[str] = []
    for p in parts:
        if merged and least > 0 and min(tokens(merged[-1]), tokens(p)) < least:
            merged[-1] += " " + p
        else:
            merged.append(p)
    return [c for m in merged for c in ([m] if tokens(m) <= size else fixed_chunks(m, size))]


def semantic(df: DataFrame, threshold: float = 0.5, size: int = 512, least: int = 50) -> DataFrame:
    """(id, chunk_index, content) of df(id, n, sentence, vector): semantic_breaks() and semantic_groups() of each text."""
    parts = semantic_breaks(df, threshold).groupBy("id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), " ").alias("part"))
    texts = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda s: s["part"]).alias("parts"))
    return split_texts(texts, lambda p: semantic_groups(p or [], size, least), text_col="parts")


def split_texts(df: DataFrame, chunker: Callable, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, chunk_index, content): any function from a text (null: empty) to chunks, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True) for n, c in enumerate(chunker(t or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "chunk_index", "content"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, chunk_index long, content string")

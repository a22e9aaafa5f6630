"""Chat formatting with typed content parts.

A visitor walks a turn's parts and flattens them into text and ordered placeholders, noting each attachment's
reference and how many tokens its placeholder stands for. Control strings inside texts are escaped reversibly:
a backslash is doubled, and <| becomes <\\|; only the template itself writes <| .
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_batches, record

PARTS = "array<struct<type:string,text:string,ref:string,amount:double>>"
FORMATTED = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,at:int,tokens:int>>, attachment_tokens int"
START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPED = re.compile(r"\\([\\|n])")
TURN = re.compile(r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n")
PLACEHOLDER = re.compile(r"<\|([a-z]+):(\d+)\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class PartVisitor:
    """Flattens parts in order. One visit method a type; an unknown type is text."""

    #: Tokens: an image's by tiles of its amount (megapixels), audio by seconds, a document by pages.
    IMAGE_TILE, IMAGE_BASE, AUDIO_SECOND, DOCUMENT_PAGE = 170, 85, 25, 600

    def __init__(self):
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def write(self, text: str) -> None:
        if not text:
            return
        self.out.append(text)
        self.size += len(text)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        joined = self.out and self.out[-1].endswith("<") and text.startswith("|")  # two parts must not make a control string
        self.write("\\" + text if joined else text)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self.write(f"<|{kind}:{len(self.attachments)}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.IMAGE_BASE + self.IMAGE_TILE * max(1, round((part.get("amount") or 0) * 4)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.AUDIO_SECOND * max(1, round(part.get("amount") or 0)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.DOCUMENT_PAGE * max(1, round(part.get("amount") or 0)))


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """A turn's text, and its loss span: an assistant's content, in code points of that text."""
    visitor = PartVisitor()
    head = START + escape(role).replace("\n", "\\n") + "\n"  # a role with a line break keeps its turn readable
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (len(head), len(head))
    return head + body + END, *span, [a | {"at": a["at"] + len(head)} for a in visitor.attachments]


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, unescaped; placeholders stay in the text."""
    return [(unescape(role), unescape(body)) for role, body in TURN.findall(formatted)]


def read_parts(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of every turn: text parts unescaped, and (kind, number) of every attachment's placeholder. A text
    that looks like a placeholder was escaped, so it comes back as the text it is; empty texts are left out."""
    out = []
    for role, body in TURN.findall(formatted):
        parts, at = [], 0
        for m in PLACEHOLDER.finditer(body):
            parts += [("text", unescape(body[at : m.start()]))] * (m.start() > at) + [(m[1], m[2])]
            at = m.end()
        parts += [("text", unescape(body[at:]))] * (at < len(body))
        out.append((unescape(role), parts))
    return out


def text_parts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `parts`: its text as the only part; null is empty."""
    return df.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"))))


def format_turns(df: DataFrame) -> DataFrame:
    """Each row of df(conv_id, turn, role, parts) formatted on its own, without a shuffle.

    A conversation is its turns' texts joined in order. Null roles are empty, null parts none.
    Repeated rows and equal turn numbers are formatted alike; long texts are formatted whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [format_turn(role or "", parts or []) for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))
            yield record(conv_id=batch.column("conv_id"), turn=batch.column("turn"), role=batch.column("role"), formatted=pa.array([r[0] for r in rows], pa.string()), loss_start=pa.array([r[1] for r in rows], pa.int32()), loss_end=pa.array([r[2] for r in rows], pa.int32()), attachments=pa.array([r[3] for r in rows], kind), attachment_tokens=pa.array([sum(a["tokens"] for a in r[3]) for r in rows], pa.int32()))

    return map_batches(df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS)), run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its formatted turns: counts and running digests.

    Turns are sorted within partitions and streamed, so a conversation of any length takes constant memory; a
    digest over all its turns is sequential by nature. Order: turn (nulls first), then the formatted text. Null
    conversations are one conversation; repeated rows are turns of their own; an empty table gives no rows.
    """
    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, now, turns, loss, counts = object(), None, None, None, None
        now = none
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        def close() -> None:
            if now is not none:
                done.append((now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is none or conv != now:
                    close()
                    now, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, body in read_back(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    counts[0] += 1
                learned = unescape(text[a:b])
                loss.update(learned.encode())
                counts[1] += len(learned)
                counts[2] += len(text)
            if len(done) > 500:
                yield flush()
        close()
        yield flush()

    return map_batches(ordered, run, schema)

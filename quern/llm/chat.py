"""Chat formatting with typed content parts.

A visitor walks the parts of each turn and flattens them, in order, into text and placeholders: texts are escaped,
images, audio and documents become a placeholder, an attachment reference and a number of tokens that the placeholder
stands for. Turns are marked by control strings; any control string inside a text, role or reference gets an escape
mark behind its first character (one more, if it bears some already), so that parsing gives back the very texts.

Template of a turn: `<|turn|>role<|says|>content<|end|>` and a line feed. The loss mask covers the texts of
assistant turns.

Defined results: a null text is empty, a null role is the empty role; rows are ordered by turn (nulls first), then
role, then text, so repeated rows each count as a turn; rows with a null conv_id form one conversation; an empty table
gives an empty result. Other columns are ignored. A part of an unknown type becomes an attachment of that kind
without tokens; what lacks in a part is empty or 0, a negative size counts as 0.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import encoded, partitions

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
IMAGE, AUDIO, DOCUMENT, OTHER = "<|image|>", "<|audio|>", "<|document|>", "<|attachment|>"
#: Control strings of this and of common other templates.
CONTROL = (
    TURN, SAYS, END, IMAGE, AUDIO, DOCUMENT, OTHER, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>",
    "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>",
)
MARK = "\\"
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_HIDE = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_SHOW = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")


def escape(text: str) -> str:
    return _HIDE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1\2", text)


@dataclass(frozen=True)
class TextPart:
    text: str


@dataclass(frozen=True)
class ImagePart:
    uri: str
    width: int
    height: int


@dataclass(frozen=True)
class AudioPart:
    uri: str
    seconds: float


@dataclass(frozen=True)
class DocumentPart:
    uri: str
    pages: int


@dataclass(frozen=True)
class OtherPart:
    kind: str
    uri: str


Part = TextPart | ImagePart | AudioPart | DocumentPart | OtherPart


def part_of(raw: dict | None) -> Part:
    """A typed part from a row of array<struct<type, text, uri, width, height, seconds, pages>>."""
    raw = raw or {}
    kind, uri = raw.get("type") or "text", raw.get("uri") or ""
    number = lambda name: max(0, raw.get(name) or 0)
    if kind == "text":
        return TextPart(raw.get("text") or "")
    if kind == "image":
        return ImagePart(uri, int(number("width")), int(number("height")))
    if kind == "audio":
        return AudioPart(uri, float(number("seconds")))
    if kind == "document":
        return DocumentPart(uri, int(number("pages")))
    return OtherPart(kind, uri)


@dataclass
class Flattener:
    """Visits parts in order; what it has gathered is the content, the attachments and the expanded token count.

    Texts are held back until an attachment or the end: neighbouring ones are escaped as one, so no control string can arise
    where they meet.
    """

    patch: int = 14  # pixels a side that an image token covers, after merging 2 x 2
    per_second: float = 25.0
    per_page: int = 256
    held: list[str] = field(default_factory=list)
    content: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part: Part) -> None:
        getattr(self, f"visit_{type(part).__name__}")(part)

    def visit_TextPart(self, part: TextPart) -> None:  # noqa: N802
        self.held.append(part.text)

    def _flush(self) -> None:
        self.content.append(escape("".join(self.held)))
        self.held.clear()

    def _attach(self, kind: str, placeholder: str, uri: str, tokens: int) -> None:
        self._flush()
        self.attachments.append((kind, uri, tokens))
        self.content.append(placeholder)

    def visit_ImagePart(self, part: ImagePart) -> None:  # noqa: N802
        side = 2 * self.patch
        self._attach("image", IMAGE, part.uri, math.ceil(part.width / side) * math.ceil(part.height / side))

    def visit_AudioPart(self, part: AudioPart) -> None:  # noqa: N802
        self._attach("audio", AUDIO, part.uri, math.ceil(part.seconds * self.per_second))

    def visit_DocumentPart(self, part: DocumentPart) -> None:  # noqa: N802
        self._attach("document", DOCUMENT, part.uri, part.pages * self.per_page)

    def visit_OtherPart(self, part: OtherPart) -> None:  # noqa: N802
        self._attach(part.kind, OTHER, part.uri, 0)

    def finish(self) -> str:
        self._flush()
        return "".join(self.content)


def flatten(parts: list, flattener: Flattener | None = None) -> tuple[str, list[tuple[str, str, int]]]:
    """Escaped content with placeholders, and attachments (kind, uri, tokens) in the order of their placeholders."""
    visitor = flattener or Flattener()
    for part in parts:
        visitor.visit(part)
    return visitor.finish(), visitor.attachments


def formatted(turns: list[tuple[str, list]]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int]]]:
    """The text of a conversation (role, parts), the spans under the loss mask, all attachments."""
    out, spans, attachments, at = [], [], [], 0
    for role, parts in turns:
        head = f"{TURN}{escape(role)}{SAYS}"
        content, own = flatten(parts)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(content)))
        out += [head, content, END + "\n"]
        at += len(head) + len(content) + len(END) + 1
        attachments += own
    return "".join(out), spans, attachments


_PARSE = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}\n", re.DOTALL)
_PLACEHOLDER = re.compile("|".join(map(re.escape, (IMAGE, AUDIO, DOCUMENT, OTHER))))


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back; placeholders stay out of the texts."""
    return [(unescape(role), "".join(map(unescape, _PLACEHOLDER.split(content)))) for role, content in _PARSE.findall(text)]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped, nothing between the turns."""
    return "".join("".join(map(unescape, _PLACEHOLDER.split(text[a:b]))) for a, b in spans)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, text, spans, n_turns, attachments, expanded_tokens: one row a conversation.

    `rows` has conv_id, turn, role and text or, instead of it, parts (array of structs). Conversations are streamed in order
    through each task; memory holds one conversation and one batch.
    """
    typed = "parts" in rows.columns
    body = F.to_json("parts") if typed else F.coalesce("text", F.lit(""))
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), body.alias("body"))
    ordered = slim.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "body")
    names = ["conv_id", "text", "spans", "n_turns", "attachments", "expanded_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def one(conv_id, turns):
            text, spans, attachments = formatted(turns)
            return (conv_id, text, [list(s) for s in spans], len(turns), [{"kind": k, "uri": u, "tokens": n} for k, u, n in attachments], sum(a[2] for a in attachments))

        frame = lambda out: pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        key, turns, out, chars = "none", [], [], 0
        for pdf in batches:
            for conv_id, role, text in zip(pdf["conv_id"], pdf["role"], pdf["body"]):
                own = None if pd.isna(conv_id) else int(conv_id)
                if own != key:
                    if turns:
                        out.append(one(key, turns))
                    key, turns = own, []
                    if len(out) >= 1000 or chars > 8_000_000:
                        yield frame(out)
                        out, chars = [], 0
                turns.append((role, [part_of(p) for p in json.loads(text or "[]")] if typed else [TextPart(text)]))
                chars += len(text or "")
        if turns:
            out.append(one(key, turns))
        yield frame(out)

    return ordered.mapInPandas(run, "conv_id long, text string, spans array<array<long>>, n_turns long, attachments array<struct<kind: string, uri: string, tokens: long>>, expanded_tokens long")


def digests(formatted_rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv_id, text, spans in zip(pdf["conv_id"], pdf["text"], pdf["spans"]):
                turns, loss = parsed(text), masked(text, [tuple(s) for s in spans])
                every = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv_id, len(turns), hashlib.sha256(encoded(every)).hexdigest(), len(loss), hashlib.sha256(encoded(loss)).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted_rows.select("conv_id", "text", "spans").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(conversations(rows.unionByName(more)))


def oracle_sql() -> str:
    """The same digests by SQL; an escape adds one character for each control string."""
    pattern = (r"[<\[]\\*(?:" + _RESTS + ")").replace("'", "''")
    hidden = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{pattern}'))"
    said = "'</s>[INST] ok [/INST]'"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum({hidden('role')} + {hidden('text')} + {len(TURN) + len(SAYS) + len(END) + 1}) AS chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

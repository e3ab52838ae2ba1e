"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor walks them in order; a
text part gives its escaped text, any other part a placeholder with a running number, a record of the
attachment it refers to and the number of tokens the placeholder expands to. A turn is written

    <|im_start|>role newline content <|im_end|> newline

Control strings begin with ``<|``. Inside texts a backslash is doubled and ``<|`` becomes ``<\\|``; in
roles a newline becomes ``\\n`` as well. So no text can hold a control string or a placeholder, and reading gives back
every text exactly, and where between them the attachments stood (``parse_parts``; neighbouring texts come back as one,
empty ones not at all). The loss mask covers the content of assistant turns, without placeholders.

Output is one row per turn, in order of conversation and turn, each a segment of the conversation's
formatted text: memory is bounded by a turn, and a conversation of any length is a run of rows.
Formatting is row by row, wherever the rows are. ``read_back`` parses segments and streams digests through rows sorted by
conversation, so it holds one turn at a time; a digest over a conversation is sequential, so one of a third of all rows is
read back by one task, in bounded memory. Turns of the same number are ordered by role and text (a null role before
an empty one), placeholders standing as they are written.

Defined results: a null text is empty, a null role is empty, a null list of parts has no parts, null
conversation ids are one conversation, a null turn stands before others; repeated rows are turns of
their own; an empty table gives an empty result; other columns are ignored. ``conversations_digest`` has a row of its own for
stored turns with conversation id -1, beside that of the control conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brindle.llm.common import in_batches

START, END = "<|im_start|>", "<|im_end|>"
PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<index:int,type:string,ref:string,tokens:bigint>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")
_SEGMENT = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class Flattener:
    """Visits the parts of one turn; ``pieces`` are what is written, ``attachments`` what they refer to."""

    def __init__(self):
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        method(part or {})

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part.get(k) or 0) / PATCH)) for k in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part.get("pages") or 0) * TOKENS_PER_PAGE)

    def _attach(self, part: dict, tokens: int) -> None:
        index = len(self.attachments)
        self.pieces.append(f"<|{part['type']}:{index}|>")
        self.attachments.append({"index": index, "type": part["type"], "ref": part.get("ref"), "tokens": tokens})


def format_turns(turns: DataFrame, more_keys: tuple[str, ...] = ()) -> DataFrame:
    """From conv_id, turn, role, parts: conv_id, turn, role, ``more_keys``, segment, loss_start, loss_end (code points of the
    segment under the mask, equal where there are none), attachments and expanded_tokens."""
    n = 3 + len(more_keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
        )
        for batch in it:
            segments, starts, ends, attached, tokens = [], [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(n).to_pylist(), strict=True):
                visitor = Flattener()
                for part in parts or []:
                    visitor.visit(part)
                head, content = f"{START}{escape_role(role or '')}\n", "".join(visitor.pieces)
                segments.append(f"{head}{content}{END}\n")
                starts.append(len(head) if role == "assistant" else 0)
                ends.append(len(head) + len(content) if role == "assistant" else 0)
                attached.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            columns = [
                pa.array(segments, pa.string()),
                pa.array(starts, pa.int64()),
                pa.array(ends, pa.int64()),
                pa.array(attached, kind),
                pa.array(tokens, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names=schema.names)

    parts = F.col("parts").cast(f"array<{PART}>").alias("parts")
    picked = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), *more_keys, parts)
    more = f"segment string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>, expanded_tokens long"
    schema = T.StructType([*picked.drop("parts").schema.fields, *T._parse_datatype_string(more).fields])
    return in_batches(picked, batches, schema)


def text_turns(conversations: DataFrame, more_keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of plain text as turns with one text part."""
    part = F.expr(
        f"CAST(array(named_struct('type', 'text', 'text', coalesce(CAST(text AS STRING), ''), 'ref', NULL, "
        f"'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', NULL)) AS array<{PART}>)"
    )
    return conversations.select("conv_id", "turn", "role", *more_keys, part.alias("parts"))


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment; placeholders of attachments stand in the text as they are."""
    role, content = _cut(segment)
    return unescape_role(role), unescape(content)


def _cut(segment: str) -> tuple[str, str]:
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    return found[1], found[2]


def parse_parts(segment: str, attachments: list[dict]) -> tuple[str, list[dict]]:
    """Role and parts of a segment: texts as {type, text}, attachments as their records. What is written as a text never
    reads as a placeholder, as the escape parts its ``<|``."""
    role, content = _cut(segment)
    by_index, parts, at = {a["index"]: a for a in attachments}, [], 0
    for mark in _PLACEHOLDER.finditer(content):
        if mark.start() > at:
            parts.append({"type": "text", "text": unescape(content[at : mark.start()])})
        record = by_index.get(int(mark[2]))
        if record is None or record["type"] != mark[1]:
            raise ValueError(f"no attachment is recorded for {mark[0]}")
        parts.append(record)
        at = mark.end()
    if at < len(content):
        parts.append({"type": "text", "text": unescape(content[at:])})
    return unescape_role(role), parts


def _order() -> list:
    """Turns in order; role and text are compared only where turns have the same number."""
    content = F.expr(f"substring(segment, instr(segment, '\n') + 1, char_length(segment) - instr(segment, '\n') - {len(END) + 1})")
    return ["turn", "role", F.regexp_replace(content, r"(?s)\\(.)", "$1"), "segment"]


def read_back(formatted: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Per conversation (``keys``), from the segments and records alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_attachments, expanded_tokens."""

    n = len(keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:n] != now:
                    if state is not None:
                        done.append((*now, *state.finish()))
                    now, state = row[:n], _Digest()
                state.add(*row[n:])
            if done:
                yield rows(done)
                done = []
        if state is not None:
            yield rows([(*now, *state.finish())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    more = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    schema = T.StructType([*(formatted.schema[k] for k in keys), *T._parse_datatype_string(more).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    dealt = formatted.repartition(*keys).sortWithinPartitions(*keys, *_order())
    return in_batches(dealt.select(*keys, "segment", "loss_start", "loss_end", F.size("attachments"), "expanded_tokens"), batches, schema)


class _Digest:
    """What is read back of a conversation, turn by turn."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.expanded_tokens = 0

    def add(self, segment: str, start: int, end: int, n_attachments: int, expanded_tokens: int) -> None:
        role, text = parse(segment)
        masked = segment[start:end]
        masked = unescape(_PLACEHOLDER.sub("", masked) if n_attachments else masked)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(masked.encode())
        self.n_turns += 1
        self.loss_chars += len(masked)
        self.formatted_chars += len(segment)
        self.n_attachments += n_attachments
        self.expanded_tokens += expanded_tokens

    def finish(self) -> tuple:
        digests = self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars
        return *digests, self.n_attachments, self.expanded_tokens


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def conversations_digest(conversations: DataFrame) -> DataFrame:
    """read_back of all formatted conversations and of conversation -1, whose texts hold control strings."""
    spark = conversations.sparkSession
    own = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("control", F.lit(False)).unionByName(own.withColumn("control", F.lit(True)))
    return read_back(format_turns(text_turns(rows, ("control",)), ("control",)), ("conv_id", "control")).drop("control")


_TURNS = "string_agg({what}, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)"
_ESCAPES = "+ len({c}) - len(replace({c}, chr(92), '')) + (len({c}) - len(replace({c}, '<|', ''))) / 2"
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, false AS control FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}', true UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}', true),
t AS (SELECT *, coalesce(role, '') AS r, CASE WHEN role = 'assistant' THEN text END AS a FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256({_TURNS.format(what="r || chr(10) || text || chr(10)")}) AS turns_sha256,
       CAST(coalesce(sum(len(a)), 0) AS BIGINT) AS loss_chars, sha256(coalesce({_TURNS.format(what="a")}, '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 2} + len(text) + len(r) + len(r) - len(replace(r, chr(10), ''))
            {_ESCAPES.format(c="text")} {_ESCAPES.format(c="r")}) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id, control
"""

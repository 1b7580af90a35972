"""Chat formatting: typed content parts become one marked-up text with a loss mask.

A visitor flattens the parts of a message (text, image, audio, document) in
order: text is escaped, every other part leaves a numbered placeholder and a
record of what it refers to and how many tokens it expands to.  Messages are
formatted where they lie, without a shuffle; a conversation is then read in
order as a stream, so its size is bounded by the disk, not by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<s>", "[/ROLE]\n", "</s>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<placeholder:string,kind:string,ref:string,tokens:bigint>"
#: Tokens that a placeholder stands for: image patches of 28 x 28 pixels, 25 audio frames a second, 1,024 for each page.
PATCH, FRAMES, PAGE = 28, 25, 1024

_ESCAPED = re.compile(r"\\\\|([<\[])\\")


def escape(text: str) -> str:
    """Break every string that could be read as control: ``<`` and ``[`` get a backslash after them, backslashes are doubled."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        sides = [-(-max(part.get(side) or 1, 1) // PATCH) for side in ("width", "height")]
        self._attach("image", part, sides[0] * sides[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        mark = f"<{kind}:{len(self.attachments) + 1}>"
        self.pieces.append(mark)
        self.attachments.append({"placeholder": mark, "kind": part.get("kind"), "ref": part.get("ref"), "tokens": tokens})


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, messages = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts, starts, ends, attachments, tokens = [], [], [], [], []
        for role, parts in zip(roles, messages):
            flat = Flattener()
            for part in parts or []:
                flat.visit(part)
            head, body = OPEN + escape(role or "") + HEAD, "".join(flat.pieces)
            loss = role == "assistant"
            starts.append(len(head) if loss else 0)
            ends.append(len(head) + len(body) if loss else 0)
            texts.append(head + body + CLOSE)
            attachments.append(flat.attachments)
            tokens.append(sum(a["tokens"] for a in flat.attachments))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
            pa.array(attachments, pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), pa.array(tokens, pa.int64()),
        ], ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])


def text_part(text: Column) -> Column:
    """A message of one text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text")).cast("struct<kind:string,text:string>")).cast("array<struct<kind:string,text:string>>")


def typed(parts: Column) -> Column:
    """Parts with every field of ``PART``, whichever they come with."""
    return F.from_json(F.to_json(parts), f"array<{PART}>")


def format_turns(messages: DataFrame) -> DataFrame:
    """One formatted segment for each row of (conv_id, turn, role, parts).

    formatted, loss_start and loss_end (code points within the segment; both 0
    where no loss is taken), attachments in order, expanded_tokens.  A null
    role is empty, null parts or texts are empty, unknown kinds become
    ``<other:n>`` of one token; rows are never merged.
    """
    schema = f"conv_id bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint, attachments array<{ATTACHMENT}>, expanded_tokens bigint"
    return messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), "parts").mapInArrow(_format, schema)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a segment of one text part."""
    head, _, body = segment.removeprefix(OPEN).partition(HEAD)
    return unescape(head), unescape(body.removesuffix(CLOSE))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row(conv, n, turns, chars, loss, total):
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)

    state = None
    for batch in batches:
        done = []
        for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row(*state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = read_turn(text)
            state[1] += 1
            state[2].update(f"{role}\n{said}\n".encode())
            learnt = unescape(text[start:end])
            state[3] += len(learnt)
            state[4].update(learnt.encode())
            state[5] += len(text)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 6, kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(*state), kinds)], names)


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted turns.

    Turns go by number, nulls first, then by formatted text; repeated rows stay
    repeated.  Rows with a null conv_id form one conversation.  A digest of a
    whole conversation is sequential, so its turns pass one task, streamed.
    """
    messages = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    ordered = format_turns(messages).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(16 + length(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\')) + length(replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\')))::bigint as formatted_chars
from said group by conv_id
"""

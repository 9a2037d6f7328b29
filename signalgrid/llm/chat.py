"""Chat formatting with typed content parts, reversible escapes and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalgrid.llm.common import lean

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Strings that this template or others give a meaning; none may stand in a text as it is.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 1_024

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = ("conv_id long, turn long, formatted string, loss array<struct<begin:int,end:int>>, "
           "attachments array<struct<placeholder:string,kind:string,uri:string,tokens:long>>, "
           "expanded_tokens long")

_ESCAPES = re.compile("|".join(map(re.escape, (ESCAPE, *sorted(CONTROL, key=len, reverse=True)))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_MESSAGE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document) \d+\|>")


def escape(text: str) -> str:
    """Put a backslash inside every control string and double every backslash."""
    return _ESCAPES.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if text:
            self.spans.append((self.size, self.size + len(text)))
            self._add(text)

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(part.get(side) or 0, 0) / PATCH) for side in ("width", "height"))
        self._attach("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        good = math.isfinite(seconds) and seconds > 0
        self._attach("audio", part, max(1, math.ceil(seconds * AUDIO_TOKENS_A_SECOND)) if good else 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * TOKENS_A_PAGE)

    def visit_unknown(self, part: dict) -> None:
        self.visit_text(part)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        placeholder = f"<|{kind} {len(self.attachments) + 1}|>"
        self.attachments.append(
            {"placeholder": placeholder, "kind": kind, "uri": part.get("uri"), "tokens": tokens})
        self._add(placeholder)

    def _add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def format_message(role: str | None, parts: list[dict], learn: tuple[str, ...] = ("assistant",)) -> dict:
    """One message as text, with the spans to learn (in code points) and its attachments."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = TURN + escape(role or "") + TEXT
    spans = [{"begin": len(head) + a, "end": len(head) + b} for a, b in flat.spans] if role in learn else []
    return {"formatted": head + "".join(flat.pieces) + END, "loss": spans,
            "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def read_messages(formatted: str) -> list[tuple[str, list[str]]]:
    """Roles and contents back from formatted text; contents alternate text and placeholders."""
    out = []
    for m in _MESSAGE.finditer(formatted):
        content, at, parts = m[2], 0, []
        for p in _PLACEHOLDER.finditer(content):
            parts += [unescape(content[at:p.start()]), p[0]]
            at = p.end()
        out.append((unescape(m[1]), [*parts, unescape(content[at:])]))
    return out


def format_turns(messages: DataFrame) -> DataFrame:
    """A formatted segment for each message; a conversation is its segments in order of ``turn``.

    ``messages`` has conv_id, turn, role and text, and may have ``parts``, an array of typed
    parts (PART) that comes before the text. Null roles and texts are empty, null parts are left
    out, a part of unknown kind counts by its text. Other columns are ignored. There is no
    shuffle, and no conversation is ever held as a whole.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in messages.columns else F.lit(None).cast(f"array<{PART}>")
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", parts.alias("parts"))

    @lean
    def task(batches):
        for batch in batches:
            made = []
            for role, text, more in zip(*(batch[c].to_pylist() for c in ("role", "text", "parts"))):
                made.append(format_message(role, [*(p for p in more or () if p), {"text": text}]))
            columns = {"conv_id": batch["conv_id"], "turn": batch["turn"]}
            kinds = {"formatted": pa.string(),
                     "loss": pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])),
                     "attachments": pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()),
                                                        ("uri", pa.string()), ("tokens", pa.int64())])),
                     "expanded_tokens": pa.int64()}
            columns |= {k: pa.array([m[k] for m in made], kind) for k, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(task, SEGMENT)


class _Conversation:
    """Running digests of one conversation; its size does not grow with the turns."""

    def __init__(self):
        self.turns = self.loss_chars = self.formatted = self.tokens = self.attachments = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict], attachments: list[dict], tokens: int) -> None:
        for role, parts in read_messages(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{''.join(parts)}\n".encode())
        for span in loss:
            text = unescape(formatted[span["begin"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted += len(formatted)
        self.tokens += tokens
        self.attachments += len(attachments)

    def row(self) -> tuple:
        return (self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted, self.attachments, self.tokens)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed back from its formatted segments.

    Segments go by turn, nulls first; of equal turns, by their formatted text. They stream
    through running digests, so a conversation of any length needs no more memory than a turn.
    Segments with a null conv_id are one conversation.
    """
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
             "n_attachments", "expanded_tokens")

    @lean
    def task(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for conv, *rest in zip(*(batch[c].to_pylist() for c in (
                    "conv_id", "formatted", "loss", "attachments", "expanded_tokens"))):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = conv, _Conversation()
                state.add(*rest)
            if done:
                yield _rows(done)
        if state is not None:
            yield _rows([(now, *state.row())])

    def _rows(done):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["conv_id", *names])

    return (segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
            .mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                              "loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"))

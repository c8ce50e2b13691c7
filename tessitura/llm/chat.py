"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and
roles get a backslash after their first character, and lose it again when read back. The rendered text is encoded once,
with offsets; the sorted spans of assistant texts are intersected with the sorted token spans by binary search. A token
that reaches over a span's edge is masked in, and its clipped character range says which part of it counts.

Rows are dealt by conversation and sorted by turn; a task streams over them and holds one conversation and one small batch
for the encoder. Defined cases: null text and null role are empty; turns of equal number are ordered by role and text; a
null turn comes first; rows of null conv_id are one conversation; repeated rows are repeated turns; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

# Strings that mark turns or texts in this template or in common others.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]

_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SCHEMA = "conv_id bigint, formatted string, token_ids array<int>, token_starts array<bigint>, token_ends array<bigint>, loss_mask array<boolean>, span_starts array<bigint>, span_ends array<bigint>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts (as escaped)."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"<|im_start|>{escape_role(role or '')}\n", escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|im_end|>\n"]
        at += len(head) + len(body) + len(parts[-1])
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that overlaps a span; both are sorted."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def loss_texts(formatted: str, starts, ends, mask, spans) -> list[str]:
    """The unescaped text under the mask, one string for each span, read from the masked tokens clipped to it."""
    starts, ends, mask = np.asarray(starts, np.int64), np.asarray(ends, np.int64), np.asarray(mask, bool)
    out = []
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        parts, at = [], a
        for i in range(lo, hi):
            if mask[i]:
                s, e = max(at, int(starts[i])), min(b, int(ends[i]))
                if s < e:  # bytes of one character can lie in several tokens
                    parts.append(formatted[s:e])
                    at = e
        out.append(unescape("".join(parts)))
    return out


def format_conversations(conversations: DataFrame, tokenizer: str, batch_chars: int = 1 << 18) -> DataFrame:
    """One row per conversation: the formatted text, its token ids and offsets, the loss mask and the assistant spans."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        tok.post_processor = processors.ByteLevel(trim_offsets=False)

        def encode(waiting):
            rows = []
            for (conv, text, spans), e in zip(waiting, tok.encode_batch([w[1] for w in waiting], add_special_tokens=False), strict=True):
                offsets = np.asarray(e.offsets, np.int64).reshape(-1, 2)
                mask = mask_tokens(offsets[:, 0], offsets[:, 1], spans)
                rows.append((conv, text, e.ids, offsets[:, 0], offsets[:, 1], mask, [a for a, _ in spans], [b for _, b in spans]))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        nothing = object()
        current, turns, waiting, held = nothing, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*rows_of(batch, "conv_id", "role", "text"), strict=True):
                if conv != current and current is not nothing:
                    formatted, spans = render(turns)
                    waiting.append((current, formatted, spans))
                    held += len(formatted)
                    turns = []
                    if held >= batch_chars:
                        yield encode(waiting)
                        waiting, held = [], 0
                current = conv
                turns.append((role, text))
        if current is not nothing:
            waiting.append((current, *render(turns)))
        if waiting:
            yield encode(waiting)

    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say when read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, starts, ends, mask, a, b in zip(*rows_of(batch, "conv_id", "formatted", "token_starts", "token_ends", "loss_mask", "span_starts", "span_ends"), strict=True):
                turns = read_turns(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(loss_texts(text, starts, ends, mask, list(zip(a, b, strict=True))))
                rows.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    columns = ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask", "span_starts", "span_ends")
    return formatted.select(*columns).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def probe_conversation(spark) -> DataFrame:
    """Conversation -7, whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
    return rows.unionByName(probe_conversation(conversations.sparkSession))

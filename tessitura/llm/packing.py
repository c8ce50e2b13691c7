"""Hierarchical multi-length packing.

A document is its token ids and an end id. It is cut into whole long windows first; the rest is routed to the smallest
context-size tier that holds it. Each tier then fills windows of its own size: a long piece opens a window and pieces of
shorter tiers fill the gap, the last of them cut to fit. A window that is full has its tier's size, a power of two, so it
needs no padding. What is left when a partition ends is cut into powers of two as well, so nothing at all is padded.
Sequences are dealt to step groups of equal numbers of tokens within each partition, each with about the same share of every
tier: sequences wait until there are two groups' worth, and a group takes its share of each tier. The last ones are split
evenly.

Each task packs the rows of its own partition and streams over Arrow batches; nothing is shuffled and memory is one batch
and the open windows. Sequence ids are the partition's number times 2**40 plus a running number.

A word's ids are remembered. Only where the tokenizer's own file says that it lower-cases, drops white space and splits words
as assumed here are plain words' letters given to its model directly; any other tokenizer encodes whole texts.

Defined cases: null or empty text is the end id alone; repeated rows are packed as often as they occur; a null id is kept;
an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Memo, rows_of, utf8
from .memory import lean

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"

# A word of Latin-1 letters and then, perhaps, of ASCII marks other than ' and <: the tokenizer splits it there.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-;=-@\[-`{-~]*)")
_DIGIT = re.compile(r"[0-9]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


# How a tokenizer's file must describe its steps for the word memo to hold.
_STEPS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def splits_words(path: str) -> bool:
    """Whether no step of this tokenizer looks across white space, which it drops, and it splits words as _PLAIN assumes."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
    splits = [x.get("pattern", {}).get("Regex") for x in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split" and x.get("invert")]
    return steps == _STEPS["normalizer"] and splits == [_STEPS["split"]] and (file.get("model") or {}).get("end_of_word_suffix") == "</w>"


def text_encoder(path: str, end_id: int, limit: int = 100_000):
    """text (UTF-8 or None) -> ids of the text and the end id, as little-endian 32-bit bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    end = np.asarray([end_id], "<u4").tobytes()

    def whole(text: str) -> bytes:
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    if not splits_words(path):
        return lambda text: (whole(text.decode()) if text else b"") + end
    memo = word_ids(tok.model, whole, limit)
    return lambda text: encode_document(text, memo, end)


def word_ids(model, whole, limit: int) -> Memo:
    """word (bytes without ASCII white space) -> its ids, remembered for a task."""
    letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def plain(word: str) -> bytes:
        form = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in model.tokenize(form)]).tobytes()

    cores, marks = Memo(plain, limit // 2), Memo(whole, limit // 10)

    def ids(word: bytes) -> bytes:
        text = word.decode()
        m = _PLAIN.fullmatch(text.lower())
        if m is None or _DIGIT.search(m[2]):
            return whole(text)
        return cores[m[1]] + marks[m[2]] if m[2] else cores[m[1]]

    return Memo(ids, limit)


def encode_document(text: bytes | None, memo: Memo, end: bytes) -> bytes:
    """ids of the text and the end id, as little-endian 32-bit bytes."""
    if not text:
        return end
    if text.isascii() and b"<|" not in text:
        text = text.lower()  # the tokenizer does so as well; fewer different words
    return b"".join(map(memo.__getitem__, text.split())) + end


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens); full windows come out through rows()."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers = sorted(tiers)
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.next_id, self.base, self.step_tokens = partition << 40, partition << 40, step_tokens
        self.group, self.waiting = 0, {}  # sequences without a step group, by size
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total, at, long = len(ids) // 4, 0, self.tiers[-1]
        while total - at >= long:
            self._emit([(doc, at, ids[4 * at : 4 * (at + long)], total)], long)
            at += long
        if rest := total - at:
            tier = next(t for t in self.tiers if t >= rest)
            self.pools[tier].append((doc, at, ids[4 * at :], total))

    def pack(self, last: bool = False) -> None:
        """Fill windows while the pools hold enough tokens for one; at the end, cut the rest into powers of two."""
        for i in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[i], self.tiers[: i + 1]
            held = sum(len(p[2]) // 4 for t in below for p in self.pools[t])
            while self.pools[size] and held >= size:
                self._emit(self._take(size, below), size)
                held -= size
        if last:
            left = [p for t in reversed(self.tiers) for p in self.pools[t]]
            held = sum(len(p[2]) // 4 for p in left)
            for t in self.tiers:
                self.pools[t].clear()
            self.pools[self.tiers[0]].extend(left)
            while held:
                size = min(1 << (held.bit_length() - 1), self.tiers[-1])
                self._emit(self._take(size, self.tiers[:1]), size)
                held -= size

    def _take(self, size: int, tiers) -> list[tuple]:
        """Pieces of exactly size tokens: one of the longest tier that has any, then whatever fits; the last is cut."""
        taken, gap = [], size
        while gap:
            tier = next((t for t in reversed(tiers) if self.pools[t] and (t <= gap or not taken)), None) or next(t for t in tiers if self.pools[t])
            doc, at, ids, total = self.pools[tier].popleft()
            n = len(ids) // 4
            if n > gap:
                self.pools[tier].appendleft((doc, at + gap, ids[4 * gap :], total))
                ids, n = ids[: 4 * gap], gap
            taken.append((doc, at, ids, total))
            gap -= n
        return taken

    def _emit(self, pieces: list[tuple], size: int) -> None:
        rows, offset = [], 0
        for doc, at, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, at, n, zlib.crc32(ids), total, self.next_id, offset, size))
            offset += n
        self.next_id += 1
        self.waiting.setdefault(size, deque()).append(rows)
        self.held += size
        while self.held >= 2 * self.step_tokens:
            self._group(self.step_tokens)

    def _group(self, tokens: int) -> None:
        """A step group of so many tokens: of each size its share, then what fills the group, from the longest on."""
        room, share = tokens, tokens / self.held
        sizes = sorted((s for s, w in self.waiting.items() if w), reverse=True)
        counts = {s: int(len(self.waiting[s]) * share) for s in sizes}
        room -= sum(s * n for s, n in counts.items())
        for s in sizes:
            more = min(len(self.waiting[s]) - counts[s], room // s)
            counts[s] += more
            room -= more * s
        for s, n in counts.items():
            for _ in range(n):
                self.out += [(*row, self.base + self.group) for row in self.waiting[s].popleft()]
        self.held -= tokens - room
        self.group += 1

    def finish(self) -> None:
        """Deal what waits to step groups of about equal size, the last of a partition."""
        groups = -(-self.held // self.step_tokens)
        filled = [0] * groups
        for s in sorted(self.waiting, reverse=True):
            for rows in self.waiting[s]:
                g = filled.index(min(filled))
                filled[g] += s
                self.out += [(*row, self.base + self.group + g) for row in rows]
        self.waiting, self.held = {}, 0

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), step_tokens: int = 1 << 18) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    tiers are powers of two; the largest is the context limit."""
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")

    @lean
    def pack(batches):
        encode = text_encoder(tokenizer, end_id)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            for doc, text in zip(*rows_of(batch, "doc_id", "text"), strict=True):
                packer.add(doc, encode(text))
            packer.pack()
            yield from _batches(packer.rows())
        packer.pack(last=True)
        packer.finish()
        yield from _batches(packer.rows())

    return documents.select("doc_id", utf8().alias("text")).mapInArrow(pack, SCHEMA)


def _batches(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

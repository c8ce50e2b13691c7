"""SentencePiece encoding and decoding of merge-type (BPE) models, by a prefix table.

The encoding of every prefix of a text ends in one certain piece. That piece is found among the pieces an automaton matches
at the prefix's end: it is the one whose predecessor, the last piece of the prefix before it, it is compatible with, which
means that merging the two pieces' characters gives just these two pieces. The table of last pieces gives the ids from the
back to the front. This needs no queue of merges and is linear in the text, times the few pieces that end at one place.

Texts are cut first where no piece can reach across: before a run of spaces, and around characters that only stand alone.
What the cuts give is encoded once and kept in a bounded memo, so the table is filled for each word a task meets anew; a
text without any place to cut is one table.

Defined cases: null text counts as empty; an empty text has no pieces but the end id; repeated rows stay repeated; a null id
is kept; an empty table gives no rows; further columns are ignored; a very long text costs time and memory in proportion to
its length. Bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary are an error in decode.
"""

from __future__ import annotations

import codecs
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, rows_of, slices_of

SPACE = "▁"
_loaded: dict[str, "Pieces"] = {}
codecs.register_error("piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))  # each stray byte counts for itself


class Pieces:
    """The tables of one model file: pieces with ranks and splits, the automaton, the cuts."""

    def __init__(self, path: str, memo: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ ") != f"{SPACE * 2}a{SPACE * 2}ﬁ{SPACE}":
            raise ValueError(f"{path}: only models that leave texts as they are, but for a space before them, are supported")
        kinds = range(model.get_piece_size())
        self.piece = [model.id_to_piece(i) for i in kinds]
        plain = [i for i in kinds if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.piece[i]: i for i in plain}
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(model.is_byte(i) for i in self.byte)
        self._rank(model, plain)
        self._automaton(plain)
        self.surface = [b"" if model.is_control(i) else self.piece[i].replace(SPACE, " ").encode() for i in kinds]
        self.surface[self.unknown] = " ⁇ ".encode()
        for b, i in enumerate(self.byte if self.has_bytes else ()):
            self.surface[i] = bytes([b])
        self.pairs, self.words = Memo(self._meets, memo), Memo(self._packed, memo)

    def _rank(self, model, plain) -> None:
        """rank: the order in which merges are made, -1 for characters; halves: the two pieces whose merge gives a piece."""
        scores = sorted({model.get_score(i) for i in plain if len(self.piece[i]) > 1}, reverse=True)
        order = {s: n for n, s in enumerate(scores)}
        self.rank = [-1] * len(self.piece)
        longer = [i for i in plain if len(self.piece[i]) > 1]
        for i in longer:
            self.rank[i] = order[model.get_score(i)]
        self.merged = {self.piece[i]: self.rank[i] for i in longer}
        self.halves = [None] * len(self.piece)
        for i in sorted(longer, key=lambda i: (self.rank[i], len(self.piece[i]))):
            text, found = self.piece[i], []
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None and max(self.rank[a], self.rank[b]) <= self.rank[i] and self._compatible(a, b, self.rank[i]):
                    found.append((a, b))
            if len(found) != 1:
                raise ValueError(f"piece {text!r} comes from {len(found)} merges: not a model whose pieces are built by merges")
            self.halves[i] = found[0]

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of a rank below limit joins the end of a to the start of b.

        Merges are undone from the last to the first; whenever the two pieces at the border could have been merged before
        the merge undone last, they would have been. Of equal ranks the left one comes first."""
        piece, rank, merged, halves = self.piece, self.rank, self.merged, self.halves
        while True:
            if merged.get(piece[a] + piece[b], limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True

    def _meets(self, pair: int) -> bool:
        return self._compatible(pair >> 32, pair & 0xFFFFFFFF, 1 << 60)

    def _automaton(self, plain) -> None:
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.piece[i], (i, len(self.piece[i])))
        self.automaton.make_automaton()
        inner = {c for i in plain if len(self.piece[i]) > 1 for c in self.piece[i]}
        self.known = {self.piece[i] for i in plain if len(self.piece[i]) == 1}
        if not inner <= self.known:
            raise ValueError("a character of a piece is no piece itself")
        letters = "".join(re.escape(c) for c in sorted(inner - {SPACE}))
        if any(SPACE in self.piece[i].lstrip(SPACE) for i in plain) or not letters:
            self.cuts = re.compile(r"(?s).+")  # pieces reach over spaces: no cuts
        else:
            self.cuts = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|(?s:.)")

    def encode_part(self, part: str) -> list[int]:
        """The ids of a part between cuts. Nothing merges over an unknown character, so each stretch between them has a table."""
        if self.known.issuperset(part):
            return self._by_table(part)
        out = []
        for known, stretch in itertools.groupby(part, self.known.__contains__):
            text = "".join(stretch)
            if known:
                out += self._by_table(text)
            else:
                out += [self.byte[b] for b in text.encode()] if self.has_bytes else [self.unknown] * len(text)
        return out

    def _by_table(self, part: str) -> list[int]:
        """last[n] is the last piece of the encoding of part[:n + 1]; every character is a piece, so each place has one."""
        last, pairs = [-1] * len(part), self.pairs
        for at, (i, size) in self.automaton.iter(part):
            if last[at] < 0 and (size > at or pairs[last[at - size] << 32 | i]):
                last[at] = i
        ids, at = [], len(part) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.piece[last[at]])
        return ids[::-1]

    def _packed(self, part: str) -> bytes:
        return np.array(self.encode_part(part), "<i4").tobytes()

    def encode(self, text: str, end: bool = True) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        tail = np.array([self.end] if end else [], "<i4").tobytes()
        if not text:
            return tail
        words, out = self.words, []
        for part in self.cuts.findall(SPACE + text.replace(" ", SPACE)):
            out.append(words[part] if len(part) <= 48 else self._packed(part))
        out.append(tail)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with their spaces, control ids as nothing, runs of bytes as UTF-8, one space less in front."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.surface)):
            raise ValueError("an id is not in the vocabulary")
        shown, first = [self.surface[i] for i in ids.tolist()], next((i for i in ids.tolist() if self.surface[i]), None)
        runs = [shown] if all(shown[:-1]) else [list(g) for seen, g in itertools.groupby(shown, bool) if seen]  # control ids end runs of bytes
        out = "".join([b"".join(run).decode("utf-8", "piece-bytes") for run in runs])
        return out[1:] if first is not None and self.piece[first].startswith(SPACE) else out


def pieces(path: str) -> Pieces:
    """One set of tables a worker and model."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _ids_array(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))


def _texts(batch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in rows_of(batch, "text")[0]]


def _over_texts(documents: DataFrame, convert, schema: str, slice_bytes: int) -> DataFrame:
    """convert(texts) -> arrays of the further columns, in slices of bounded bytes."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            ids, raw = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text"))
            for start, stop in slices_of(raw.to_pylist(), slice_bytes):
                part = pa.RecordBatch.from_arrays([ids[start:stop], raw[start:stop]], ["doc_id", "text"])
                made = convert(_texts(part))
                yield pa.RecordBatch.from_arrays([ids[start:stop], *made.values()], ["doc_id", *made])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode_texts(documents: DataFrame, model: str, end: bool = True, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, ids (array of int) for each row of documents (doc_id, text): a narrow map, nothing is shuffled."""

    def convert(texts):
        own = pieces(model)
        return {"ids": _ids_array([own.encode(t, end) for t in texts])}

    return _over_texts(documents, convert, "ids array<int>", slice_bytes)


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids); a null list has a null text."""

    def run(batches):
        own = pieces(model)
        for batch in batches:
            ids, rows = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("ids"))
            texts = [None if r.as_py() is None else own.decode(np.array(r.as_py(), "int64")) for r in rows]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(documents: DataFrame, model: str, end: bool = True, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, ids, decoded: what encode_texts and then decode_ids give, in one pass, so that a task has one Python worker."""

    def convert(texts):
        own = pieces(model)
        packed = [own.encode(t, end) for t in texts]
        return {"ids": _ids_array(packed), "decoded": pa.array([own.decode(np.frombuffer(p, "<i4")) for p in packed], pa.string())}

    return _over_texts(documents, convert, "ids array<int>, decoded string", slice_bytes)

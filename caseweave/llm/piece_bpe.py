"""Merge-type subword encoding by backtracking, and decoding.

A sequence of tokens is what merging by scores gives for a text exactly if merging any two
neighbours gives those two again: no merge across a border can come first anywhere if it
cannot between the two tokens alone. So a text is read from the left. An Aho-Corasick
automaton finds all tokens that start at each place; the longest one that is compatible
with the token before it is taken. Compatibility is checked by merging the two again, and
remembered. Where none is left, the place is marked in a bitfield of failed places and the
last token is given up for its next shorter alternative. A place is reached by at most one
valid sequence, so one bit for each place is enough and the work is linear in practice.

Texts are cut where no token of the vocabulary can reach across, and a Python worker
remembers the ids of the parts it has seen, up to a bound. The model file (a fixed size) is read by the
driver and sent to the tasks.

Models that normalize texts, keep user-defined symbols or have no byte pieces are refused
with a ValueError. Null texts count as empty (the end id alone); null ids are kept; repeated
rows are encoded each for itself; no other column is read. A text of any length is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import id_and_text, texts_of

#: A Python worker forgets its parts, and its checked pairs, when they have grown beyond this many.
CACHE_PARTS = 1_000_000
#: Parts longer than this many characters are not remembered.
CACHE_CHARS = 64

SPACE = "▁"


@dataclass(frozen=True)
class Model:
    """Pieces with id and score, ids of the 256 byte pieces, end id, and whether texts get a space in front."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    names: tuple[str, ...]
    silent: frozenset[int]
    unknown: int
    unknown_text: str
    end: int
    prefix: bool


def read_model(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as file:
        proto = pb.ModelProto.FromString(file.read())
    kind = pb.ModelProto.SentencePiece
    spec, trained = proto.normalizer_spec, proto.trainer_spec
    types = [p.type for p in proto.pieces]
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    if trained.model_type != trained.BPE or not plain or kind.USER_DEFINED in types or kind.UNUSED in types or trained.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only merge-type models without normalization and user-defined pieces")
    bytes_of = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
    if len(bytes_of) != 256:
        raise ValueError(f"{path}: no byte pieces")
    return Model(
        pieces={p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL},
        byte_ids=tuple(bytes_of[b] for b in range(256)),
        names=tuple(p.piece for p in proto.pieces),
        silent=frozenset(i for i, t in enumerate(types) if t == kind.CONTROL),
        unknown=types.index(kind.UNKNOWN),
        unknown_text=trained.unk_surface,
        end=next(i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL and p.piece == trained.eos_piece),
        prefix=spec.add_dummy_prefix,
    )


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        self.borders: dict[tuple[str, str], bool] = {}
        for piece in model.pieces:
            if len(piece) == 1 or self.merge(piece) == [piece]:  # else no sequence of merges ends in this piece
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.parts = re.compile(_part_pattern(model.pieces), re.DOTALL).findall
        self.known: dict[str, bytes] = {}
        self.words = list(map(str, range(len(model.names))))
        to_byte = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        self.surface = [
            to_byte.get(i, b"" if i in model.silent else (model.unknown_text if i == model.unknown else name.replace(SPACE, " ")).encode())
            for i, name in enumerate(model.names)
        ]

    def merge(self, text: str) -> list[str]:
        """Plain merging: the highest score first, from the left among equals."""
        parts, pieces = list(text), self.model.pieces
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens again gives the same two."""
        key = (left, right)
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) > CACHE_PARTS:
                self.borders.clear()
            known = self.borders[key] = self.merge(left + right) == [left, right]
        return known

    def tokens(self, part: str) -> list[str]:
        """The tokens of a text without borders, by backtracking."""
        n = len(part)
        starts: list[list[str]] = [[] for _ in range(n)]
        for last, token in self.automaton.iter(part):
            starts[last - len(token) + 1].append(token)
        for at, found in enumerate(starts):
            if not found or len(found[0]) > 1:
                found.insert(0, part[at])  # a character that is no piece is a token of its own
        if len(starts[0][-1]) == n:
            return [part]
        failed = bytearray(n + 1)
        taken: list[str] = []
        choice: list[int] = []
        at, k = 0, len(starts[0]) - 1
        while True:
            found = starts[at]
            while k >= 0:
                token = found[k]
                if not failed[at + len(token)] and (not taken or self.compatible(taken[-1], token)):
                    break
                k -= 1
            if k >= 0:
                taken.append(token)
                choice.append(k)
                at += len(token)
                if at == n:
                    return taken
                k = len(starts[at]) - 1
            else:
                failed[at] = 1
                at -= len(taken.pop())
                k = choice.pop() - 1

    def part_ids(self, part: str) -> bytes:
        out: list[int] = []
        for token in self.tokens(part):
            found = self.model.pieces.get(token)
            out += [found[0]] if found else [self.model.byte_ids[b] for b in token.encode()]
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text and the end id."""
        ids, known = [], self.known
        if text:
            if len(known) > CACHE_PARTS:
                known.clear()
            spaced = text.replace(" ", SPACE)
            for part in self.parts(SPACE + spaced if self.model.prefix else spaced):
                got = known.get(part)
                if got is None:
                    got = self.part_ids(part)
                    if len(part) <= CACHE_CHARS:
                        known[part] = got
                ids.append(got)
        ids.append(np.array([self.model.end], "<i4").tobytes())
        return np.frombuffer(b"".join(ids), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for. Bytes that are no UTF-8 become U+FFFD each, one space in front goes again.

        Control ids are silent, but bytes before and after one make no character together.
        """
        listed = ids.tolist()
        while listed and listed[-1] in self.model.silent:
            listed.pop()
        spans, silent = [[]], self.model.silent
        if silent.isdisjoint(listed):
            spans = [listed]
        else:
            for i in listed:
                if i in silent:
                    spans.append([])
                else:
                    spans[-1].append(i)
        front = next((span[0] for span in spans if span), None)
        text = "".join(_text(b"".join(map(self.surface.__getitem__, span))) for span in spans)
        return text[1:] if self.model.prefix and front is not None and self.model.names[front].startswith(SPACE) else text


def _part_pattern(pieces: Iterable[str]) -> str:
    """Parts that no piece reaches across: spaces, then signs, then letters.

    Signs are characters that follow a letter in no piece, letters all others of the longer
    pieces. A character of no longer piece stands alone.
    """
    after: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            after.setdefault(b, set()).add(a)
            after.setdefault(a, set())
    if not after or after.get(SPACE, set()) - {SPACE}:
        return ".+"
    letters = {c for c in after if c.isalpha()}
    while more := {c for c in after if c not in letters and c != SPACE and after[c] & letters}:
        letters |= more
    signs = f"[{''.join(map(re.escape, sorted(set(after) - letters - {SPACE})))}]" if set(after) - letters - {SPACE} else "(?!)"
    word = f"[{''.join(map(re.escape, sorted(letters)))}]" if letters else "(?!)"
    return f"{SPACE}+{signs}*{word}*|{signs}+{word}*|{word}+|."


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as wrong:
                out.append(raw[at : at + wrong.start].decode() + "�")
                at += wrong.start + 1
        return "".join(out)


_LAST: list = []


def _codec(model: Model) -> Codec:
    """The codec of a model; a worker keeps the last one, and what it has learnt, from task to task."""
    if not _LAST or _LAST[0] is not model:
        _LAST[:] = [model, Codec(model)]
    return _LAST[1]


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns named in ``keep``, and token_ids (array of int, the end id last) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    names = [f"keep_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            rows = [codec.encode(text) for text in texts_of(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, "<i4"), *rows]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(batch.column, names), lists], ["doc_id", *names, "token_ids"])

    chosen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        *[docs[c].alias(name) for c, name in zip(keep, names)],
    )
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "text"]).add("token_ids", T.ArrayType(T.IntegerType()))
    return chosen.mapInArrow(run, schema).select("doc_id", *[F.col(name).alias(c) for c, name in zip(keep, names)], "token_ids")


def decode(tokens: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and the text that token ids stand for; null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [codec.decode(np.array(v.as_py() or [], "<i4")) for v in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    chosen = tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("token_ids"))
    return chosen.mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip per document: doc_id, n_tokens, SHA-256 of the ids in decimals joined by spaces and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in texts_of(batch):
                ids = codec.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(codec.words.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)

"""Byte-level BPE by merge replay.

A task cuts its texts into pieces. Over all distinct pieces of a block at once it keeps an inverted index from a merge to the positions where its pair of
tokens stands, and applies the merges in rank order: each merge touches only its own
positions and their two neighbours, whose new pairs are entered in the index under their
own rank. Pieces are independent of each other, so what one task replays is what a replay
over the whole corpus would give for them; no piece dictionary has to be shuffled.

A merge may, in an irregular vocabulary, bring about a pair of a lower rank than its own.
Then the order inside that piece matters: such pieces are noticed and merged one by one.

The vocabulary is a file of ranks (a fixed size, read by the driver once and sent to the
tasks). Encoding adds no special tokens. Decoding looks every id up again.

Null texts count as empty (no tokens); null ids are kept; repeated rows are encoded each
for itself; no other column is read. Texts of any length are one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.common import id_and_text, texts_of

#: A task forgets its piece table when it has grown beyond this many pieces.
CACHE_PIECES = 400_000
#: Texts are encoded in blocks of about this many characters.
BLOCK_CHARS = 8_000_000

NO_PAIR = 1 << 30


class Merges:
    """Ranks of a vocabulary, and the pairs of tokens that merge into each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), NO_PAIR) for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1 << 62))
        self.merged = np.append(np.array(merged, np.int64)[order], NO_PAIR)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or NO_PAIR."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)

    def merge_alone(self, piece: bytes) -> list[int]:
        """Plain merging of one piece, lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NO_PAIR) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NO_PAIR:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of every piece as little-endian 32-bit numbers."""
        done = {i: np.array([r], "<u4").tobytes() for i, p in enumerate(pieces) if (r := self.ranks.get(p)) is not None}
        open_ = [i for i, p in enumerate(pieces) if i not in done and p]
        out = [done.get(i, b"") for i in range(len(pieces))]
        if not open_:
            return out
        lengths = np.array([len(pieces[i]) for i in open_])
        token = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
        n = len(token)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        word = np.repeat(np.arange(len(open_), dtype=np.int32), lengths)
        following = np.arange(1, n + 1, dtype=np.int32)
        following[starts + lengths - 1] = n  # n stands for "none"
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = n
        before = np.append(before, np.int32(n))
        token = np.append(token, (1 << 29))  # pairs with nothing
        rank = np.append(self.rank_of(token[:n], token[following]), NO_PAIR)
        following = np.append(following, np.int32(n))
        alive = np.ones(n + 1, bool)
        irregular = np.zeros(len(open_), bool)

        index: dict[int, list[np.ndarray]] = {}

        def enter(places: np.ndarray) -> None:
            r = rank[places]
            places, r = places[r < NO_PAIR], r[r < NO_PAIR]
            if len(places):
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                for part, first in zip(np.split(places, cuts), r[np.concatenate([[0], cuts])].tolist()):
                    index.setdefault(first, []).append(part)

        enter(np.arange(n, dtype=np.int32))
        for r in range(len(self.tokens)):
            lists = index.pop(r, None)
            if lists is None:
                continue
            places = np.concatenate(lists)
            places = np.sort(places[rank[places] == r])
            places = places[np.append(True, places[1:] != places[:-1])] if len(places) else places
            if not len(places):
                continue
            right = following[places]
            if (rank[right] == r).any():  # overlapping pairs, as in "aaa": the leftmost goes first
                places = _leftmost(places, right, rank[right] == r)
                right = following[places]
            after = following[right]
            between = self.rank_of(np.full(len(places), r), token[after])  # before a neighbour merges as well
            token[places] = r
            following[places] = after
            before[after] = places
            before[n] = n
            alive[right] = False
            rank[right] = NO_PAIR
            left = before[places]
            touched = np.concatenate([places, left[left < n]])
            rank[touched] = self.rank_of(token[touched], token[following[touched]])
            low = (rank[touched] < r) & (rank[touched] != NO_PAIR)
            if low.any() or (between < r).any():
                irregular[word[touched[low]]] = True
                irregular[word[places[between < r]]] = True
            enter(touched)

        kept = np.flatnonzero(alive[:n])
        ids = token[kept].astype("<u4")
        ends = np.searchsorted(kept, starts + lengths)
        first = np.concatenate([[0], ends[:-1]])
        raw = ids.tobytes()
        for k, i in enumerate(open_):
            out[i] = raw[4 * first[k] : 4 * ends[k]]
        for k in np.flatnonzero(irregular):
            out[open_[k]] = np.array(self.merge_alone(pieces[open_[k]]), "<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _leftmost(places: np.ndarray, right: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """Of pairs that share a token with the next pair, every other one, from the left."""
    taken, blocked = [], -1
    for place, nxt, overlap in zip(places.tolist(), right.tolist(), overlaps.tolist()):
        if place != blocked:
            taken.append(place)
            blocked = nxt if overlap else -1
    return np.array(taken)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank per line. The vocabulary is read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


#: The one pattern with a quicker equal for texts whose characters all lie below U+0250, where its
#: classes are short lists. A fixed value.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_LATIN = re.compile("[^\x00-\u024f]")


class Encoder:
    """Encodes blocks of texts; what a task has learnt about pieces is kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges = Merges(ranks)
        # White space by its Unicode property, without the separators U+001C to U+001F.
        self.findall = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.short_lists = pattern == KNOWN_PATTERN
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if self.short_lists and not _NOT_LATIN.search(text):
            return _LATIN.findall(text)
        return self.findall(text)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(text) for text in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self.merges.replay([p.encode("utf-8") for p in new])))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]


def encode_texts(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[bytes]:
    """Token ids of the texts of a batch, in order."""
    block, size = [], 0
    for text in chain(texts_of(batch), [None]):
        if text is not None:
            block.append(text)
            size += len(text)
        if block and (text is None or size > BLOCK_CHARS):
            yield from encoder.encode_block(block)
            block, size = [], 0


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, the columns named in ``keep``, and token_ids (array of int) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            rows = list(encode_texts(encoder, batch))
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            kept = [batch.column(f"keep_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, lists], ["doc_id", *(f"keep_{i}" for i in range(len(keep))), "token_ids"])

    chosen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        *[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)],
    )
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "text"]).add("token_ids", T.ArrayType(T.IntegerType()))
    return chosen.mapInArrow(run, schema).select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "token_ids")


def decode(tokens: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and the bytes that token ids stand for; null ids decode to nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(shared.value)
        for batch in batches:
            raw = [merges.decode(np.array(v.as_py() or [], "<u4").tobytes()) for v in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    chosen = tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("token_ids"))
    return chosen.mapInArrow(run, "doc_id long, decoded binary")


def digests(
    docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Round trip per document: doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in encode_texts(encoder, batch):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.merges.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)

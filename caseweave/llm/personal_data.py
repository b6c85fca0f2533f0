"""Personal data by a skip-chain conditional random field.

Exact patterns (email, ip, card, phone) give the base spans. The field adds what they miss:
its nodes are the tokens of a document that hold a digit or an ``@``. Neighbouring nodes
share a chain potential, and tokens that repeat or resemble each other anywhere in the
document share a skip potential, each occurrence with the next one, and every other one with
the nearest occurrence inside a base span, so a group of a thousand repeats has two thousand
edges at most. Loopy message passing, until no message changes by ``TOLERANCE`` any more,
lets the label of a number that the patterns recognise once reach all its bare repetitions.

The potentials are learnt from counts over all documents, with the base spans as labels:
node weights by logistic regression over counted token shapes, edge weights as smoothed
log ratios. The tables are bounded by the number of shapes (a few thousand) and labels.

Tokens inside base spans are fixed to their label; base spans are never changed. A null
text counts as empty; null ids are kept; repeated rows are searched each for itself; other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import id_and_text, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns by start, then kind; offsets in code points, end exclusive."""
    found = list(_emails(text))
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an ``@``, without brackets and stops at their ends."""
    out, done = [], 0
    mark = _MARK.search(text)
    while mark:
        start = 1 + max(done - 1, *(text.rfind(b, done, mark.start()) for b in _BLANKS))
        blank = _BLANK.search(text, mark.start())
        end = blank.start() if blank else len(text)
        left, right = start, end
        while left < right and not (text[left].isalnum() or text[left] == "+"):
            left += 1
        while right > left and not text[right - 1].isalnum():
            right -= 1
        if left < right:
            out.append((left, right))
        done = end
        mark = _MARK.search(text, end)
    return out


def shape(token: str, before: str) -> str:
    """What a node weight depends on: sizes and signs, never the characters themselves."""
    digits = sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    return "|".join((
        f"d{min(digits, 20)}", f"l{min(letters, 3) if letters < 4 else 4 + min(letters // 8, 3)}",
        f"dots{min(token.count('.'), 4)}", f"dash{min(token.count('-'), 3)}", f"at{min(token.count('@'), 2)}",
        f"plus{int(token[0] == '+')}", f"other{int(any(not c.isalnum() and c not in '.-@+' for c in token))}",
        f"after{before if before in '(+=:' and before else '_'}",
    ))


def keys_of(token: str) -> list[str]:
    """Two tokens are alike when they share a key: the same letters and digits, or the telling part of them."""
    plain = "".join(filter(str.isalnum, token)).lower()
    keys = ["=" + plain]
    if "@" in token:
        keys.append("@" + token.partition("@")[0].lower())
    digits = "".join(filter(str.isdigit, token))
    if len(digits) >= 7:
        keys.append("#" + digits[-7:])
    return keys


@dataclass
class Graph:
    """Nodes and edges of a document."""

    tokens: list[tuple[int, int]]
    shapes: list[str]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    fixed: list[int]  # label of a node inside a base span, else 0
    anchors: Sequence[tuple[int, int]] = ()  # a node and the nearest one like it inside a base span; not counted when learning


#: Nodes with at most this many characters between them are neighbours.
NEAR = 3


def graph_of(text: str, base: list[Span]) -> Graph:
    tokens = tokens_of(text)
    shapes = [shape(text[a:b], text[a - 1] if a else "") for a, b in tokens]
    chain = [(i, i + 1) for i, ((_, b), (a, _)) in enumerate(zip(tokens, tokens[1:])) if a - b <= NEAR]
    alike: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(tokens):
        for key in keys_of(text[a:b]):
            alike.setdefault(key, []).append(i)
    skip = {pair for group in alike.values() for pair in zip(group, group[1:])}
    fixed, spans = [0] * len(tokens), sorted(base, key=lambda s: s[1])
    first = 0
    for i, (a, b) in enumerate(tokens):
        while first < len(spans) and spans[first][2] <= a:
            first += 1
        best = 0
        for k in range(first, len(spans)):
            kind, s, e = spans[k]
            if s >= b:
                break
            if min(b, e) - max(a, s) > best:
                best, fixed[i] = min(b, e) - max(a, s), LABELS.index(kind)
    anchors = {pair for group in alike.values() for pair in _anchors(group, fixed)}
    return Graph(tokens, shapes, chain, sorted(skip - set(chain)), fixed, sorted(anchors - skip - set(chain)))


def _anchors(group: list[int], fixed: list[int]) -> Iterator[tuple[int, int]]:
    """Every node of a group without a label, and the nearest one with a label (the earlier one on ties)."""
    held = [i for i in group if fixed[i]]
    if held:
        for i in group:
            if not fixed[i]:
                at = bisect_left(held, i)
                near = min(held[max(at - 1, 0) : at + 1], key=lambda h: abs(h - i))
                yield min(i, near), max(i, near)


@dataclass
class Field:
    """Learnt potentials (logs)."""

    node: dict[str, np.ndarray]  # of shapes that were counted
    part: dict[str, np.ndarray]  # weights of a shape's parts, for other shapes; "" is the constant
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, str, int, int], int]) -> Field:
        n = len(LABELS)
        shapes = sorted({what for kind, what, _, _ in counts if kind == "node"})
        seen = np.zeros((len(shapes), n))
        edges = {"chain": np.full((n, n), 0.5), "skip": np.full((n, n), 0.5) + 20 * np.eye(n)}
        place = {s: i for i, s in enumerate(shapes)}
        for (kind, what, a, b), many in counts.items():
            if kind == "node":
                seen[place[what], a] += many
            else:
                edges[kind][a, b] += many
                edges[kind][b, a] += many
        parts = [s.split("|") for s in shapes]
        names = {p: i for i, p in enumerate(sorted({p for ps in parts for p in ps}))}
        x = np.zeros((len(shapes), len(names) + 1))
        x[:, -1] = 1
        for row, ps in enumerate(parts):
            x[row, [names[p] for p in ps]] = 1
        w = _regression(x, seen)
        # A shape's own counts refine what its parts say.
        logits = x @ w
        prior = np.exp(logits - logits.max(axis=1, keepdims=True))
        prior /= prior.sum(axis=1, keepdims=True)
        own = np.log((seen + 2 * prior + 1e-6) / (seen.sum(axis=1, keepdims=True) + 2))
        part = {p: w[i] for p, i in names.items()} | {"": w[-1]}
        return cls({s: own[i] for s, i in place.items()}, part, _ratio(edges["chain"]), _ratio(edges["skip"]))

    def of_shape(self, shape: str) -> np.ndarray:
        if shape not in self.node:
            zero = np.zeros(len(LABELS))
            self.node[shape] = sum((self.part.get(p, zero) for p in shape.split("|")), self.part[""])
        return self.node[shape]


def _regression(x: np.ndarray, seen: np.ndarray, steps: int = 300) -> np.ndarray:
    """Multinomial logistic regression over counted rows, ridge-penalised, by gradient steps."""
    w = np.zeros((x.shape[1], seen.shape[1]))
    weight = np.log1p(seen.sum(axis=1, keepdims=True))
    share = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    total = max(weight.sum(), 1.0)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 2.0 * (x.T @ (weight * (share - p)) / total - 1e-4 * w)
    return w


def _ratio(pairs: np.ndarray) -> np.ndarray:
    joint = pairs / pairs.sum()
    alone = joint.sum(axis=1)
    return np.clip(np.log(joint / np.outer(alone, alone)), -4, 4)


#: Messages (logs) are passed until none changes by more, which for most texts takes a few dozen rounds.
TOLERANCE = 1e-8


def beliefs(graph: Graph, field: Field, rounds: int = 500, damping: float = 0.3) -> np.ndarray:
    """Marginals of every node by loopy sum-product messages; ``rounds`` ends a field that swings without settling."""
    n, m = len(graph.tokens), len(LABELS)
    node = np.stack([field.of_shape(s) for s in graph.shapes])
    for i, label in enumerate(graph.fixed):
        if label:
            node[i] = -30.0
            node[i, label] = 0.0
    edges = [*graph.chain, *graph.skip, *graph.anchors]
    if not edges:
        return _normal(node)
    source = np.array([e[0] for e in edges] + [e[1] for e in edges])
    target = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pair = np.stack(([field.chain] * len(graph.chain) + [field.skip] * (len(edges) - len(graph.chain))) * 2)
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), m))
    for _ in range(rounds):
        total = node.copy()
        np.add.at(total, target, message)
        out = (total[source] - message[back])[:, :, None] + pair
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0, :]
        new -= new.max(axis=1, keepdims=True)
        new = damping * message + (1 - damping) * new
        change = np.abs(new - message).max()
        message = new
        if change < TOLERANCE:
            break
    total = node.copy()
    np.add.at(total, target, message)
    return _normal(total)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field, sure: float = 0.8) -> list[Span]:
    """Spans the field adds: sure tokens outside base spans, neighbours of one label together."""
    graph = graph_of(text, base)
    if not graph.tokens:
        return []
    p = beliefs(graph, field)
    out: list[Span] = []
    joined = {b for _, b in graph.chain}
    previous = -1
    for i, (a, b) in enumerate(graph.tokens):
        label = int(np.argmax(p[i]))
        if graph.fixed[i] or not label or p[i, label] < sure:
            continue
        kind = LABELS[label]
        if out and previous == i - 1 and i in joined and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
        previous = i
    return out


def shape_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over all documents: shapes by label, labels of neighbours, labels of alike tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                if not _MARK.search(text):
                    continue
                g = graph_of(text, base_spans(text))
                seen.update(("node", s, f, 0) for s, f in zip(g.shapes, g.fixed))
                seen.update(("chain", "", g.fixed[a], g.fixed[b]) for a, b in g.chain)
                # Two tokens without a label say nothing about labels that repeat.
                seen.update(("skip", "", g.fixed[a], g.fixed[b]) for a, b in g.skip if g.fixed[a] or g.fixed[b])
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()),
             pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([k[3] for k, _ in rows], pa.int32()),
             pa.array([n for _, n in rows], pa.int64())],
            ["kind", "shape", "a", "b", "n"],
        )

    parts = id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, "kind string, shape string, a int, b int, n long")
    return parts.groupBy("kind", "shape", "a", "b").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field's potentials. The counts that reach the driver are bounded by shapes x labels."""
    rows = shape_counts(docs, id_col, text_col).collect()
    return Field.from_counts({(r.kind, r.shape, r.a, r.b): r.n for r in rows})


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, *, sure: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, stop) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for text in texts_of(batch):
                spans = base_spans(text)
                base.append(spans)
                added.append(added_spans(text, spans, shared.value, sure))
            as_rows = lambda rows: pa.array([[dict(zip(("kind", "start", "stop"), s)) for s in r] for r in rows], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_rows(base), as_rows(added)], ["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for kind, a, b in in_order(spans):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = b
    return "".join(out) + text[done:]



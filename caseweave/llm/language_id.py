"""Language identification by cross-parsing.

Per language, a suffix automaton of labelled text knows every substring of it. A new text
is cut greedily into the longest phrases that the automaton of a language knows; the fewer
phrases (normalised by the length of the text and the amount of labelled text), the closer
the language. The language with the lowest cross-entropy wins, ties go to the name that
sorts first.

Learning takes a bounded sample of labelled rows: per language the first rows in hash order
of the ids, ``fit_rows`` (200) at most, until their texts hold ``fit_chars`` (60,000)
characters; and the ``max_labels`` (64) most frequent languages. These bounds are the same at
every size of the input. Scoring takes whole texts: they are cut into lanes of ``LANE`` symbols which a task parses in step
with one another, so that the work is a few array operations per symbol.

A text that is null or holds no letter is ``und`` with score 0. Rows without a label or an
id teach nothing but are scored; repeated rows are scored each for itself; without any
labelled row everything is ``und``. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import is_held_out, texts_of

LANE = 2048
#: A label's rows are dealt into so many shares before its first rows are taken.
SHARES = 64
BLOCK_CHARS = 4_000_000
UNDETERMINED = "und"

#: Letters with the marks that belong to them; for texts below U+0250 the same as a short list.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_NOT_LATIN_LETTERS, _WIDE = re.compile("[^a-zªµºß-öø-ɏ]+"), re.compile("[^\x00-\u024f]")


def letters(text: str) -> bytes:
    """Lower-case letters and their marks as UTF-8, everything between them one blank; nothing without a letter."""
    low = text.lower()
    if not _WIDE.search(low):
        plain = _NOT_LATIN_LETTERS.sub(" ", low).strip()
    else:
        plain = _NOT_LETTERS.sub(" ", low).strip()
        if not any(map(str.isalpha, plain)):
            return b""
    return f" {plain} ".encode("utf-8", "surrogatepass") if plain else b""


def suffix_automaton(data: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``data`` (symbols below ``width``): states x width, 0 for none.

    State 0 has no way out, state 1 is the start. Built state by state on the driver from a
    bounded text; at most two states per symbol.
    """
    move: list[list[int]] = [[0] * width, [0] * width]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in data.tolist():
        new = len(move)
        move.append([0] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and not move[p][c]:
            move[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(move)
                move.append(move[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p and move[p][c] == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array(move, np.int32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbols: np.ndarray  # byte -> symbol, 0 for bytes that no labelled text holds
    tables: tuple[np.ndarray, ...]  # flattened transitions, states already multiplied by width
    width: int
    learnt: tuple[int, ...]  # symbols of labelled text per language


def build(samples: dict[str, bytes]) -> Model:
    languages = tuple(sorted(lang for lang, text in samples.items() if text))
    seen = sorted(set(b"".join(samples[lang] for lang in languages)))
    symbols = np.zeros(256, np.int64)
    symbols[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    tables = []
    for lang in languages:
        data = symbols[np.frombuffer(samples[lang], np.uint8)]
        tables.append((suffix_automaton(data, width) * width).ravel())
    return Model(languages, symbols, tuple(tables), width, tuple(len(samples[lang]) for lang in languages))


def phrases(model: Model, texts: Sequence[bytes]) -> np.ndarray:
    """Phrases per text and language. Texts are parsed in lanes; each lane begins a phrase."""
    owner, lengths, starts = [], [], []
    at = 0
    for i, text in enumerate(texts):
        for cut in range(0, len(text), LANE):
            owner.append(i)
            starts.append(at + cut)
            lengths.append(min(LANE, len(text) - cut))
        at += len(text)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not owner:
        return out
    order = np.argsort(-np.array(lengths), kind="stable")
    owner, lengths, starts = (np.array(x)[order] for x in (owner, lengths, starts))
    data = model.symbols.astype(np.int32)[np.frombuffer(b"".join(texts), np.uint8)]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for k, table in enumerate(model.tables):
        begin = model.width  # state 1
        from_start = table[begin : begin + model.width]
        state = np.full(len(starts), begin, np.int32)
        count = np.ones(len(starts), np.int32)
        for step, n in enumerate(active.tolist()):
            symbol = data[starts[:n] + step]
            following = table[state[:n] + symbol]
            missed = np.flatnonzero(following == 0)
            if len(missed):
                # The phrase ends before this symbol, which begins the next one; an unknown symbol is one by itself.
                again = from_start[symbol[missed]]
                unknown = again == 0
                following[missed] = np.where(unknown, begin, again)
                count[missed] += (state[missed] != begin).astype(np.int32) + (unknown & (lengths[missed] > step + 1))
            state[:n] = following
        np.add.at(out[:, k], owner, count)
    return out


def verdicts(model: Model, texts: Sequence[bytes]) -> list[tuple[str, float]]:
    """Language and score of each prepared text."""
    if not model.languages:
        return [(UNDETERMINED, 0.0)] * len(texts)
    found = phrases(model, texts)
    weight = np.log2(np.maximum(model.learnt, 2))
    out = []
    for row, text in zip(found, texts):
        if not text:
            out.append((UNDETERMINED, 0.0))
            continue
        bits = row * weight
        best = int(np.argmin(bits))
        # The share of the best language if each were as likely as its code is short.
        share = 1.0 / np.exp2(np.clip(bits[best] - bits, -60, 0) * min(1.0, 64 / len(text))).sum()
        out.append((model.languages[best], float(share)))
    return out


def labelled_sample(
    docs: DataFrame, *, fit_chars: int, fit_rows: int, max_labels: int, id_col: str, text_col: str, label_col: str, may_learn: Column | None,
) -> dict[str, bytes]:
    """Letters of whole texts per label: rows in hash order of the id until they hold ``fit_chars`` characters.

    Only ids, labels and lengths are sorted, in shares first; the texts of the chosen ids are
    fetched afterwards. Of more than ``max_labels`` labels the most frequent ones are learnt
    (ties by name). What reaches the driver is bounded by ``max_labels`` x ``fit_rows`` texts, of
    which all but the last of a label fit into ``fit_chars`` together, and that one is cut there.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), docs[label_col].cast("string").alias("label"),
        F.xxhash64(docs[id_col].cast("long")).alias("h"), F.length(docs[text_col]).alias("size"),
        (F.lit(True) if may_learn is None else may_learn).alias("ok"),
    ).filter("ok AND label IS NOT NULL AND id IS NOT NULL AND size > 0").drop("ok")
    known = [r.label for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()]
    if not known:
        return {}
    rows = rows.filter(F.col("label").isin(known))
    for keys in (["label", F.pmod("h", F.lit(SHARES))], ["label"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))).filter(F.col("place") <= fit_rows)
    before = Window.partitionBy("label").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("before") < fit_chars)
    chosen = rows.select(F.col("id").alias("chosen_id"), "label", "place", (F.lit(fit_chars) - F.col("before")).cast("int").alias("room"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    # At most max_labels x fit_rows rows of four numbers and a name: a proven bound.
    met = texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"))
    got: dict[str, list] = {}
    for r in met.select("label", "place", "id", F.substring("text", F.lit(1), F.col("room")).alias("text")).toLocalIterator():
        got.setdefault(r.label, []).append((r.place, r.text))
    found = {label: b"".join(letters(t) for _, t in sorted(parts)) for label, parts in got.items()}
    return {label: text for label, text in found.items() if text}


def predict(
    docs: DataFrame, *, fit_chars: int = 60_000, fit_rows: int = 200, max_labels: int = 64, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Held-out rows (see ``common.is_held_out``) teach nothing."""
    held_out = is_held_out(docs[id_col])
    model = build(labelled_sample(
        docs, fit_chars=fit_chars, fit_rows=fit_rows, max_labels=max_labels, id_col=id_col, text_col=text_col, label_col=label_col,
        may_learn=~held_out,
    ))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            block, size = [], 0
            for text in texts_of(batch):
                block.append(letters(text))
                size += len(block[-1])
                if size > BLOCK_CHARS:
                    found += verdicts(shared.value, block)
                    block, size = [], 0
            found += verdicts(shared.value, block)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    chosen = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("text")
    )
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def bits_per_symbol(model: Model, text: str) -> dict[str, float]:
    """Cross-entropy estimate per language: phrases x log2(labelled symbols) / symbols."""
    prepared = letters(text)
    row = phrases(model, [prepared])[0]
    return {
        lang: float(n) * log2(max(size, 2)) / max(len(prepared), 1)
        for lang, n, size in zip(model.languages, row, model.learnt)
    }

"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (its classes are fixed, so it is
   at most 64^3 numbers, summed by Spark).
2. Suspicious stretches (letters mixed with look-alike signs anywhere, single characters set
   apart by one to four others, a character three times or more in a row) become a lattice: a
   sign may stand for several letters, a separator, a repeated character or a closing ``!``
   may be dropped. Viterbi picks the path that the trigram model likes best.
3. Plain and restored words are scored by features learnt from labelled rows: whole words
   and word beginnings. Beginnings matter where insults are inflected. A feature is taken
   only if it explains toxic rows that the features before it do not, so words that merely
   come along with copies of a toxic text are left out.

Labels are learnt from a bounded sample: ``fit_rows`` rows of either label in hash order of
the id. Everything else covers all documents.

A text that is null or empty gets the score of a text without features. Null ids are scored
and teach nothing; rows without a label or with a null label teach nothing; a repeated row
is scored each for itself and may teach more than once. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import id_and_text, is_held_out, pack, texts_of

#: Class 0 is "no letter", 1-26 a-z, 27-62 the letters from U+00DF on, 63 any other letter.
CLASSES = 64
_FIRST_WIDE = 0xDF

#: Signs and the letters they may stand for. Fixed values.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
_SIGNS = re.escape("".join(LOOK_ALIKES))
_LETTER = r"[^\W\d_]"

#: Signs that can only be read or dropped; ``*`` and the rest set characters apart as well.
_BARE = re.escape("".join(c for c in LOOK_ALIKES if not c.isalnum() and c != "*"))
#: Signs that may be plain punctuation at the end of a stretch.
_ENDINGS = "!|*+("

#: A run of letters, digits and signs. What lies within a run is looked at once for each different run.
_RUN = re.compile(rf"[\w{_SIGNS}]+")
_SIGN, _ANY_LETTER = re.compile(f"[{_SIGNS}]"), re.compile(_LETTER)
_ONE, _GAP = rf"(?:[^\W_]|[{_BARE}])", rf"(?:[^\w{_BARE}]|_)"
#: Single characters and signs between separators that are no signs, then letters and digits between any separators.
_APART = re.compile(rf"(?<![\w{_SIGNS}])(?:{_ONE}{_GAP}{{1,4}}){{2,}}{_ONE}(?![\w{_SIGNS}])"), re.compile(_GAP + "+")
_SPELT = re.compile(r"(?<!\w)(?:[^\W_][\W_]{1,4}){2,}[^\W_](?!\w)"), re.compile(r"[\W_]+")
#: A character of a run that could stand apart: a letter or digit between others, a sign between separators.
_ALONE = re.compile(rf"(?<![^\W_])[^\W_](?![^\W_])|(?<![^\W_{_BARE}])(?<![{_BARE}])[{_BARE}](?![^\W_{_BARE}])(?![{_BARE}])")
_PLAIN_WORDS, _TRIPLE = re.compile(r"\w+"), re.compile(rf"({_LETTER})\1\1")
_WORD = re.compile(rf"{_LETTER}+")

BEGINNINGS = (4, 5, 6, 7)

#: A task forgets the runs it has seen when there are more than this many; longer ones are not kept.
CACHE_RUNS, CACHE_CHARS = 1_000_000, 64


def letter_class(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    if not char.isalpha():
        return 0
    place = ord(char) - _FIRST_WIDE
    return 27 + place if 0 <= place < 36 else 63


_CLASS_TABLE = np.array([letter_class(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x3000)], np.int32)


def classes_of(text: str) -> np.ndarray:
    """Letter classes of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _CLASS_TABLE[np.minimum(points, 0x2FFF)]
    return np.where(points < 0x3000, low, 63)


def trigram_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(code, n): occurrences of every trigram of letter classes over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                c = np.concatenate([[0, 0], classes_of(text.lower()), [0]])
                _add_counts(total, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    partial = id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, "code long, n long")
    return partial.groupBy("code").agg(F.sum("n").alias("n"))


def _add_counts(total: np.ndarray, codes: np.ndarray) -> None:
    """Counts codes into ``total``: long texts in one pass over it, short ones by their few codes."""
    if len(codes) > CLASSES**2:
        total += np.bincount(codes, minlength=len(total))
    else:
        found, n = np.unique(codes, return_counts=True)
        total[found] += n


@dataclass
class CharModel:
    """log P(letter | two before), add-one smoothed over letter classes."""

    logs: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        return self.logs.ravel().tolist()

    @classmethod
    def from_counts(cls, codes: np.ndarray, counts: np.ndarray) -> CharModel:
        table = np.zeros(CLASSES**3)
        table[codes] = counts
        table = table.reshape(CLASSES, CLASSES, CLASSES) + 0.1
        return cls(np.log(table / table.sum(axis=2, keepdims=True)))


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """Per character of a stretch what it may stand for ('' is nothing) and at which cost."""
    out: list[list[tuple[str, float]]] = []
    end = len(stretch.rstrip(_ENDINGS))
    for i, char in enumerate(stretch):
        if char.isalpha():
            options = [(char, 0.0)]
            if i and stretch[i - 1] == char:
                options.append(("", 1.0))
        elif char in LOOK_ALIKES:
            options = [(letter, 1.0) for letter in LOOK_ALIKES[char]] + [("", 8.0 if i < end else 1.0)]
        else:
            options = [("", 0.0)]
        out.append(options)
    return out


def restore(stretch: str, model: CharModel) -> str:
    """The most likely plain word behind a stretch: Viterbi over (letter before last, last letter).

    Paths are chains of (letters before, letter), so that a stretch of any length takes linear time.
    """
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
    flat = model.flat
    for options in lattice(stretch):
        following: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            row = (_class(a) * CLASSES + _class(b)) * CLASSES
            for letter, cost in options:
                if letter:
                    key, value, way = (b, letter), score - cost + flat[row + _class(letter)], (path, letter)
                else:
                    key, value, way = (a, b), score - cost, path
                if key not in following or value > following[key][0]:
                    following[key] = (value, way)
        best = following
    ended = [(score + flat[(_class(a) * CLASSES + _class(b)) * CLASSES], path) for (a, b), (score, path) in best.items()]
    top = max(score for score, _ in ended)
    return max(_spelt_out(path) for score, path in ended if score == top)


@lru_cache(maxsize=10_000)
def _class(letter: str) -> int:
    return letter_class(letter) if letter else 0


def _spelt_out(path: tuple | None) -> str:
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def stretches(low: str) -> set[str]:
    """Stretches of a lower-case text that may hide a word."""
    runs = _RUN.findall(low)
    found = set().union(*map(_stretches_in, set(runs)))
    alone = {run for run in set(runs) if len(run) == 1 or _ALONE.search(run)}
    gaps = set(filter(_is_gap, runs))
    return found | _set_apart(low) if alone and _may_stand_apart(runs, alone, gaps) else found


def _stretches_in(run: str) -> set[str]:
    """Of a run: itself if it mixes signs and letters, and its words with a character three times or more in a row."""
    found = {run} if len(run) > 2 and _SIGN.search(run) and _ANY_LETTER.search(run) else set()
    if _TRIPLE.search(run):
        found |= {word for word in _PLAIN_WORDS.findall(run) if _TRIPLE.search(word)}
    return found


def _is_gap(run: str) -> bool:
    """Signs alone: they may stand between two characters set apart."""
    return len(run) > 1 and not any(map(str.isalnum, run))


def _may_stand_apart(runs: list[str], alone: set[str], gaps: set[str]) -> bool:
    """Whether three characters of a text can stand apart at all: inside of one of its runs, or as three runs one after the other."""
    if any(len(run) > 1 for run in alone):
        return True
    if sum(map(runs.count, alone)) < 3:
        return False
    between = [run for run in runs if run not in gaps] if gaps else runs
    return b"\1\1\1" in bytes(map((1).__eq__, map(len, between)))


def _set_apart(low: str) -> set[str]:
    found: set[str] = set()
    for apart, gaps in (_APART, _SPELT):
        for m in apart.finditer(low):
            found |= _joined(m.group(), gaps)
    return found


def _joined(run: str, gaps: re.Pattern) -> set[str]:
    """Characters set apart, put together: the whole run, and the words between gaps wider than its narrowest."""
    narrow = min(len(g) for g in gaps.findall(run))
    words = gaps.sub(lambda g: "" if len(g.group()) == narrow else "\0", run).split("\0")
    return {"".join(words)} | {w for w in words if len(w) > 2}


class Reader:
    """Reads texts as words, plain and restored; what a run means is worked out once, up to a bound.

    ``odd`` has the runs that are more than one plain word, with their words; ``alone`` those in
    which a character stands by itself; ``gaps`` those of signs alone.
    """

    def __init__(self, model: CharModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.seen: set[str] = set()
        self.odd: dict[str, frozenset[str]] = {}
        self.alone: set[str] = set()
        self.gaps: set[str] = set()
        self.restored: dict[str, str] = {}

    def restore(self, stretch: str) -> str:
        word = self.restored.get(stretch)
        if word is None:
            word = restore(stretch, self.model)
            if len(stretch) <= CACHE_CHARS:
                self.restored[stretch] = word
        return word

    def learn(self, run: str) -> None:
        if len(run) > 1 and run.isalpha() and not _TRIPLE.search(run):
            return
        words = set(_WORD.findall(run))
        words |= {word for stretch in _stretches_in(run) if (word := self.restore(stretch))}
        if words != {run}:
            self.odd[run] = frozenset(words)
        if len(run) == 1 or _ALONE.search(run):
            self.alone.add(run)
        if _is_gap(run):
            self.gaps.add(run)

    def runs(self, low: str) -> tuple[set[str], set[str]]:
        """The runs of a lower-case text that are plain words, and the words of all the others."""
        listed = _RUN.findall(low)
        runs = set(listed)
        if len(self.seen) > CACHE_RUNS:
            self.forget()
        fresh = runs - self.seen
        for run in fresh:
            self.learn(run)
        words: set[str] = set()
        odd = runs & self.odd.keys()
        for run in odd:
            words |= self.odd[run]
        alone = runs & self.alone
        if alone and _may_stand_apart(listed, alone, runs & self.gaps):
            words |= {word for stretch in _set_apart(low) if (word := self.restore(stretch))}
        for run in fresh:
            if len(run) > CACHE_CHARS:  # long ones are not kept
                self.odd.pop(run, None)
                self.alone.discard(run)
                self.gaps.discard(run)
            else:
                self.seen.add(run)
        return runs - odd, words

    def words(self, text: str) -> set[str]:
        """Plain and restored words of a text."""
        plain, words = self.runs(text.lower())
        return plain | words


def features_of(words: set[str]) -> set[str]:
    """Whole words ("=word"), beginnings ("begi"), and beginnings of two or more different words ("2begi")."""
    found = {"=" + w for w in words if len(w) > 2}
    for n in BEGINNINGS:
        found |= beginnings(words, n)
    return found


def beginnings(words: set[str], n: int) -> set[str]:
    once, twice = set(), set()
    for w in words:
        if len(w) >= n:
            (twice if w[:n] in once else once).add(w[:n])
    return once | {"2" + b for b in twice}


@dataclass
class Scorer:
    """Chosen features with their weights (log odds), added to the log odds of a text without any."""

    weights: dict[str, float] = field(default_factory=dict)
    base: float = -3.0

    def __post_init__(self):
        self.whole = {f[1:]: w for f, w in self.weights.items() if f[0] == "="}
        self.once = {f: w for f, w in self.weights.items() if f[0] not in "=2"}
        self.twice = {f[1:]: w for f, w in self.weights.items() if f[0] == "2"}
        self.starts = {*self.once, *self.twice}
        self.lengths = sorted(set(map(len, self.starts)))

    def matters(self, word: str) -> bool:
        """Whether a word can have part in any feature."""
        if word in self.whole:
            return True
        for n in self.lengths:
            if len(word) >= n and word[:n] in self.starts:
                return True
        return False

    def score(self, words: set[str]) -> float:
        hits = [self.whole[w] for w in words if w in self.whole]
        for n in self.lengths:
            starts = Counter(w[:n] for w in words if len(w) >= n)
            hits += [self.once[b] for b in starts if b in self.once]
            hits += [self.twice[b] for b, times in starts.items() if times > 1 and b in self.twice]
        odds = self.base + math.fsum(hits)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds))))


class TextScorer:
    """Scores texts; a plain word that no feature looks at is recognised by being known."""

    def __init__(self, model: CharModel, scorer: Scorer):
        self.reader, self.scorer = Reader(model), scorer
        self.known: set[str] = set()
        self.wanted: set[str] = set()

    def score(self, text: str) -> float:
        plain, words = self.reader.runs(text.lower())
        fresh = plain - self.known
        if fresh:
            if len(self.known) > CACHE_RUNS:
                self.known.clear()
                self.wanted.clear()
                fresh = plain
            self.wanted.update(filter(self.scorer.matters, fresh))
            self.known |= fresh
        return self.scorer.score(words | (plain & self.wanted))


#: A label's rows are dealt into so many shares before its first rows are taken.
SHARES = 64

#: A toxic row counts as explained when so many of its features have been chosen.
ENOUGH = 4


def choose(
    toxic_rows: list[np.ndarray], names: list[str], clean_counts: np.ndarray, *, n_clean: int, weight: float, min_rows: int,
) -> Scorer:
    """Greedy cover: again and again the feature that most toxic rows still in need of one have, clean rows counted against it."""
    rows = [list(map(int, r)) for r in toxic_rows]
    holders: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        for f in row:
            holders.setdefault(f, []).append(i)
    share = {f: len(h) / (len(h) + 0.5 + weight * float(clean_counts[f])) for f, h in holders.items()}
    prior = max(len(rows), 1) / max(len(rows) + weight * n_clean, 2.0)
    gain = Counter({f: len(h) for f, h in holders.items() if share[f] >= min(0.9, 2 * prior)})
    need, chosen = [ENOUGH] * len(rows), {}
    while gain:
        f = max(gain, key=lambda x: (gain[x] * (share[x] - prior), names[x][0] == "=", len(names[x]), names[x]))
        if gain[f] < min_rows:
            del gain[f]
            continue
        sure = min(share[f], 0.999)
        chosen[names[f]] = math.log(sure / (1 - sure)) - math.log(prior / (1 - prior))
        kin = [g for g in gain if _related(names[f], names[g])]  # the same word said again
        for g in kin:
            del gain[g]
        for i in holders[f]:
            need[i] -= 1
            if need[i] == 0:
                for g in rows[i]:
                    if g in gain:
                        gain[g] -= 1
    missed = sum(n == ENOUGH for n in need)
    base = (missed + 0.5) / (missed + weight * max(n_clean, 1) + 1.0)
    return Scorer(chosen, min(math.log(base / (1 - base)), -2.0))


def _related(one: str, other: str) -> bool:
    """Whether of two features one is a beginning of the other (a feature is related to itself)."""
    a, b = one.lstrip("=2"), other.lstrip("=2")
    return (one[0] == "2") == (other[0] == "2") and (a.startswith(b) or b.startswith(a))


def fit(
    docs: DataFrame, labels: DataFrame, model: CharModel, *, fit_rows: int = 4000, min_rows: int = 4, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Scorer:
    """Learn features from a bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)"
    )
    known = known.filter(~is_held_out(F.col("doc_id")))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # First among the rows of a share of each label, then among the first of all shares.
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    for keys in (["toxic", F.pmod("h", F.lit(SHARES))], ["toxic"]):
        hashed = hashed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).filter(F.col("place") <= fit_rows)
    chosen = hashed.select("doc_id", "toxic")
    # At most 2 x fit_rows rows of two numbers: a proven bound.
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, reader = Counter(), Counter(), Reader(shared.value)
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), texts_of(batch)):
                (toxic if label else clean).update(features_of(reader.words(text)))
        names = list(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names + list(clean), pa.string()), pa.array([toxic[f] for f in names] + [0] * len(clean), pa.int64()),
             pa.array([0] * len(names) + list(clean.values()), pa.int64())],
            ["feature", "n_toxic", "n_clean"],
        )

    counted = sample.mapInArrow(count, "feature string, n_toxic long, n_clean long").groupBy("feature").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")
    )
    n_toxic, n_clean = min(totals.get(1, 0), fit_rows), min(totals.get(0, 0), fit_rows)
    if not n_toxic:
        return Scorer()
    # Weight of a clean row of the sample against a toxic one.
    weight = (totals.get(0, 0) / max(n_clean, 1)) / (totals[1] / n_toxic)
    good = counted.filter((F.col("n_toxic") >= min_rows) & (F.col("n_toxic") >= weight * F.col("n_clean")))
    rows = good.collect()
    if not rows:
        return Scorer()
    names = sorted(r.feature for r in rows)
    place = {name: i for i, name in enumerate(names)}
    clean_counts = np.zeros(len(names))
    for r in rows:
        clean_counts[place[r.feature]] = r.n_clean
    wanted = spark.sparkContext.broadcast(place)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            held = [
                sorted(wanted.value[f] for f in features_of(reader.words(t)) if f in wanted.value)
                for t in texts_of(batch)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["features"])

    toxic_rows = sample.filter("toxic = 1").mapInArrow(members, "features array<int>").collect()
    return choose(
        [np.array(r.features, int) for r in toxic_rows], names, clean_counts, n_clean=n_clean, weight=weight, min_rows=min_rows,
    )


def char_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CharModel:
    counts = trigram_counts(docs, id_col, text_col).toPandas()
    return CharModel.from_counts(counts["code"].to_numpy(), counts["n"].to_numpy())


def scores(
    docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, threshold: float = 0.3, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with held_out, score and predicted (0 or 1)."""
    model = char_model(docs, id_col, text_col)
    scorer = fit(docs, labels, model, fit_rows=fit_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = TextScorer(*shared.value)
        for batch in texts:
            yield pd.Series([scorer.score(t or "") for t in batch], dtype="float64")

    scored = docs.select(
        pack(docs).alias("doc"), is_held_out(docs[id_col]).alias("held_out"),
        score(docs[text_col].cast("string")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

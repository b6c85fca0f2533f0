"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; policies are versioned sets of bits. Applying another policy, or asking
what a policy would do without one of its rules, is bitwise arithmetic on the ledger and
never reads a text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null text has no words (like an empty one), so
it fails ``few_words``. A null id is kept as it is; repeated rows are judged alike, each for
itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import id_and_text, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stutter",
)


@dataclass(frozen=True)
class Rule:
    """A named test on measurements; ``fails`` is SQL that both Spark and other engines read."""

    name: str
    fails: str


#: The bit of a rule is its place. New rules are appended, so that old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("exclamations", "100 * n_exclaim > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("stuttering", "100 * n_stutter > 30 * n_words"),
)

BIT = {rule.name: 1 << place for place, rule in enumerate(RULES)}

#: Versions of what is asked of a document. Old versions stay.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(rule.name for rule in RULES),
}


def policy_mask(policy: str | Sequence[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BIT[name] for name in set(names))


def repeated_word_places(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered = reach = 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + WINDOW - max(start, reach)
            reach = start + WINDOW
    return covered


_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_BLANKS = b" \t\n\x0b\x0c\r"


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the ASCII blanks
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    return (
        len(words), len(text) - count(_BLANKS), count(SYMBOLS.encode()), len(lines) - len(set(lines)),
        repeated_word_places(words), len(lines), count(_UPPER), count(b"!"), sum(map(eq, words, words[1:])),
    )


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``MEASURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(measure, texts_of(batch)))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *MEASURES]
            )

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``fail_bits`` with one bit per failed rule."""
    return measurements(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def apply_policy(ledger_rows: DataFrame, policy: str | Sequence[str]) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    mask = policy_mask(policy)
    return ledger_rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(ledger_rows: DataFrame, policy: str | Sequence[str]) -> DataFrame:
    """Per rule of a policy: documents failing it, and documents that only it rejects.

    The ledger is first counted by its masked bits: at most two to the number of rules rows,
    whatever the corpus. An empty ledger gives no rows.
    """
    mask = policy_mask(policy)
    by_bits = (
        ledger_rows.select(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits"))
        .groupBy("bits")
        .agg(F.count("*").alias("n"))
    )
    names = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in names])
    each = by_bits.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    kept = F.col("bits") == 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(kept | alone, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )

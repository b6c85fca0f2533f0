"""Cheapest repair of conversations by weighted interval parsing.

A conversation is well formed if its role initials are ``(s?(ua)+)?``: an optional system
turn, then pairs of user and assistant. Edits keep a row (0), give it the role user or
assistant (2), delete it (3, forced for blank and repeated rows) or insert an empty user or
assistant row (2); a truncated row that is not deleted costs 1 more. The result is the
cheapest repair; of equal ones the one whose edit initials (the audit) come first in ASCII.

**Grammar.** In Chomsky normal form with a nonterminal ``pq`` for each way a span can lead
from p to q, where p and q say what stands so far: 0 nothing, 1 a system row, 2 a pair that
is open, 3 a pair that is closed. Binary rules are ``pq -> pr rq``, the terminal rules are the
edits of one row, and the insertion closure stands around each row. A cell holds the least
(cost, audit) of each nonterminal over its span. Spans are combined bottom-up by length.
Over one span no audit of equal cost is the beginning of another (what is longer has more
insertions), so the least of a concatenation is made of least parts; and as a nonterminal
names both ends, a span may be split anywhere with the same outcome. So spans of lengths
1, 2, 4, 8 ... are enough, and a conversation of n rows takes n combinations.

**On Spark.** Equal rows of a turn are counted before any shuffle. Rows are range-partitioned
by (conversation, turn, role, text), so a huge conversation lies in many partitions, one
after the other; each partition reads its rows once, in order, and gives one span for each
conversation in it. Only the first and the last conversation of a partition can go on
elsewhere: their spans, at most two a partition, are combined by conversation. The digest
of a repaired text is sequential by nature: for conversations in several partitions one task
reads their rows in order, one at a time.

Nulls count as one space in the damage key, in role and text; null turns come first; the null
conversation is one like any other. Rows of equal turn stand in the order of role and text. A
row's initial is the first character of its role; an empty role has none and fits nowhere
unless it gets another role. Repeated rows are rows. An empty table has no rows. Only the
four columns are read, so no other can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseweave.session import freeze

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A parsed sequence of rows is remembered if it is no longer than this ...
MEMO_ROWS = 64
#: ... and there are no more than so many.
MEMO_SIZE = 100_000

USER, ASSISTANT = "user", "assistant"
_SOLID = re.compile(r"[^\x20\x09-\x0D]").search
_LEGAL = frozenset(("su", "ua", "au"))
#: Where an initial leads to from what stands so far.
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

Cell = dict[tuple[int, int], tuple[int, str]]

#: Insertions alone, between any two places.
_CLOSURE: Cell = {(p, p): (0, "") for p in range(4)} | {
    (0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (3, 2): (INSERT, "I"), (2, 3): (INSERT, "I"),
    (0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II"),
}


def combine(left: Cell, right: Cell) -> Cell:
    """The rule ``pq -> pr rq`` over two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                found = (cost + other[0], audit + other[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


@lru_cache(maxsize=None)
def leaf(code: str) -> Cell:
    """One row: ``u a s o`` by its initial, upper case if truncated, ``d`` if it has to go."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "d":
        more = TRUNCATED if code.isupper() else 0
        for initial, steps in _STEP.items():
            for p, q in steps.items():
                if initial == code.lower():
                    edits[p, q] = (KEEP + more, "K")
                elif initial != "s":
                    edits.setdefault((p, q), (REROLE + more, "R"))
    return combine(combine(_CLOSURE, edits), _CLOSURE)


def _bottom_up(cells: list[Cell]) -> Cell:
    """The cell over all of ``cells``, spans of twice the length at a time."""
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0]


def span(codes: str) -> Cell:
    """The cell of a sequence of rows, bottom-up by the length of spans."""
    if not codes:
        return _CLOSURE
    return _bottom_up([leaf(c) for c in codes])


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, 0], cell[0, 3]) if (0, 3) in cell else cell[0, 0]


_remembered = lru_cache(maxsize=MEMO_SIZE)(span)


def parse(codes: str) -> Cell:
    return _remembered(codes) if len(codes) <= MEMO_ROWS else span(codes)


class Repaired:
    """Walks along an audit and hands out the lines of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[str]:
        """Lines inserted here, before the next row."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role() + ":"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _STEP[role[:1]][self.state]
            yield f"{role}:{text}"
        elif edit == "R":
            yield f"{self._role()}:{text}"

    def _role(self) -> str:
        user = self.state != 2
        self.state = 2 if user else 3
        return USER if user else ASSISTANT


class _Digest:
    """SHA-256 of lines joined by newlines, one line at a time."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, lines: Iterator[str]) -> None:
        for line in lines:
            self.sha.update((("\n" if self.some else "") + line).encode())
            self.some = True


class _Segment:
    """What one stretch of a conversation's rows comes to."""

    def __init__(self):
        self.codes: list[str] = []
        self.rows: list[tuple[str, str, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.live = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, repeated: bool) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.live:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        self.illegal += copies - 1
        self.live += copies
        if turn is not None:
            self.turns += turn != self.high
            self.high = turn
            self.low = turn if self.low is None else self.low
        if not _SOLID(text):
            self.blank += copies
            self.codes.append("d" * copies)
        elif repeated:
            self.duplicate += copies
            self.codes.append("d" * copies)
        else:
            self.duplicate += copies - 1
            code = initial if initial in _STEP else "o"
            if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?":
                self.truncated += 1
                code = code.upper()
            self.codes.append(code + "d" * (copies - 1))
        self.rows.append((role, text, copies))

    def outcome(self, whole: bool) -> tuple:
        cell = parse("".join(self.codes))
        cost = audit = sha = None
        if whole:
            cost, audit = best(cell)
            walk, digest = Repaired(audit), _Digest()
            for role, text, copies in self.rows:
                for _ in range(copies):
                    digest.add(walk.row(role, text))
            digest.add(walk.inserted())
            sha = digest.sha.hexdigest()
        names = None if whole else [f"{p}{q}{c}:{a}" for (p, q), (c, a) in cell.items()]
        return (self.live, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last,
                self.low, self.high, self.turns, cost, audit, sha, names)


_SEGMENT = (
    "live long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, cost long, audit string, sha string, cells array<string>"
)
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and copies (0 if dropped) of every row, damaged by the crc32 of ``conv_id:turn``."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(rows[conv]), F.lit(":"), blank(rows[turn])).cast("binary")) % 20
    return rows.select(
        rows[conv].alias("conv_id"), rows[turn].cast("long").alias("turn"),
        F.when(kind == 4, USER).otherwise(blank(rows[role])).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(rows[text]), "[.!?]", "")).otherwise(blank(rows[text])).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def as_they_are(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns without damage, for repair of real conversations."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return rows.select(
        rows[conv].alias("conv_id"), rows[turn].cast("long").alias("turn"), blank(rows[role]).alias("role"),
        blank(rows[text]).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` has conv_id, turn, role, text and copies, as ``damaged`` and ``as_they_are`` give them.
    """
    counted = _with_repeats(rows)
    segments = freeze(_segments(counted), "spans")
    whole = segments.filter("cells IS NULL")
    empty = F.lit(hashlib.sha256().hexdigest())
    done = whole.select("conv_id", _gaps("low", "high", "turns"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.coalesce("sha", empty).alias("repaired_sha256"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    joined = freeze(
        segments.filter("cells IS NOT NULL").groupBy("conv_id").applyInArrow(_joined, f"conv_id {kind}, {_RESULT}"), "joined"
    )
    texts = _digests_in_order(counted, joined, kind)
    return done.unionByName(joined.join(texts, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"))


def _gaps(low: str, high: str, turns: str) -> Column:
    return F.coalesce(F.col(high) - F.col(low) + 1 - F.col(turns), F.lit(0)).cast("long").alias("gaps")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, their number, and whether the same role and text stand in an earlier turn."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    counted = freeze(counted.withColumn("digest", digest), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    earliest = (
        counted.filter("copies > 0").groupBy("conv_id", "digest").agg(F.min(place).alias("first_place"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first_place")
    )
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))
    repeated = F.coalesce(place > F.col("first_place"), F.lit(False)).alias("repeated")
    return counted.join(earliest, met, "left").select("conv_id", "turn", "role", "text", "copies", repeated)


def _streamed(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        arrays = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(a[k].as_py() for a in arrays)


def _segments(counted: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([counted.schema["conv_id"]]).add("part", T.IntegerType())
    for field in T.StructType.fromDDL(_SEGMENT):
        schema.add(field)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's first and last conversation may go on in its neighbours."""
        now, key, part, is_first, out = None, None, None, True, []
        for conv, turn, role, text, copies, repeated, part in _streamed(batches, (*order, "copies", "repeated", "part")):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, part, *now.outcome(whole=not is_first)))
                    is_first = False
                now, key = _Segment(), conv
            now.add(turn, role, text, copies, repeated)
            if len(out) >= 1000:
                yield _batch(out, arrow)
                out = []
        if now is not None:
            out.append((key, part, *now.outcome(whole=False)))
            yield _batch(out, arrow)

    return ranged.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _joined(spans: pa.Table) -> pa.Table:
    """The spans of one conversation, at most one a partition, put together in order."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    last, low, high, cells = None, None, None, []
    for row in sorted(spans.to_pylist(), key=lambda r: r["part"]):
        for name in total:
            total[name] += row[name]
        if row["live"]:
            total["illegal"] += last is not None and last + row["first"] not in _LEGAL
            last = row["last"]
        if row["low"] is not None:
            total["turns"] -= high == row["low"]
            low, high = (row["low"] if low is None else low), row["high"]
        parsed = ((name[:2], *name[2:].split(":")) for name in row["cells"])
        cells.append({(int(ends[0]), int(ends[1])): (int(cost), audit) for ends, cost, audit in parsed})
    cost, audit = best(_bottom_up(cells))
    turns = total.pop("turns")
    found = {"conv_id": spans["conv_id"][0].as_py(), "gaps": 0 if low is None else high - low + 1 - turns, **total, "cost": cost, "audit": audit}
    types = [spans.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
    return pa.table([pa.array([v], t) for v, t in zip(found.values(), types)], names=list(found))


def _digests_in_order(counted: DataFrame, joined: DataFrame, kind: str) -> DataFrame:
    """of (conv_id) and repaired_sha256: a conversation's audit, then its rows in order, one at a time."""
    audits = joined.select(F.col("conv_id").alias("of"), "audit")
    met = F.col("conv_id").eqNullSafe(F.col("of"))
    rows = counted.filter("copies > 0").join(audits.select("of"), met, "left_semi")
    stream = rows.select("conv_id", F.lit(1).alias("k"), "turn", "role", "text", "copies").unionByName(
        audits.select(F.col("of").alias("conv_id"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("turn"),
                      F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies")))
    order = ["conv_id", "k", "turn", "role", "text"]
    schema = T.StructType([T.StructField("of", joined.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = digest = key = None
        for conv, k, role, text, copies in _streamed(batches, ("conv_id", "k", "role", "text", "copies")):
            if k == 0:
                if walk is not None:
                    digest.add(walk.inserted())
                    yield _batch([(key, digest.sha.hexdigest())], arrow)
                walk, digest, key = Repaired(text), _Digest(), conv
                continue
            for _ in range(copies):
                digest.add(walk.row(role, text))
        if walk is not None:
            digest.add(walk.inserted())
            yield _batch([(key, digest.sha.hexdigest())], arrow)

    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)

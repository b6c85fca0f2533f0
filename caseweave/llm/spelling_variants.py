"""Spelling variants: all words one edit apart, found by walking a trie that is a table.

**Edge table.** Every word stands in the trie twice, read forwards and backwards (a mark in
front tells which). Words are range-partitioned and sorted, so all words below a node are
neighbours; a partition reads them once, in order, and gives one row for each edge:
(level, node, label, rest, how many words are below). Levels are single characters down to
``FINE`` and then grow by a half each, so that very long words take few levels. A node is named
by its path. Below an edge with one word only, the row holds the rest of that word. Masks of
the lengths and next characters below an edge tell early where nothing can follow.

**Frontier.** States are (word, position, node, edits). Level by level they are joined with the
edges of their node. Without an edit a state may replace a character (the edge's label is a
larger one) or delete one; with the edit spent, labels must match. A state that reaches a
word's end is a pair of neighbours. The other directions, insertion and smaller characters,
are the same pairs seen from the other word. A word enters the forward trie where its first
half ends, the backward trie where its second half ends (reading back): an edit stands in
one of the halves, so the other half is an exact path, and the crowded levels near the root
are never branched at. A node meets its own children only, whose number the alphabet
bounds, so the work for a node is linear in its words.

Every level is one job whose result is written to the shared folder. Nothing is collected but
the numbers of the levels.

Null texts have no words; a null id counts as an empty one in the damage key; repeated rows
count each for itself; no other column is read; an empty table has no rows. Of equally
frequent near words the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count as numbers
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseweave.llm.common import id_and_text
from caseweave.session import freeze

#: Words have at least so many code points ...
MIN_LENGTH = 7
#: ... and occurrences.
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: One run in so many loses a character in the damage.
DAMAGE = 31
#: Depth down to which every character is a level.
FINE = 32

RUN = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORWARD, _BACKWARD = "f", "b"
_BITS = 62


def words(docs: DataFrame, *, damage: bool = True, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of all words of the texts, long and frequent enough. With ``damage`` some runs lose a character."""
    texts = id_and_text(docs)
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{RUN}]{{{min_length},}}"), F.lit(0))).alias("run"))
    run = F.translate("run", _UPPER, _LOWER)
    if damage:
        runs = runs.select(run.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_length)
    else:
        runs = runs.select(run.alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def cut_depth(level: int) -> int:
    """Depth at which a level begins."""
    if level <= FINE:
        return level
    depth = FINE
    for _ in range(level - FINE):
        depth += depth // 2
    return depth


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _bit(key: str, at: int) -> int:
    return 1 << (ord(key[at]) % _BITS if at < len(key) else 0)


_ROWS = T.StructType()
for _name, _type in zip(
    ("seed", "level", "node", "label", "rest", "below", "n", "lens", "nexts"),
    (T.BooleanType(), T.IntegerType(), *[T.StringType()] * 3, *[T.LongType()] * 4),
):
    _ROWS.add(_name, _type)


def _rows_of(pairs: Iterator[tuple[str, int]], first_level: int) -> Iterator[tuple]:
    """Edges and seeds of sorted keys. The first and the last key may have neighbours elsewhere."""
    depths = [cut_depth(level) for level in range(FINE + 2)]
    open_: dict[int, list] = {}
    before, key, n = None, None, 0
    for following, following_n in _with_end(pairs):
        if key is not None:
            left = len(key) if before is None else _shared(before, key)
            right = len(key) if following is None else _shared(key, following)
            length = len(key)
            half = length // 2 if key[0] == _BACKWARD else (length - 1) // 2  # of the word: length - 1 characters
            for level in [level for level in open_ if before is None or depths[level + 1] > left]:
                yield _edge(level, open_.pop(level))
            for level in numbers(first_level):
                while len(depths) < level + 2:
                    depths.append(cut_depth(len(depths)))
                depth, end = depths[level], depths[level + 1]
                if depth > length or depth > max(left, right):
                    break
                if level in open_:
                    edge = open_[level]
                    edge[3] += 1
                    edge[5] |= 1 << min(length - end, _BITS)
                    edge[6] |= _bit(key, end)
                else:
                    open_[level] = [key[:depth], key[depth:end], key[end:], 1, n, 1 << min(max(length - end, 0), _BITS), _bit(key, end)]
                if depth < length and end > 1 + half:
                    yield True, level, key[:depth], None, key[depth:], 0, n, 0, 0
            before = key
        key, n = following, following_n
    for level, edge in open_.items():
        yield _edge(level, edge)


def _with_end(pairs: Iterator[tuple[str, int]]) -> Iterator[tuple[str | None, int]]:
    yield from pairs
    yield None, 0


def _edge(level: int, edge: list) -> tuple:
    node, label, rest, below, n, lens, nexts = edge
    return False, level, node, label, rest, below, n, lens, nexts


def _trie(counted: DataFrame, shortest: int) -> DataFrame:
    """Edges and seeds of both tries."""
    keys = counted.select(F.explode(F.array(F.concat(F.lit(_FORWARD), "word"), F.concat(F.lit(_BACKWARD), F.reverse("word")))).alias("key"), "n")
    arrow = to_arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((key.as_py(), n.as_py()) for batch in batches for key, n in zip(batch.column("key"), batch.column("n")))
        rows = _rows_of(pairs, 1 + shortest // 2)
        while block := list(islice(rows, 20_000)):
            yield _batch(block, arrow)

    return keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _ROWS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sub(at: Column | int, size: Column | int | None = None) -> Column:
    """``size`` characters of the state's word, or all that follow the first ``at``."""
    place = at if isinstance(at, Column) else F.lit(at)
    return F.substring("w", place + 1, F.length("w") if size is None else size)


def _open(to: Column) -> Column:
    """Whether the state, moved on to ``to``, ends with the only word below the edge, or may find its rest below."""
    left = F.length("w") - to
    follows = F.when(left > 0, F.ascii(_sub(to, 1)) % _BITS).otherwise(0)
    bit = lambda mask, at: F.call_function("shiftright", F.col(mask), at.cast("int")).bitwiseAND(F.lit(1)) == 1
    possible = (left >= 0) & bit("lens", F.greatest(F.least(left, F.lit(_BITS)), F.lit(0))) & bit("nexts", follows)
    return F.when(F.col("below") == 1, F.col("rest") == _sub(to)).otherwise(possible)


def _step(states: DataFrame, edges: DataFrame, depth: int, size: int) -> DataFrame:
    """One level: states (node, w, pos, edits, n) meet the edges of their node; gives (w, n, pos, node, v, vn)."""
    edges = (
        edges.groupBy("node", "label")
        .agg(F.sum("below").alias("below"), F.max("rest").alias("rest"), F.max("n").alias("vn"), F.bit_or("lens").alias("lens"), F.bit_or("nexts").alias("nexts"))
        .withColumnRenamed("node", "parent")
    )
    label, spent, alone = F.col("label"), F.col("edits") == 1, F.col("below") == 1
    over = F.col("pos") + size
    matched = spent & (label == _sub(F.col("pos"), size)) & _open(over)
    over_r, over_d = F.lit(depth + size), F.lit(depth + size + 1)
    if size == 1:
        replaced = ~spent & (label > _sub(depth, 1)) & _open(over_r)
        deleted = ~spent & (label == _sub(depth + 1, 1)) & (label != _sub(depth, 1)) & _open(over_d)
        ended = F.lit(False)
    else:
        near = lambda n: ~alone & (F.levenshtein(_sub(depth, n), label, 1) == 1)
        replaced = ~spent & (F.length("w") >= over_r) & (label > _sub(depth, size)) & near(size) & _open(over_r)
        deleted = ~spent & (F.length("w") >= over_d) & near(size + 1) & _open(over_d)
        rest = F.concat("label", "rest")
        smaller = (F.length(rest) < F.length(_sub(depth))) | ((F.length(rest) == F.length(_sub(depth))) & (rest > _sub(depth)))
        ended = ~spent & alone & smaller & (F.levenshtein(_sub(depth), rest, 1) == 1)
    met = states.join(edges, (F.col("node") == F.col("parent")) & (matched | replaced | deleted | ended))
    end = F.length("w")
    ways = F.array(F.when(matched, over), F.when(replaced, over_r), F.when(deleted, over_d), F.when(ended, end))
    moved = met.select("w", "n", F.explode(F.filter(ways, lambda p: p.isNotNull())).alias("pos"), F.concat("node", "label").alias("child"), "rest", "vn", "below")
    return moved.select(
        "w", "n", F.col("pos").cast("int").alias("pos"), F.when(~alone, F.col("child")).alias("node"),
        F.when(alone, F.concat("child", "rest")).alias("v"), "vn")


def neighbours(counted: DataFrame, *, shortest: int = MIN_LENGTH) -> DataFrame:
    """a, n_a, b, n_b: all ordered pairs of words (of word and n, none below ``shortest``) that are one edit apart."""
    spark = counted.sparkSession
    trie = freeze(_trie(counted, shortest).sortWithinPartitions("seed", "level"), "trie")
    found, frontier = [], None
    for level in sorted(r.level for r in trie.select("level").distinct().collect()):
        here = trie.filter(F.col("level") == level)
        depth = cut_depth(level)
        seeds = here.filter("seed").select("node", F.concat("node", "rest").alias("w"), F.lit(depth).alias("pos"), F.lit(0).alias("edits"), "n")
        states = seeds if frontier is None else seeds.unionByName(frontier)
        done = freeze(_step(states, here.filter("NOT seed"), depth, cut_depth(level + 1) - depth), "level")
        found.append(done.filter("v IS NOT NULL").select("w", "n", "v", "vn"))
        frontier = done.filter("node IS NOT NULL").select("node", "w", "pos", F.lit(1).alias("edits"), "n")
    if not found:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")

    def plain(c: str) -> Column:
        word = F.substring(c, F.lit(2), F.length(c))
        return F.when(F.startswith(c, F.lit(_FORWARD)), word).otherwise(F.reverse(word))

    pairs = reduce(DataFrame.unionByName, found).select(plain("w").alias("a"), F.col("n").alias("n_a"), plain("v").alias("b"), F.col("vn").alias("n_b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def variants(docs: DataFrame, *, damage: bool = True, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words."""
    counted = freeze(words(docs, damage=damage, min_length=min_length, min_count=min_count), "words")
    near = neighbours(counted, shortest=min_length).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b"))).alias("top"))
    joined = counted.join(near, F.col("word") == F.col("a"), "left")
    is_form = -F.col("top.minus") >= TIMES * F.col("n")
    known = freeze(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("top.b")).alias("form"), F.when(is_form, -F.col("top.minus")).alias("form_n")), "forms")
    # Every step multiplies n, so a chain is short: its length is at most log10 of the largest n.
    steps = known.filter("form IS NOT NULL").select("word", "form")
    roots = steps.withColumnRenamed("form", "root")
    longest, reach = len(str(known.agg(F.max("n")).head()[0] or 1)), 1
    while reach < longest:
        further = roots.select(F.col("word").alias("mid"), F.col("root").alias("last"))
        roots = roots.join(further, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("last", "root").alias("root"))
        reach *= 2
    roots = roots.withColumnRenamed("word", "of")
    return known.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Line dedup over repeated passages of lines, in DataFrame functions only.

A passage is a run of lines of more than ``LONG_WORDS`` words, or a content-defined chunk of
two lines or more with at least ``MIN_WORDS`` words. Repeated passages are found without
comparing documents: from every line the shortest run of more than ``LONG_WORDS`` words that
begins there, and the shortest that ends there, is hashed (a *window*). Windows depend on
their own lines only, so equal runs have equal windows wherever they stand, and the windows
inside a run cover all its lines: a line lies in a repeated run exactly when it lies in a
repeated window. Chunks add shorter passages: a polynomial rolling hash over the last two line
hashes decides where one ends, and a line of more than ``LONG_WORDS`` words stands alone.

Windows and chunks are counted by hash over the whole corpus (partial counts before the
shuffle, so a passage in a third of all documents is one row per task). The texts of repeated
ones are then told apart by SHA-256: only equal texts are repeats. The first occurrence stays,
in the document with the smallest id and there at the first place; all others are removed.
An occurrence that overlaps the first one in its document loses the lines beyond it.

Repeats that are no passage (greetings, headings, license lines) stay.

Defined cases: a null text stays null, an empty text stays empty. A row without an id loses
passages that occur in a row with an id and otherwise counts as the last of all. Rows that
are equal in id and text are one document given twice, and rows of one id with different
texts are one place in the order: among themselves they keep their passages. All columns
of the input stay, whatever their names; ``text`` is rewritten, and ``n_chars`` where it exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut, pack
from caseweave.session import freeze

#: One place in DIVISOR ends a chunk, on average.
DIVISOR = 3
LONG_WORDS = 30
MIN_WORDS = 20
#: Modulus and base of the rolling hash.
_PRIME, _BASE = (1 << 31) - 1, 31


def line_hashes(lines: Column) -> Column:
    """32 bits of a digest that other engines have as well."""
    return F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"))


def count_words(text: Column) -> Column:
    """Runs without blanks: one more than the gaps of the trimmed text."""
    trimmed = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)


def _rolled(last: Column, before: Column) -> Column:
    return ((before % _PRIME) * _BASE + last % _PRIME) % _PRIME


def chunks(hashes: Column, long: Column) -> Column:
    """Array of (start, size) of the chunks: 1-based first line and number of lines."""
    n = F.size(hashes)
    places = F.sequence(F.lit(1), n)
    # A chunk ends after line i: the rolling hash says so, or line i or line i + 1 is a passage of its own.
    ends = F.filter(
        places,
        lambda i: (i == n)
        | (_rolled(F.element_at(hashes, i), F.when(i > 1, F.element_at(hashes, F.greatest(i - 1, F.lit(1)))).otherwise(0)) % DIVISOR == 0)
        | F.element_at(long, i)
        | F.element_at(long, F.least(i + 1, n)),
    )
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("start"), (b - a).alias("size")))


#: Lines per block of the running word count: within a block, and over blocks, arrays grow step by step.
_BLOCK = 64


def _running(counts: Column) -> Column:
    """Running sums of an array."""
    return F.aggregate(counts, F.array().cast("array<long>"), lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))


def _not_above(cum: Column, powers: Column, limit: Column) -> Column:
    """How many numbers of the ascending ``cum`` are at most ``limit``: binary search by falling powers of two."""
    return F.aggregate(powers, F.lit(0), lambda at, step: F.when(F.get(cum, at + step - 1) <= limit, at + step).otherwise(at))


def windows(cum: Column, powers: Column) -> Column:
    """Array of (start, size): the shortest run of more than LONG_WORDS words from every line, and up to every line.

    ``cum`` holds the words before every line and, last, all words.
    """
    places = F.sequence(F.lit(1), F.size(cum) - 1)
    span = lambda start, stop: F.struct(start.alias("start"), (stop - start + 1).alias("size"))
    onward = F.transform(places, lambda i: span(i, _not_above(cum, powers, F.get(cum, i - 1) + LONG_WORDS)))
    onward = F.filter(onward, lambda c: c["start"] + c["size"] <= F.size(cum))
    back = F.transform(places, lambda i: span(_not_above(cum, powers, F.get(cum, i) - LONG_WORDS - 1), i))
    return F.array_distinct(F.concat(onward, F.filter(back, lambda c: c["start"] > 0)))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (tells rows of one id apart by text), line hashes, words before every line, chunks and windows."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("lines", F.split("text", "\n"))
    rows = rows.select("id", "key", line_hashes(F.col("lines")).alias("hashes"), F.transform("lines", count_words).alias("words"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / _BLOCK).cast("int"))
    rows = rows.withColumn("inner", F.transform(blocks, lambda b: _running(F.slice("words", b * _BLOCK + 1, _BLOCK))))
    rows = rows.withColumn("outer", _running(F.transform("inner", lambda b: F.element_at(b, -1))))
    cum = F.transform("inner", lambda b, k: F.transform(b, lambda c: c + F.when(k > 0, F.get("outer", k - 1)).otherwise(0)))
    rows = rows.select(
        "id", "key", "hashes", F.transform("words", lambda w: w > LONG_WORDS).alias("long"),
        F.concat(F.array(F.lit(0).cast("long")), F.flatten(cum)).alias("cum"),
    )
    bits = F.sequence(F.floor(F.log2(F.size("cum"))).cast("int"), F.lit(0), F.lit(-1))
    rows = rows.withColumn("powers", F.transform(bits, lambda k: F.pow(F.lit(2), k).cast("int")))
    return rows.withColumn("chunks", chunks(F.col("hashes"), F.col("long"))).withColumn("windows", windows(F.col("cum"), F.col("powers")))


def _passage_text(lines: Column, passage: Column) -> Column:
    return F.array_join(F.slice(lines, passage["start"], passage["size"]), "\n")


def _passage_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, start, size, hash) of every chunk and window that could be removed."""
    rows = _documents(docs, id_col, text_col)
    words = lambda c: F.get("cum", c["start"] + c["size"] - 1) - F.get("cum", c["start"] - 1)
    # A single line of a chunk that counts is a window as well.
    several = F.filter("chunks", lambda c: (c["size"] > 1) & (words(c) >= MIN_WORDS))
    hashed = F.transform(
        F.array_distinct(F.concat(several, "windows")),
        lambda c: F.struct(
            c["start"].alias("start"), c["size"].alias("size"),
            F.xxhash64(F.slice("hashes", c["start"], c["size"])).alias("hash"),
        ),
    )
    # An outer generator: for an inner one Spark evaluates the arrays once more, to filter out empty ones.
    return rows.select("id", "key", F.inline_outer(hashed)).filter("hash IS NOT NULL")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, repeats): per document its chunks and windows whose hash occurs more than once in the corpus."""
    # Read twice, so the lines are cut and hashed once.
    places = freeze(_passage_rows(docs, id_col, text_col), "passages")
    often = places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return (
        places.join(often, "hash")
        .groupBy("id", "key")
        .agg(F.collect_set(F.struct("start", "size")).alias("repeats"))
    )


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["key"] == right["key"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, gone): per document the runs of lines to remove, as (start, size)."""
    repeats = repeated_passages(docs, id_col, text_col)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text IS NOT NULL")
    texts = texts.withColumn("key", F.xxhash64("text"))
    digests = _bound(F.split("text", "\n"), lambda lines: F.transform(
        "repeats", lambda c: F.struct(c["start"], c["size"], F.sha2(_passage_text(lines, c), 256).alias("digest"))))
    held = texts.join(repeats, _same_document(texts, repeats)).select(texts["id"], texts["key"], F.inline_outer(digests))
    # Two steps read the digests, so the documents are joined once. Texts themselves are not written or sent on.
    named = cut(held)
    firsts = named.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = named.join(firsts, "digest").repartition("id", "key")
    by_text = known.groupBy("id", "key", "digest").agg(
        F.collect_set(F.struct("start", "size")).alias("c"), F.min("start").alias("first"),
        F.first(F.col("id").eqNullSafe(F.col("first_id"))).alias("is_first"),
    )
    # Where the document holds the first occurrence, lines up to its end stay.
    until = F.when(F.col("is_first"), F.col("first") + F.element_at("c", 1)["size"]).otherwise(1)
    later = F.filter("c", lambda c: ~F.col("is_first") | (c["start"] > F.col("first")))
    beyond = F.transform(later, lambda c: F.sequence(F.greatest(c["start"], until), c["start"] + c["size"] - 1))
    lines = by_text.select("id", "key", F.array_distinct(F.flatten(beyond)).alias("gone")).groupBy("id", "key")
    gone = lines.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return gone.select("id", "key", _runs(F.col("gone")).alias("gone"))


def _runs(numbers: Column) -> Column:
    """Ascending line numbers as runs (start, size)."""
    near = lambda k: F.get(numbers, k)
    starts = F.filter(numbers, lambda x, k: (k == 0) | (near(F.greatest(k - 1, F.lit(0))) < x - 1))
    stops = F.filter(numbers, lambda x, k: F.coalesce(near(k + 1) > x + 1, F.lit(True)))
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("size")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the runs of ``gone``, which are sorted and do not overlap."""
    before = lambda k: F.when(k > 0, F.get(gone, k - 1)["start"] + F.get(gone, k - 1)["size"]).otherwise(1)
    until = lambda k: F.coalesce(F.get(gone, k)["start"], F.size(lines) + 1)
    kept = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, before(k), until(k) - before(k)))
    return F.array_join(F.flatten(kept), "\n")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (all columns), ``new`` (the text rewritten), n_lines_removed and n_chunks_removed (runs of lines)."""
    gone = removals(docs, id_col, text_col)
    rows = docs.select(pack(docs).alias("doc"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"))
    joined = rows.join(gone, _same_document(rows, gone), "left")
    left = _bound(F.split(F.col("doc")[text_col], "\n"), lambda lines: _without(lines, F.col("gone")))
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("doc")[text_col])
    return joined.select(
        "doc", text.alias("new"),
        F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, c: a + c["size"]), F.lit(0).cast("long")).alias("n_lines_removed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_chunks_removed"),
    )


def rewritten(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", copies_from: float | None = None,
) -> DataFrame:
    """The input with its repeated passages removed: same rows, same columns.

    With ``copies_from`` a text that would lose at least this share of its words stays whole: it is
    a copy of other documents rather than one with repeated passages, and left to a search for
    near duplicates, which can only recognise it whole.
    """
    done = dedup(docs, id_col=id_col, text_col=text_col)
    if copies_from is not None:
        old = F.col("doc")[text_col]
        copy = (F.col("n_chunks_removed") > 0) & (count_words(F.col("new")) <= (1 - copies_from) * count_words(old))
        done = done.withColumn("copy", copy)
        done = done.withColumn("new", F.when(F.col("copy"), old).otherwise(F.col("new"))).withColumn(
            "n_chunks_removed", F.when(F.col("copy"), F.lit(0)).otherwise(F.col("n_chunks_removed")))
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("doc")[name]
        if name == text_col:
            value = F.col("new")
        elif name == chars_col:
            value = F.when(F.col("n_chunks_removed") > 0, F.length("new").cast(kind)).otherwise(value)
        columns.append(value.alias(name))
    return done.select(*columns)

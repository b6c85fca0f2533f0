"""License scan by diagonal voting.

Every rolling word k-gram of a document is hashed and joined to the places where the
license templates hold the same k-gram. A document that quotes a template agrees with it
at a constant difference of positions (a diagonal), so the hits are collected per
(document, template, diagonal). Neighbouring diagonals of a template (a word dropped or
added within the quotation) are merged, and a merged span is verified: the words behind
every hash are compared, and the longest run of hits that stand in the template's order in
the document as well, each place used once, must cover enough of the template. Exact
phrases take the same way and must cover all of theirs on one diagonal.

Only hits are shuffled. The templates are a parameter with a checked size and are
broadcast. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.

Null texts count as empty: no words, no label, score 0. Null ids are kept, and each row is
scanned for itself, so repeated rows give repeated results; no other column is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import id_and_text

GRAM = 2
#: Templates are broadcast; more words than this (about 100 MB of k-grams) are refused.
MAX_TEMPLATE_WORDS = 2_000_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # a phrase: all its words in a row


#: Phrases whose places are reported exactly. Fixed values.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Sentences that name a license. Fixed values.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text. The Kelvin sign is the one character that lower() would turn into an ASCII letter."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))
    return F.filter(F.split(F.lower(plain), _SPLIT), lambda w: w != "")


def grams(words: Column) -> Column:
    """All rolling word pairs, by place: hash and the two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, 1, n), F.slice(words, 2, n),
        lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("one"), b.alias("two")),
    )


def template_index(spark, templates: Sequence[Template]) -> DataFrame:
    """(gram, its words, template, at, n_grams, ...) of every template position."""
    rows = [(i, t.label, t.text, t.exact) for i, t in enumerate(templates)]
    if sum(len(t.text.split()) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    df = spark.createDataFrame(rows, "template int, label string, body string, exact boolean")
    df = df.withColumn("t_words", words_of(F.col("body")))
    return df.select(
        "template", "label", "exact", (F.size("t_words") - (GRAM - 1)).alias("n_grams"),
        F.posexplode(grams(F.col("t_words"))).alias("at", "g"),
    ).select("template", "label", "exact", "n_grams", "at", "g.*")


def _longest_run(places: Column) -> Column:
    """Length of the longest increasing run of an array: keeps the smallest end of a run of each length."""

    def step(ends: Column, place: Column) -> Column:
        placed = F.concat(
            F.filter(ends, lambda e: e < place), F.array(place), F.slice(F.filter(ends, lambda e: e >= place), 2, F.size(ends))
        )
        return F.when(place > F.get(ends, F.size(ends) - 1), F.concat(ends, F.array(place))).otherwise(placed)

    return F.size(F.aggregate(places, F.array().cast("array<int>"), step))


def scan_spans(
    docs: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    *,
    min_cover: float = 0.7,
    max_shift: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per accepted span: row_key, doc_id, label, template, exact, start, stop (words), cover.

    ``min_cover`` is the share of a template's k-grams that must agree in order, ``max_shift``
    the distance up to which neighbouring diagonals belong together.
    """
    spark = docs.sparkSession
    index = F.broadcast(template_index(spark, templates))
    rows = _rows(docs, id_col, text_col)
    places = rows.select("doc_id", "row_key", F.posexplode(grams(F.col("words"))).alias("place", "g"))
    places = places.select("doc_id", "row_key", "place", "g.*")
    hits = places.join(index, ["gram", "one", "two"])
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    votes = hits.groupBy("row_key", "doc_id", "template", "label", "exact", "n_grams", "diagonal").agg(
        F.collect_set("at").alias("ats"),
    ).withColumns({
        "votes": F.size("ats"), "first": F.array_min("ats") + F.col("diagonal"), "last": F.array_max("ats") + F.col("diagonal"),
    })
    # Phrases: every k-gram on one diagonal. With k = 2, consecutive k-grams share words, so
    # agreement of all of them is agreement of the words in a row.
    exact = votes.filter(F.col("exact") & (F.col("votes") == F.col("n_grams"))).select(
        "row_key", "doc_id", "label", "template", "exact", F.col("first").alias("start"),
        (F.col("last") + GRAM).alias("stop"), F.lit(1.0).alias("cover"),
    )
    # Notices: merge diagonals that lie next to each other.
    loose = votes.filter(~F.col("exact") & ((F.col("votes") > 1) | (F.col("n_grams") == 1)))
    by = Window.partitionBy("row_key", "doc_id", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > max_shift).cast("int"), F.lit(1))
    merged = (
        loose.withColumn("group", F.sum(new).over(by))
        .groupBy("row_key", "doc_id", "label", "template", "exact", "n_grams", "group")
        .agg(
            F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + GRAM).alias("stop"),
            F.collect_list(F.struct("diagonal", "ats")).alias("diagonals"),
        )
    )
    # A span is at most half as long again as its template, so what is verified is bounded by templates.
    likely = merged.filter(
        (F.col("votes") >= min_cover * F.col("n_grams"))
        & (F.col("stop") - F.col("start") <= F.col("n_grams") + 1 + 2 * max_shift + F.col("n_grams") / 2)
    )
    agreeing = F.flatten(F.transform("diagonals", lambda d: F.transform(
        d["ats"], lambda at: F.struct(at.alias("at"), (-at - d["diagonal"]).alias("back")))))
    in_order = _longest_run(F.transform(F.array_sort(agreeing), lambda h: -h["back"]))
    verified = likely.withColumn("cover", in_order / F.col("n_grams")).filter(F.col("cover") >= min_cover)
    return exact.unionByName(verified.select(exact.columns))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key (tells rows of one id with different texts apart) and words."""
    return id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("row_key"), words_of(F.col("text")).alias("words")
    )


def scan(
    docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, *, id_col: str = "doc_id",
    text_col: str = "text", **how,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of label, start, stop, exact, cover by start)."""
    spans = scan_spans(docs, templates, id_col=id_col, text_col=text_col, **how)
    found = spans.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop", "label", "exact", "cover"))).alias("spans")
    )
    rows = _rows(docs, id_col, text_col).select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["row_key"] == found["row_key"])
    return rows.join(found, same, "left").select(
        rows["doc_id"], "n_words", F.coalesce("spans", F.filter(F.array(_no_span()), lambda s: F.lit(False))).alias("spans")
    )


def _no_span() -> Column:
    return F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("label"), F.lit(False).alias("exact"),
        F.lit(0.0).alias("cover"),
    )

"""Registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import byte_bpe, conversation_repair, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, personal_data, piece_bpe, quality_rules, spelling_variants, toxicity
from caseweave.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict (policy v2) of every document."""
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = quality_rules.policy_mask("base")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after the removal of repeated passages: what went, and the digest of what stayed."""
    done = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc.doc_id", "n_lines_removed", "n_chunks_removed", F.length("new").cast("long").alias("n_chars"),
        F.sha2("new", 256).alias("text_sha256"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, the calibrated probability of the cell, and whether it is drawn."""
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select("doc.doc_id", "source", "lang", "topic", F.round("p", 6).alias("p"), "drawn")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the fewest phrases, learnt from rows that are not held out."""
    return language_id.predict(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = personal_data.find(table(spark, sf_dir, "documents"))
    place = lambda s: F.array_position(F.array(*map(F.lit, personal_data.KINDS)), s["kind"])
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    keyed = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place(s).alias("place"), s["stop"].alias("stop"), text(s).alias("text"))))
    line = lambda spans: F.array_join(F.transform(keyed(spans), lambda s: s["text"]), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in personal_data.KINDS],
        F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every embedding: cosine of 0.93 or more within a label."""
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document after deobfuscation, learnt from labels that are not held out."""
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc.doc_id", "held_out", "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases and quoted license notices of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    phrases = F.filter("spans", lambda s: s["exact"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(phrases, lambda s: s["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(phrases).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(phrases).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, similarity of 0.9 or more."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every long and repeated word of the damaged runs of all documents."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded text of every document, merge-type pieces with an end id."""
    import public_tokenizers

    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the damage."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_personal_data": op6_personal_data,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)

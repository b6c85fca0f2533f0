"""The corpus pipeline: five stages over ``documents``, each a Spark job over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of their input. Labels are looked up in the tables of ``sf_dir``; counts and
statistics are those of the documents a stage is given. Empty tables pass through; rows with
null texts are scored as empty, keep their null text, and end as rows without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import byte_bpe, jaccard_join, line_dedup, mixing, toxicity
from caseweave.llm.common import table
from caseweave.session import freeze

#: A text that would lose so much of its words to line dedup is left to the search for near duplicates.
COPIES_FROM = 0.8
#: Share of the tokens that the mixture keeps.
BUDGET_SHARE = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("doc.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages that occurred before are cut out of their texts.

    Texts made up of them almost entirely are copies and stay whole: the next stage takes one of each group.
    """
    return line_dedup.rewritten(docs, copies_from=COPIES_FROM)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, 0.8 or more) the document with the smallest id; rows without an id stay."""
    groups = jaccard_join.join(docs, k=5, num=4, den=5).select("doc_id", "component_id").filter("doc_id <> component_id")
    gone = groups.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents whose tokens meet the target marginals of source, language and form."""
    return mixing.draw(docs, budget_share=BUDGET_SHARE).filter("drawn").select("doc.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of what is left."""
    import public_tokenizers

    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_passages),
    ("jaccard_join", one_of_each_group),
    ("mixing", to_target_weights),
    ("byte_bpe", to_tokens),
]

#: SQL cannot express the toxicity model; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has kept is written to the shared folder, since the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

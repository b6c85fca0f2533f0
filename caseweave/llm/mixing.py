"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted into cells (source, language, topic) with their tokens. The token
weights of the cells are raked: scaled to the target marginal of each dimension in turn,
until all three hold. A cell's inclusion probability follows from its weight and the tokens
it has, calibrated so that the expected tokens meet the budget; no probability exceeds one,
what a full cell cannot give is shared out among the others. Documents are then drawn one
by one by a hash of their id against the probability of their cell, so the draw is the same
on every run, on any number of machines, and for every copy of a task.

Cells, not documents, are raked: their number is bounded by sources x languages x topics.
One source with a third of all rows is a few rows per task before the first shuffle, and
probabilities come back to the documents by a broadcast of the cells under a checked size.

Targets default to the square roots of the shares at hand (small parts are raised, large
ones lowered). Given targets are (dimension value, weight) pairs; values that do not occur
are left out and the rest is rescaled; values without a target get none and are not drawn.

Defined cases: a null source, language or text is a value of its own ("?") and counts like
any other; texts without a word weigh nothing and are kept when their cell's probability
lets them; rows with a null id are drawn by their text; repeated rows are drawn alike; an
empty table gives an empty table. All columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import cut, pack

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 10
#: After so many rounds the cells are written down.
CUT_ROUNDS = 4
#: Cells up to this number are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_CELLS = 200_000

_BLANKS = r"[\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "), F.lit(" "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: what kind of writing a text is. Replace it where topics are known."""
    plain = F.coalesce(text, F.lit(""))
    size = F.length(plain)
    signs = size - F.length(F.translate(plain, "#*$%&|<>=", ""))
    return (
        F.when(size == 0, "empty")
        .when(signs * 20 > size, "markup")
        .when(size < 500, "note")
        .when(size < 4000, "article")
        .otherwise("long read")
    )


def dimensions(docs: DataFrame, *, source_col: str, lang_col: str, text_col: str, topic: Column | None) -> dict[str, Column]:
    given = {
        "source": docs[source_col].cast("string"),
        "lang": docs[lang_col].cast("string"),
        "topic": topic_of(docs[text_col]) if topic is None else topic.cast("string"),
    }
    return {name: F.coalesce(column, F.lit("?")) for name, column in given.items()}


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, n_docs, tokens) of rows with these columns and ``tokens``."""
    return rows.groupBy(*DIMENSIONS).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))


def _with_target(cells: DataFrame, dim: str, targets: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """Adds ``target_<dim>``: the share of the total that the cell's value is to have."""
    own = F.sum("tokens").over(Window.partitionBy(dim))
    if targets is None or dim not in targets:
        wanted = F.sqrt(own)
    else:
        pairs = [x for k, v in targets[dim].items() for x in (F.lit(k), F.lit(float(v)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0)) if pairs else F.lit(0.0)
        wanted = F.when(own > 0, wanted).otherwise(0.0)
    cells = cells.withColumn("_w", wanted)
    # Every value of the dimension counts once towards the total of the targets.
    once = F.row_number().over(Window.partitionBy(dim).orderBy(*DIMENSIONS)) == 1
    cells = cells.withColumn("_one", F.when(once, F.col("_w")).otherwise(0.0))
    total = F.sum("_one").over(Window.partitionBy())
    return cells.withColumn(f"target_{dim}", F.when(total > 0, F.col("_w") / total).otherwise(0.0)).drop("_w", "_one")


def rake(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """Cells with ``weight``: shares that sum to one and meet the three target marginals.

    A cell without tokens stays at zero. Marginals that contradict each other end at the last
    dimension's targets.
    """
    for dim in DIMENSIONS:
        cells = _with_target(cells, dim, targets)
    total = F.sum("tokens").over(Window.partitionBy())
    cells = cells.withColumn("weight", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    for done in range(rounds):
        if done and done % CUT_ROUNDS == 0:  # a plan of all rounds is deeper than a thread's stack
            cells = cut(cells)
        for dim in DIMENSIONS:
            here = F.sum("weight").over(Window.partitionBy(dim))
            cells = cells.withColumn("_here", here).withColumn(
                "weight", F.when(F.col("_here") > 0, F.col("weight") * F.col(f"target_{dim}") / F.col("_here")).otherwise(0.0)
            ).drop("_here")
    return cells


def calibrate(weighted: DataFrame, budget_share: float) -> DataFrame:
    """Adds ``p``: min(1, scale * weight / tokens), the scale chosen so that expected tokens meet the budget.

    Cells are filled in order of tokens per weight: the first ones are taken whole as long as
    the common scale would ask for more than they have. One pass over the sorted cells.
    """
    everything = Window.partitionBy()
    fill = Window.partitionBy().orderBy("_need", *DIMENSIONS)
    up_to = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = weighted.withColumn("_need", F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))
    cells = cells.withColumn("_budget", F.sum("tokens").over(everything) * F.lit(budget_share))
    live = F.col("_need").isNotNull()
    cells = cells.withColumn("_tokens_before", F.sum(F.when(live, F.col("tokens")).otherwise(0)).over(up_to) - F.when(live, F.col("tokens")).otherwise(0))
    weights = F.when(live, F.col("weight")).otherwise(0.0)
    cells = cells.withColumn("_weight_left", F.sum(weights).over(everything) - F.sum(weights).over(up_to) + weights)
    # With all cells before this one full, the scale for the rest would be:
    scale = (F.col("_budget") - F.col("_tokens_before")) / F.col("_weight_left")
    cells = cells.withColumn("_scale", F.when(live & (F.col("_weight_left") > 1e-12), scale))
    # The first cell that is not full under its own scale sets the scale of all.
    cells = cells.withColumn("_fits", F.when(F.col("_scale") < F.col("_need"), F.col("_scale")))
    cells = cells.withColumn("_chosen", F.first("_fits", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    p = F.when(~live, F.lit(0.0)).when(F.col("_chosen").isNull(), F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_chosen") / F.col("_need")))
    )
    return cells.withColumn("p", p).select(*DIMENSIONS, "n_docs", "tokens", "weight", "p")


def uniform(id_col: Column, text: Column) -> Column:
    """A number in [0, 1) from the id (from the text where there is none), the same everywhere."""
    seed = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def probabilities(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    *,
    budget_share: float = 0.5,
    rounds: int = ROUNDS,
    topic: Column | None = None,
    source_col: str = "source",
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Calibrated cells: source, lang, topic, n_docs, tokens, weight, p."""
    dims = dimensions(docs, source_col=source_col, lang_col=lang_col, text_col=text_col, topic=topic)
    rows = docs.select(*[c.alias(n) for n, c in dims.items()], n_tokens(docs[text_col]).alias("tokens"))
    return calibrate(rake(cells_of(rows), targets, rounds), budget_share)


def draw(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    *,
    budget_share: float = 0.5,
    rounds: int = ROUNDS,
    topic: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    lang_col: str = "lang",
    text_col: str = "text",
    max_broadcast: int = BROADCAST_CELLS,
) -> DataFrame:
    """``doc`` (all columns), source, lang, topic, p, u and drawn (u < p) of every document."""
    names = dict(source_col=source_col, lang_col=lang_col, text_col=text_col)
    cells = probabilities(docs, targets, budget_share=budget_share, rounds=rounds, topic=topic, **names)
    # The cells are few, but raking them is a long plan: it is run once and its rows written down.
    cells = cut(cells.select(*DIMENSIONS, "p"))
    dims = dimensions(docs, topic=topic, **names)
    rows = docs.select(
        pack(docs).alias("doc"), *[c.alias(n) for n, c in dims.items()], uniform(docs[id_col], docs[text_col]).alias("u")
    )
    few = cells.limit(max_broadcast + 1).count() <= max_broadcast
    joined = rows.join(F.broadcast(cells) if few else cells, list(DIMENSIONS), "left")
    p = F.coalesce("p", F.lit(0.0))
    return joined.select("doc", *DIMENSIONS, p.alias("p"), "u", (F.col("u") < p).alias("drawn"))

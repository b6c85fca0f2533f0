"""Data conditions: conjunctions over the attributes of an activation.

A condition is an ``array<struct<attr,op,value:string>>``; its text form is for people only
and is never parsed or evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave.functions.scalars import as_number, text_of, typed_attributes, typed_value

CONJUNCTS = "array<struct<attr:string,op:string,value:string>>"


def _rendered_value(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(as_number(value).isNotNull(), value).otherwise(quoted)


def condition_text(conjuncts: Column) -> Column:
    """``x <= 3.5 and y == 'v'``."""
    return F.array_join(
        F.transform(conjuncts, lambda c: F.concat_ws(" ", c["attr"], c["op"], _rendered_value(c["value"]))),
        " and ",
    )


def typed_conjuncts(conjuncts: Column) -> Column:
    """Conjuncts with their values parsed, to be done once per rule and not per activation."""
    return F.transform(
        conjuncts, lambda c: F.struct(c["attr"].alias("attr"), c["op"].alias("op"), typed_value(c["value"]).alias("value"))
    )


def _conjunct_holds(have: Column, op: Column, want: Column) -> Column:
    """One test on a present attribute. Order tests need numbers on both sides; values of
    different types are different."""
    equal = F.coalesce(
        have["num"] == want["num"], have["bool"] == want["bool"], text_of(have) == text_of(want), F.lit(False)
    )
    return F.coalesce(
        F.when(op == "<=", have["num"] <= want["num"])
        .when(op == ">", have["num"] > want["num"])
        .when(op == "==", equal)
        .when(op == "!=", ~equal),
        F.lit(False),
    )


def typed_condition_holds(attrs: Column, conjuncts: Column) -> Column:
    """``condition_holds`` on typed attributes and typed conjuncts."""

    def step(decided: Column, c: Column) -> Column:
        have = attrs[c["attr"]]
        verdict = F.when(have.isNull(), F.lit(True)).when(
            ~_conjunct_holds(have, c["op"], c["value"]), F.lit(False)
        )
        return F.coalesce(decided, verdict)

    return F.coalesce(F.aggregate(conjuncts, F.lit(None).cast("boolean"), step), F.lit(True))


def condition_holds(attrs: Column, conjuncts: Column) -> Column:
    """Left-to-right conjunction over the texts in ``attrs``.

    The first conjunct that fails makes it false; the first conjunct whose attribute is
    absent makes it true; whichever comes first decides.
    """
    return typed_condition_holds(typed_attributes(attrs), typed_conjuncts(conjuncts))

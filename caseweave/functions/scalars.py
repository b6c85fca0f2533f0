"""Column functions: typing of attributes, times, texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of an event that are not attributes of its payload.
RESERVED_KEYS = ("case_concept_name", "concept_name", "time_timestamp", "is_end_event")


# Fixed value: what counts as a number, decimal or scientific.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(text: Column) -> Column:
    """The value as DOUBLE, or NULL. ``nan`` and ``inf`` are texts, not numbers.

    The pattern comes first because a failing cast costs far more than a failing match.
    """
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def as_boolean(text: Column) -> Column:
    """TRUE/FALSE for the words true and false in any case, else NULL."""
    lowered = F.lower(text)
    return F.when(lowered == "true", F.lit(True)).when(lowered == "false", F.lit(False))


def typed_value(text: Column) -> Column:
    """``struct(num, bool, str)``: a value is a number if ``num`` is set, else a boolean if
    ``bool`` is set, else the text. ``str`` always holds the text."""
    return F.struct(as_number(text).alias("num"), as_boolean(text).alias("bool"), text.alias("str"))


def typed_attributes(attrs: Column) -> Column:
    """The attribute map with typed values; an attribute without a value is absent."""
    return F.transform_values(F.map_filter(attrs, lambda _, text: text.isNotNull()), lambda _, text: typed_value(text))


def text_of(value: Column) -> Column:
    """The text of a typed value that is neither number nor boolean, else NULL."""
    return F.when(value["num"].isNull() & value["bool"].isNull(), value["str"])


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Lenient parse: NULL instead of an error; ISO 8601 with or without zone by default."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def clock_text(ts: Column) -> Column:
    """``HH:mm:ss dd-MM-yyyy``."""
    return F.date_format(ts, "HH:mm:ss dd-MM-yyyy")


def payload(attrs: Column) -> Column:
    """The learnable attributes: everything but the reserved keys."""
    return F.map_filter(attrs, lambda key, _: ~key.isin(*RESERVED_KEYS))


def constraint_text(template: str = "template", first: str = "first", second: str = "second") -> Column:
    """``Name[A, B]``."""
    return F.format_string("%s[%s, %s]", F.col(template), F.col(first), F.col(second))


def ratio3(part: Column, whole: Column) -> Column:
    """``part / whole`` to 3 places; 0.0 when there is nothing to divide by.

    Rounds the binary value, ties to even: 402/800 is stored just below 0.5025 and gives 0.502.
    """
    ratio = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.rint(ratio * 1000) / 1000


def number_text(value: Column) -> Column:
    """A number to 2 places without a padding zero: 3.0, 12.5, 0.25."""
    return F.regexp_replace(F.round(value, 2).cast("decimal(38,2)").cast("string"), "0$", "")


def json_record(*columns) -> Column:
    """The row as JSON text, timestamps and all."""
    return F.to_json(F.struct(*columns))

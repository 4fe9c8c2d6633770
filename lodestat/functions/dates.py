"""Dates written in several formats: explicit formats only, day and month are never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats tried when a column's own formats are looked for, in this order.
CANDIDATE_DATE_FORMATS = (
    "%Y-%m-%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%d-%m-%Y",
    "%Y/%m/%d",
    "%d.%m.%Y",
    "%d %b %Y",
    "%d %B %Y",
    "%b %d %Y",
    "%d/%m/%y",
    "%Y-%m-%d %H:%M:%S",
)

# Directive → (pattern letters of Spark, shape of the text it reads).
_DIRECTIVES = {
    "Y": ("yyyy", r"\d{4}"),
    "y": ("yy", r"\d{2}"),
    "m": ("M", r"\d{1,2}"),
    "d": ("d", r"\d{1,2}"),
    "b": ("MMM", r"[A-Za-z]{3}"),
    "B": ("MMMM", r"[A-Za-z]+"),
    "H": ("H", r"\d{1,2}"),
    "M": ("m", r"\d{1,2}"),
    "S": ("s", r"\d{1,2}"),
}
_CENTURY_PIVOT = 69  # two-digit years from here on belong to the twentieth century


def spark_pattern(date_format: str) -> tuple[str, str]:
    """(Spark datetime pattern, regular expression of its shape) of a ``strptime`` format."""
    pattern, shape, rest = "", "", iter(date_format)
    for char in rest:
        if char == "%":
            letters, digits = _DIRECTIVES[next(rest)]
            pattern += letters
            shape += digits
        else:
            pattern += f"'{char}'" if char.isalpha() else char
            shape += rf"\{char}" if not char.isalnum() else char
    return pattern, f"^{shape}$"


def read_date(col: Column, date_format: str) -> Column:
    """Timestamp read by one format, NULL otherwise.

    The shape is tested first: a cheap regular expression spares the parser, whose failures
    cost an exception each.
    """
    pattern, shape = spark_pattern(date_format)
    parsed = F.try_to_timestamp(col, F.lit(pattern))
    if "%y" in date_format:
        parsed = F.when(
            F.pmod(F.year(parsed), F.lit(100)) >= _CENTURY_PIVOT,
            F.add_months(parsed, -1200).cast("timestamp"),
        ).otherwise(parsed)
    return F.when(col.rlike(shape), parsed)


def parse_date(col: Column, formats: Sequence[str]) -> Column:
    """First format that reads the value wins; NULL when none does."""
    text = col.cast("string")
    if not formats:
        return F.lit(None).cast("timestamp")
    return F.coalesce(*[read_date(text, f) for f in formats])


def date_mask(col: Column, candidates: Sequence[str] = CANDIDATE_DATE_FORMATS) -> Column:
    """Bit i is set when candidate i reads the value: one pass answers for every format."""
    mask = F.lit(0)
    for i, date_format in enumerate(candidates):
        mask = mask + F.when(read_date(col, date_format).isNotNull(), 1 << i).otherwise(0)
    return F.coalesce(mask, F.lit(0))


def weekday_name(col: Column, labels: Sequence[str]) -> Column:
    """Label of the day of the week, ``labels`` starting on Monday."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.weekday(col) + 1)


def agreement_rate(left: Column, right: Column) -> Column:
    """Aggregate: share of rows where both are present and equal, among rows with both."""
    return F.avg(F.when(left.isNotNull() & right.isNotNull(), (left == right).cast("int")))

"""Numeric functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestat.functions.spaces import WHITE

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def _java_literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def strip_units(col: Column, units: Sequence[str] | Column) -> Column:
    """Each unit removed wherever it stands, case ignored. ``units`` may be an array column."""
    if isinstance(units, Column):
        return F.aggregate(
            units,
            col,
            lambda text, unit: F.regexp_replace(
                text, F.concat(F.lit(r"(?iu)\Q"), unit, F.lit(r"\E")), F.lit("")
            ),
        )
    for unit in units:
        col = F.regexp_replace(col, "(?iu)" + _java_literal(unit), "")
    return col


def parse_number(col: Column, units: Sequence[str] | Column = ()) -> Column:
    """Number written with a point or a comma, units glued or not; NULL when unreadable.

    The shape is checked before the cast: Spark alone would read ``'12d'`` as 12.
    """
    text = strip_units(col.cast("string"), units)
    text = F.regexp_replace(F.translate(text, ",", "."), WHITE + "+", "")
    return F.when(text.rlike(_NUMBER) | text.rlike(_INFINITE), text.try_cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio, NULL when the denominator is missing or not positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(col: Column, low: float, high: float) -> Column:
    """Value bounded to [low, high]; a missing value stays missing."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def sigmoid(col: Column) -> Column:
    """Logistic function of a log-odds."""
    return 1 / (1 + F.exp(-col))


def decimal_comma(col: Column, digits: int) -> Column:
    """Number written with a fixed count of decimals and a decimal comma, no grouping."""
    fixed = F.format_string(f"%.{digits}f", col)
    return F.when(col.isNotNull(), F.translate(fixed, ".", ","))

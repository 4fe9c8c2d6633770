"""The value-frequency table behind every profile and exploratory number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import blank_to_null

COLUMN, VALUE, COUNT = "colonne", "valeur", "n"


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL: a missing number is missing, whichever way it is stored."""
    col = F.col(f"`{name}`")
    return F.nanvl(col, F.lit(None)) if dict(df.dtypes)[name] in ("double", "float") else col


def is_numeric(df: DataFrame, name: str) -> bool:
    kind = dict(df.dtypes)[name]
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith(
        "decimal"
    )


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(colonne, valeur double) rows of the filled cells, plus the ``keep`` columns."""
    wide = df.select(*keep, *[present(df, c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), COLUMN, VALUE).where(F.col(VALUE).isNotNull())


def long_text(df: DataFrame, columns: Sequence[str], blank: bool = True) -> DataFrame:
    """(colonne, valeur string) rows, absences kept as NULL."""
    kinds = dict(df.dtypes)

    def read(name: str) -> Column:
        # Only text can hold a blank; other types are spared the test.
        cell = present(df, name)
        return blank_to_null(cell) if blank and kinds[name] == "string" else cell.cast("string")

    wide = df.select(*[read(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), COLUMN, VALUE)


def value_frequencies(
    df: DataFrame, columns: Sequence[str] | None = None, *, blank: bool = True
) -> DataFrame:
    """(colonne, valeur, n): how often each value occurs in each column, absences as NULL.

    One shuffle for all columns. Counts are combined before it, so a value that fills a third of
    the rows reaches the shuffle as one row per task.
    """
    columns = list(columns or df.columns)
    return (
        long_text(df, columns, blank).groupBy(COLUMN, VALUE).agg(F.count(F.lit(1)).alias(COUNT))
    )


def modality_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, valeur, n) of the filled cells, values as written."""
    return value_frequencies(df, columns, blank=False).where(F.col(VALUE).isNotNull())


def column_totals(freq: DataFrame) -> DataFrame:
    """(colonne, total): one row per column, hence small whatever the data."""
    return freq.groupBy(COLUMN).agg(F.sum(COUNT).alias("total"))


def number_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, valeur double, n) of the filled cells of numeric columns."""
    return long_numbers(df, columns).groupBy(COLUMN, VALUE).agg(F.count(F.lit(1)).alias(COUNT))

"""From raw text to curated tables: conform, recode, drop duplicates, derive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.dates import parse_date
from lodestat.functions.numbers import parse_number, safe_ratio
from lodestat.functions.text import blank_to_null, normalize_text, recode_value
from lodestat.operators.frequencies import COLUMN, COUNT, long_text
from lodestat.operators.profiling import date_formats, detect_units, read_by_formats

Vocabulary = Mapping[str, Mapping[str, Sequence[str]]]


def _as_map(table: DataFrame, value: str) -> Column:
    """A per-column table as one map value, computed once as a scalar sub-query."""
    entries = F.collect_list(F.struct(COLUMN, value))
    return table.agg(F.map_from_entries(entries)).scalar()


def declared_types(columns: Sequence[str], numeric: Sequence[str]) -> dict[str, str]:
    """Types from a specification: a number is always decimal, everything else is text."""
    return {c: "decimal" if c in set(numeric) else "texte" for c in columns}


def _already_numeric(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Boolean columns whose every filled cell reads as a number."""
    if not columns:
        return set()
    row = df.agg(
        *[
            F.bool_and(
                blank_to_null(F.col(f"`{c}`")).isNull() | parse_number(F.col(f"`{c}`")).isNotNull()
            ).alias(c)
            for c in columns
        ]
    ).first()
    return {c for c in columns if row[c]}


def conform(
    df: DataFrame,
    types: Mapping[str, str],
    units: Mapping[str, Sequence[str]] | None = None,
    formats: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One typed projection: numbers, dates and comparison keys, by semantic type.

    Drops no row and no column, merges no category, imputes nothing. A column of type ``brut``
    stays as written. Units and date formats that
    are not given are detected from the whole column.
    """
    units, formats = dict(units or {}), dict(formats or {})
    kinds = {c: types.get(c, "texte") for c in df.columns}
    numeric = [c for c, k in kinds.items() if k in ("entier", "decimal")]
    dated = [c for c, k in kinds.items() if k == "date"]
    numeric_booleans = _already_numeric(df, [c for c, k in kinds.items() if k == "booleen"])
    found, cuts = [c for c in numeric if c not in units], [c for c in dated if c not in formats]
    with_facts = df
    if found:
        # Straight from the rows: only units, not values, are shuffled.
        per_column = detect_units(long_text(df, found)).groupBy(COLUMN).agg(
            F.sort_array(F.collect_list("unite")).alias("unites")
        )
        with_facts = with_facts.withColumn("_unites", _as_map(per_column, "unites"))
    if cuts:
        rows = long_text(df, cuts).withColumn(COUNT, F.lit(1).cast("bigint"))
        per_column = date_formats(rows).select(COLUMN, "choisis")
        with_facts = with_facts.withColumn("_formats", _as_map(per_column, "choisis"))

    def typed(name: str) -> Column:
        cell = blank_to_null(F.col(f"`{name}`"))
        kind = kinds[name]
        if kind == "brut":
            return F.col(f"`{name}`")
        if kind in ("entier", "decimal"):
            if name in units:
                number = parse_number(cell, units[name])
            else:
                known = F.coalesce(F.col("_unites")[name], F.array().cast("array<string>"))
                # A plain number needs no unit removed: most rows skip the fold.
                number = F.coalesce(parse_number(cell), parse_number(cell, known))
            return number.cast("long") if kind == "entier" else number
        if kind == "date":
            if name in formats:
                return parse_date(cell, formats[name])
            return read_by_formats(cell, F.col("_formats")[name])
        if kind == "booleen" and name in numeric_booleans:
            return parse_number(cell).cast("long")
        return normalize_text(cell)

    return with_facts.select(*[typed(c).alias(c) for c in df.columns])


def recode(df: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, list[str]]:
    """Synonyms to canonical labels in the columns the vocabulary knows, and their names."""
    touched = [c for c in df.columns if vocabulary.get(c)]
    changes = {c: recode_value(F.col(f"`{c}`"), vocabulary[c]) for c in touched}
    return (df.withColumns(changes) if changes else df), touched


def recode_by_table(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Recoding by a vocabulary too large for an expression: (variante, canonique) rows."""
    renamed = table.select(F.col("variante").alias(column), F.col("canonique").alias("_canonique"))
    # No hint: the planner broadcasts the table when its measured size allows, else shuffles.
    return (
        df.join(renamed, column, "left")
        .withColumn(column, F.coalesce("_canonique", F.col(column)))
        .select(*df.columns)
    )


def dedup_exact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Identical rows once, absences being equal.

    An aggregation on every column: copies merge inside each task before the shuffle, so a row
    repeated a billion times travels once per task.
    """
    return df.dropDuplicates(list(columns) if columns else None)


def transform(
    df: DataFrame, types: Mapping[str, str], vocabulary: Vocabulary | None = None, **detected
) -> DataFrame:
    """Conform, recode, then drop duplicates: rows become twins only once unified."""
    recoded, _ = recode(conform(df, types, **detected), vocabulary or {})
    return dedup_exact(recoded)


def transform_facts(
    df: DataFrame, types: Mapping[str, str], vocabulary: Vocabulary | None = None, **detected
) -> DataFrame:
    """One row: source rows, rows removed as duplicates, columns, recoded columns."""
    recoded, touched = recode(conform(df, types, **detected), vocabulary or {})
    # One aggregation gives both counts: rows per distinct row, then their sum.
    counts = recoded.groupBy(*[f"`{c}`" for c in recoded.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return counts.agg(
        F.sum("_k").alias("n_lignes_source"),
        (F.sum("_k") - F.count(F.lit(1))).alias("n_doublons_retires"),
        F.lit(len(recoded.columns)).alias("n_colonnes"),
        F.lit(", ".join(touched)).alias("colonnes_recodees"),
    )


def build_gold(
    df: DataFrame,
    drop: Sequence[str],
    ratios: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Declared exclusions removed, ratios (name → numerator, denominator) added."""
    return df.drop(*drop).withColumns(
        {name: safe_ratio(F.col(f"`{a}`"), F.col(f"`{b}`")) for name, (a, b) in ratios.items()}
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the rows of a table whatever their order."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("n_lignes"),
        F.sum(hashed.cast("decimal(38,0)")).alias("somme"),
        F.bit_xor(hashed).alias("ou_exclusif"),
    ).select(
        "n_lignes",
        F.substring(F.md5(F.concat_ws("|", "n_lignes", "somme", "ou_exclusif")), 1, 12).alias(
            "empreinte"
        ),
    )



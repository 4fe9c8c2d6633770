"""Joins and integrity checks between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import normalize_text


def orphan_keys(fact: DataFrame, catalogue: DataFrame, key: str, catalogue_key: str | None = None) -> DataFrame:
    """(cle): distinct normalised keys of the facts that the catalogue does not know.

    Keys are made distinct before the join, so a hot key crosses the shuffle once per task.
    """
    used = fact.select(normalize_text(F.col(key)).alias("cle")).where(F.col("cle").isNotNull())
    known = catalogue.select(normalize_text(F.col(catalogue_key or key)).alias("cle"))
    return used.distinct().join(known.distinct(), "cle", "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(cle, n_doublons): rows beyond the first of each key value, absence being one value."""
    long = df.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot(
        [], list(keys), "cle", "valeur"
    )
    per_value = long.groupBy("cle", "valeur").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("cle").agg((F.sum("n") - F.count(F.lit(1))).alias("n_doublons"))


def order_violations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(regle, n_violations): rows where the small column exceeds the large one; NULLs excluded."""
    names = [f"{a} <= {b}" for a, b in pairs]
    counted = df.agg(
        *[F.count_if(F.col(a) > F.col(b)).alias(n) for (a, b), n in zip(pairs, names)]
    )
    return counted.unpivot([], [F.col(f"`{n}`") for n in names], "regle", "n_violations")


def functional_dependency(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """(attribut, n_cles, n_cles_multiples, dependance): is each attribute constant per key?

    Extremes replace distinct counts: constant state per key, no gathering of values.
    """
    per_key = df.groupBy(key).agg(
        *[
            (
                F.min(a).eqNullSafe(F.max(a))
                & ((F.count(a) == 0) | (F.count(a) == F.count(F.lit(1))))
            ).alias(a)
            for a in attributes
        ]
    )
    long = per_key.select(*attributes).unpivot([], list(attributes), "attribut", "constant")
    return long.groupBy("attribut").agg(
        F.count(F.lit(1)).alias("n_cles"),
        F.count_if(~F.col("constant")).alias("n_cles_multiples"),
        F.bool_and("constant").alias("dependance"),
    )


def enrich(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Catalogue columns added by key; the planner picks broadcast or shuffle by measured size."""
    return df.join(catalogue, key, "left")


def align_modalities(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(modalite, n_reference, n_courant): union of the modalities, 0 where a side has none."""
    a = reference.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("modalite"))
    b = current.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("modalite"))
    return (
        a.agg(F.count(F.lit(1)).alias("n_reference"))
        .join(b.agg(F.count(F.lit(1)).alias("n_courant")), "modalite", "full_outer")
        .fillna(0, ["n_reference", "n_courant"])
    )


def joint_overlap(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows of ``left`` that equal some row of ``right`` on every column, and all rows.

    Both sides are first counted per distinct row, so copies do not pile up on one join key.
    """
    columns = list(columns or left.columns)
    mine = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    theirs = right.select(*columns).distinct().withColumn("_seen", F.lit(True))
    aliased = theirs.select(*[F.col(c).alias(f"_r_{c}") for c in columns], "_seen")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    joined = mine.join(aliased, same, "left")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("_seen"), F.col("_n"))), F.lit(0)).alias("n_communes"),
        F.sum("_n").alias("n_lignes"),
    )

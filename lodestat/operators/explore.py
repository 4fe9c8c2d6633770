"""Exploratory aggregates: modalities, distributions, bounds. Values are returned unrounded."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import as_modality
from lodestat.operators.frequencies import (
    column_totals,
    long_numbers,
    modality_frequencies,
    present,
)
from lodestat.operators.ranks import quantiles

IQR_K = 1.5  # fixed value: Tukey's factor


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(modalite, n, part_%) of one column, absence included, most frequent first."""
    counts = df.groupBy(as_modality(present(df, column)).alias("modalite")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select("modalite", "n", (100 * F.col("n") / total).alias("part_%")).orderBy(
        F.desc("n"), "modalite"
    )


def imbalance_ratio(df: DataFrame, column: str) -> DataFrame:
    """One row ``ratio``: majority over minority count, 1.0 for a single class."""
    counts = df.groupBy(as_modality(present(df, column))).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.min("n")).alias("ratio"))


def modality_counts(df: DataFrame, column: str) -> DataFrame:
    """(modalite, n), rarest first, absence included."""
    return class_balance(df, column).select("modalite", "n").orderBy("n", "modalite")


def modality_overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: number of modalities, the dominant and the rarest with their shares.

    Ties are broken by the alphabet: the dominant is the first, the rarest the last.
    """
    freq = modality_frequencies(df, columns)
    ranked = F.struct((-F.col("n")).alias("k"), F.col("valeur").alias("v"))
    per_column = freq.groupBy("colonne").agg(
        F.count(F.lit(1)).alias("n_modalites"),
        F.sum("n").alias("total"),
        F.min(ranked).alias("_top"),
        F.max(ranked).alias("_last"),
    )
    missing = missing_counts(df, columns)
    return missing.join(F.broadcast(per_column), "colonne", "left").select(
        "colonne",
        F.coalesce("n_modalites", F.lit(0)).alias("n_modalites"),
        F.col("_top.v").alias("dominante"),
        (-100 * F.col("_top.k") / F.col("total")).alias("part_dominante_%"),
        F.col("_last.v").alias("plus_rare"),
        (-100 * F.col("_last.k") / F.col("total")).alias("part_rare_%"),
        (100 * F.col("n_manquants") / F.col("n_lignes")).alias("manquants_%"),
    )


def _with_share(freq: DataFrame) -> DataFrame:
    totals = F.broadcast(column_totals(freq))  # one row per column
    return freq.join(totals, "colonne").withColumn("_part", F.col("n") / F.col("total"))


def rare_modalities(
    df: DataFrame, columns: Sequence[str], max_share: float = 0.01
) -> DataFrame:
    """Modalities whose share of the filled cells is strictly below ``max_share``."""
    return (
        _with_share(modality_frequencies(df, columns))
        .where(F.col("_part") < max_share)
        .select(
            "colonne", F.col("valeur").alias("modalite"), "n", (100 * F.col("_part")).alias("part_%")
        )
    )


def quasi_constant(df: DataFrame, columns: Sequence[str], min_share: float = 0.95) -> DataFrame:
    """Columns whose most frequent value covers at least ``min_share`` of the filled cells."""
    top = modality_frequencies(df, columns).groupBy("colonne").agg(
        F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("valeur").alias("v"))).alias("_top"),
    )
    return top.where(-F.col("_top.k") / F.col("total") >= min_share).select(
        "colonne",
        F.col("_top.v").alias("dominante"),
        (-100 * F.col("_top.k") / F.col("total")).alias("part_%"),
    )


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, n_manquants, n_lignes) in one pass, one row per column."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_lignes"),
        *[F.count_if(present(df, c).isNull()).alias(c) for c in columns],
    )
    return wide.unpivot(["n_lignes"], list(columns), "colonne", "n_manquants").select(
        "colonne", "n_manquants", "n_lignes"
    )


def numeric_overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled count, mean, sample deviation, extremes, exact median and unbiased skewness."""
    rows = long_numbers(df, columns)
    n = F.col("n")
    moments = rows.groupBy("colonne").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("valeur").alias("moyenne"),
        F.stddev_samp("valeur").alias("ecart_type"),
        F.min("valeur").alias("min"),
        F.max("valeur").alias("max"),
        F.skewness("valeur").alias("_g1"),
    )
    middle = quantiles(rows, [0.5])
    # Undefined below three values; zero for a constant.
    skew = F.when(n >= 3, F.nanvl(F.col("_g1"), F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / (n - 2))
    return moments.join(F.broadcast(middle), "colonne").select(
        "colonne",
        "n",
        "moyenne",
        "ecart_type",
        "min",
        F.col("quantiles")[0].alias("mediane"),
        "max",
        F.when((n >= 3) & F.col("_g1").isNull(), 0.0).otherwise(skew).alias("asymetrie"),
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = IQR_K) -> DataFrame:
    """(colonne, q1, q3, borne_basse, borne_haute): Tukey's bounds, one row per column."""
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return quantiles(long_numbers(df, columns), [0.25, 0.75]).select(
        "colonne",
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - k * (q3 - q1)).alias("borne_basse"),
        (q3 + k * (q3 - q1)).alias("borne_haute"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = IQR_K) -> DataFrame:
    """Per column the extremes, Tukey's bounds and the values strictly outside them."""
    bounds = F.broadcast(iqr_bounds(df, columns, k))
    v = F.col("valeur")
    outside = (v < F.col("borne_basse")) | (v > F.col("borne_haute"))
    return (
        long_numbers(df, columns)
        .join(bounds, "colonne")
        .groupBy("colonne")
        .agg(
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.first("borne_basse").alias("borne_basse"),
            F.first("borne_haute").alias("borne_haute"),
            F.count_if(outside).alias("n_hors_iqr"),
            (100 * F.count_if(outside) / F.count(F.lit(1))).alias("part_%"),
        )
        .orderBy(F.desc("part_%"), "colonne")
    )


def _bounds_map(df: DataFrame, columns: Sequence[str], k: float) -> Column:
    """All bounds as one map value, attached to rows as a scalar sub-query (no join)."""
    pairs = F.struct("colonne", F.struct("borne_basse", "borne_haute"))
    return iqr_bounds(df, columns, k).agg(F.map_from_entries(F.collect_list(pairs))).scalar()


def iqr_mask(df: DataFrame, columns: Sequence[str], k: float = IQR_K) -> DataFrame:
    """``df`` with one boolean ``<column>_hors_iqr`` per column, false where missing."""
    with_bounds = df.withColumn("_bornes", _bounds_map(df, columns, k))

    def outside(name: str) -> Column:
        bound = F.col("_bornes")[name]
        value = present(df, name)
        return F.coalesce(
            (value < bound["borne_basse"]) | (value > bound["borne_haute"]), F.lit(False)
        )

    return with_bounds.withColumns({f"{c}_hors_iqr": outside(c) for c in columns}).drop("_bornes")


def rows_with_outlier(df: DataFrame, columns: Sequence[str], k: float = IQR_K) -> DataFrame:
    """One row: rows that carry at least one value outside the bounds, and all rows."""
    any_flag = F.greatest(*[F.col(f"{c}_hors_iqr") for c in columns], F.lit(False))
    return iqr_mask(df, columns, k).agg(
        F.count_if(any_flag).alias("n_lignes_hors_iqr"), F.count(F.lit(1)).alias("n_lignes")
    )


def format_range(low: float, high: float) -> str:
    """Interval of a domain, open-ended when there is no ceiling."""
    return f"[{low:g} ; ∞[" if math.isinf(high) else f"[{low:g} ; {high:g}]"


def domain_check(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Observed extremes against the declared domain; positions in % are not clamped.

    Columns without a finite ceiling are skipped: a relative position would mean nothing.
    """
    columns = [c for c in df.columns if c in ranges and math.isfinite(ranges[c][1])]
    names = [F.lit(c) for c in columns]
    domain = {
        key: F.map_from_arrays(F.array(*names), F.array(*[F.lit(pick(ranges[c])) for c in columns]))
        for key, pick in {
            "_low": lambda r: float(r[0]),
            "_high": lambda r: float(r[1]),
            "domaine": lambda r: format_range(*r),
        }.items()
    }
    rows = long_numbers(df, columns)
    low, high = domain["_low"][F.col("colonne")], domain["_high"][F.col("colonne")]
    v = F.col("valeur")
    observed = rows.groupBy("colonne").agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if((v < low) | (v > high)).alias("n_hors_domaine"),
    )
    return observed.select(
        "colonne",
        domain["domaine"][F.col("colonne")].alias("domaine"),
        "min",
        "max",
        "n_hors_domaine",
        (100 * (F.col("min") - low) / (high - low)).alias("debut_%"),
        (100 * (F.col("max") - low) / (high - low)).alias("fin_%"),
    )


def target_rate_by_modality(df: DataFrame, column: str, target: str) -> DataFrame:
    """(modalite, n, taux_%): size of each modality and mean target of its labelled rows."""
    return (
        df.groupBy(as_modality(present(df, column)).alias("modalite"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (100 * F.avg(present(df, target).cast("double"))).alias("taux_%"),
        )
        .orderBy("modalite")
    )


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 30, by: str | None = None
) -> DataFrame:
    """(colonne[, by], classe, debut, fin, n): equal-width bins, at most one per distinct value.

    The last bin is closed on the right. Bins that hold nothing are left out.
    """
    keep = [by] if by else []
    rows = long_numbers(df, columns, keep)
    counts = rows.groupBy("colonne", *keep, "valeur").agg(F.count(F.lit(1)).alias("n"))
    scope = (
        counts.groupBy("colonne", "valeur").agg(F.lit(1).alias("_u")) if by else counts
    ).groupBy("colonne").agg(
        F.min("valeur").alias("_low"),
        F.max("valeur").alias("_high"),
        F.least(F.lit(bins), F.count(F.lit(1))).alias("_bins"),
    )
    constant = F.col("_low") == F.col("_high")
    low = F.when(constant, F.col("_low") - 0.5).otherwise(F.col("_low"))
    width = F.when(constant, 1.0).otherwise(F.col("_high") - F.col("_low")) / F.col("_bins")
    place = F.least(F.floor((F.col("valeur") - low) / width).cast("int"), F.col("_bins").cast("int") - 1)
    return (
        counts.join(F.broadcast(scope), "colonne")
        .withColumns({"classe": place, "debut": low + place * width, "fin": low + (place + 1) * width})
        .groupBy("colonne", *keep, "classe")
        .agg(F.first("debut").alias("debut"), F.first("fin").alias("fin"), F.sum("n").alias("n"))
    )


def box_stats(df: DataFrame, columns: Sequence[str], k: float = IQR_K) -> DataFrame:
    """Quartiles, whiskers (furthest values inside Tukey's bounds) and fliers per column."""
    rows = long_numbers(df, columns)
    q = F.col("quantiles")
    bounds = quantiles(rows, [0.25, 0.5, 0.75]).select(
        "colonne", q[0].alias("q1"), q[1].alias("mediane"), q[2].alias("q3")
    )
    v = F.col("valeur")
    spread = F.col("q3") - F.col("q1")
    above, below = v >= F.col("q1") - k * spread, v <= F.col("q3") + k * spread
    return (
        rows.join(F.broadcast(bounds), "colonne")
        .groupBy("colonne")
        .agg(
            F.first("q1").alias("q1"),
            F.first("mediane").alias("mediane"),
            F.first("q3").alias("q3"),
            F.least(F.first("q1"), F.min(F.when(above, v))).alias("moustache_basse"),
            F.greatest(F.first("q3"), F.max(F.when(below, v))).alias("moustache_haute"),
            F.count_if(~(above & below)).alias("n_extremes"),
        )
    )


def row_completeness(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, n_remplies): filled columns of each row, to be read in the original order."""
    filled = sum([present(df, c).isNotNull().cast("int") for c in columns], F.lit(0))
    return df.select(row_id, filled.alias("n_remplies"))


def target_overlap(df: DataFrame, binary: str, continuous: str, cut: float) -> DataFrame:
    """Extremes of the continuous target per binary class, and how often both targets agree."""
    agreement = df.agg(
        F.avg((F.col(binary).cast("int") == (F.col(continuous) < cut).cast("int")).cast("int"))
    ).scalar()
    return (
        df.groupBy(binary)
        .agg(F.min(continuous).alias("min"), F.max(continuous).alias("max"))
        .withColumn("part_concordante", agreement)
    )



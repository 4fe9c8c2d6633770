"""Missing values: how many, whether they gather on some rows, what their absence depends on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.association import (
    association_pairs,
    group_spread_pairs,
    matrix_from_indicators,
)
from lodestat.operators.explore import missing_counts
from lodestat.operators.frequencies import is_numeric, present
from lodestat.operators.noise import permutation_test


def missing_overview(
    df: DataFrame, columns: Sequence[str] | None = None, themes: Mapping[str, str] | None = None
) -> DataFrame:
    """Columns with holes, most holes first, with their theme when themes are given."""
    counts = missing_counts(df, columns or df.columns).where(F.col("n_manquants") > 0)
    result = counts.select(
        "colonne",
        "n_manquants",
        (100 * F.col("n_manquants") / F.col("n_lignes")).alias("part_%"),
    )
    if themes is not None:
        pairs = [F.lit(x) for pair in themes.items() for x in pair]
        theme = F.create_map(*pairs)[F.col("colonne")] if pairs else F.lit(None).cast("string")
        result = result.withColumn("theme", theme)
    return result.orderBy(F.desc("n_manquants"), "colonne")


def _convolve(law: Column, rate: Column) -> Column:
    """Law of a count after one more independent event of the given rate."""
    stays = F.concat(F.transform(law, lambda p: p * (1 - rate)), F.array(F.lit(0.0)))
    moves = F.concat(F.array(F.lit(0.0)), F.transform(law, lambda p: p * rate))
    return F.zip_with(stays, moves, lambda a, b: a + b)


def missing_per_row(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows by number of missing columns, observed and expected if columns were independent.

    The expectation is the exact law of a sum of unequal Bernoulli variables, rounded half to
    even.
    """
    columns = list(columns or df.columns)
    indicators = [present(df, c).isNull().cast("int") for c in columns]
    observed = df.groupBy(sum(indicators, F.lit(0)).alias("nb_colonnes_manquantes")).agg(
        F.count(F.lit(1)).alias("n_lignes_observe")
    )
    rates = F.array(*[F.avg(i.cast("double")) for i in indicators])
    law = (
        df.agg(rates.alias("_rates"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_rates", F.filter("_rates", lambda r: r > 0))
        .withColumn("_law", F.aggregate("_rates", F.array(F.lit(1.0)), _convolve))
    )
    expected = law.select(
        "_rows", F.posexplode("_law").alias("nb_colonnes_manquantes", "_probability")
    ).select(
        "nb_colonnes_manquantes",
        F.bround(F.col("_probability") * F.col("_rows"), 0).cast("long").alias("n_lignes_attendu"),
    )
    return (
        expected.join(F.broadcast(observed), "nb_colonnes_manquantes", "left")
        .select(
            "nb_colonnes_manquantes",
            F.coalesce("n_lignes_observe", F.lit(0)).alias("n_lignes_observe"),
            "n_lignes_attendu",
        )
        .where((F.col("n_lignes_observe") > 0) | (F.col("n_lignes_attendu") > 0))
        .orderBy("nb_colonnes_manquantes")
    )


def missing_gaps(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Target rate of rows where a column is missing against rows where it is present.

    One pass over the data; columns that are full or empty are skipped.
    """
    y = present(df, target).cast("double")
    stats = []
    for i, c in enumerate(columns):
        hole = present(df, c).isNull()
        stats += [
            F.count_if(hole).alias(f"_n{i}"),
            F.avg(F.when(hole, y)).alias(f"_m{i}"),
            F.avg(F.when(~hole, y)).alias(f"_p{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *stats)
    per_column = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("colonne"),
                    F.col(f"_n{i}").alias("n_manquants"),
                    (100 * F.col(f"_m{i}")).alias("taux_si_manquant_%"),
                    (100 * F.col(f"_p{i}")).alias("taux_si_present_%"),
                )
                for i, c in enumerate(columns)
            ]
        )
    )
    return (
        wide.select("_rows", per_column.alias("_c"))
        .select("_rows", "_c.*")
        .where((F.col("n_manquants") > 0) & (F.col("n_manquants") < F.col("_rows")))
        .drop("_rows")
        .withColumn("ecart_pt", F.col("taux_si_manquant_%") - F.col("taux_si_present_%"))
    )


def _holed(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns neither full nor empty (one aggregate, one number per column)."""
    rows = missing_counts(df, columns).collect()
    counts = {r["colonne"]: (r["n_manquants"], r["n_lignes"]) for r in rows}
    return [c for c in columns if 0 < counts[c][0] < counts[c][1]]


def _indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_abs_{c}": present(df, c).isNull().cast("int") for c in columns})


def missing_vs_target(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    n_permutations: int = 500,
    seed: int = 0,
) -> DataFrame:
    """``missing_gaps`` with the noise ceiling and p-value of each gap, largest gap first."""
    holed = _holed(df, columns)
    marked = _indicators(df, holed)
    observed = group_spread_pairs(marked, [(target, f"_abs_{c}") for c in holed])
    tested = permutation_test(marked, observed, n_permutations, seed, kind="spread")
    noise = tested.select(
        F.substring("variable_2", 6, 10_000).alias("colonne"),
        (100 * F.col("bruit")).alias("bruit_95_pt"),
        "p_permutation",
    )
    return missing_gaps(df, holed, target).join(F.broadcast(noise), "colonne").orderBy(
        F.desc(F.abs("ecart_pt")), "colonne"
    )


def missing_mechanism(
    df: DataFrame,
    columns: Sequence[str],
    among: Sequence[str] | None = None,
    n_permutations: int = 500,
    seed: int = 0,
    quantile: float = 0.95,
) -> DataFrame:
    """For each holed column, the other column its absence depends on most.

    Numeric columns are judged by the gap of their means, the others by Cramér's V, each against
    its own noise; the lowest p-value wins, ties going to the first column. The hypothesis that
    values are missing completely at random falls when that p-value is below 1 − ``quantile``.
    """
    others = list(among or columns)
    holed = _holed(df, columns)
    marked = _indicators(df, holed)
    numeric = [o for o in others if is_numeric(df, o)]
    spread = [(o, f"_abs_{c}") for c in holed for o in numeric if o != c]
    nominal = [(o, f"_abs_{c}") for c in holed for o in others if o not in numeric and o != c]
    parts = []
    if spread:
        observed = group_spread_pairs(marked, spread)
        parts.append(
            permutation_test(marked, observed, n_permutations, seed, "spread", quantile)
            .withColumn("type", F.lit("numérique"))
        )
    if nominal:
        observed = association_pairs(marked, nominal)
        parts.append(
            permutation_test(marked, observed.drop("n_1", "n_2"), n_permutations, seed, "v", quantile)
            .withColumn("type", F.lit("catégorielle"))
        )
    tested = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rank = F.create_map(*[x for i, o in enumerate(others) for x in (F.lit(o), F.lit(i))])
    best = tested.groupBy(F.substring("variable_2", 6, 10_000).alias("colonne")).agg(
        F.min_by(
            F.struct("variable_1", "type", "valeur", "bruit", "p_permutation"),
            F.struct("p_permutation", rank[F.col("variable_1")]),
        ).alias("_b")
    )
    return best.select(
        "colonne",
        F.col("_b.variable_1").alias("variable_liee"),
        F.col("_b.type").alias("type"),
        F.col("_b.valeur").alias("mesure"),
        F.col("_b.bruit").alias("bruit_95"),
        F.col("_b.p_permutation").alias("p_permutation"),
        (F.col("_b.p_permutation") < 1 - quantile).alias("mcar_rejete"),
    ).orderBy("p_permutation", "colonne")


def nullity_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """φ between the missing indicators of the columns whose nullity varies."""
    return matrix_from_indicators(df, columns)

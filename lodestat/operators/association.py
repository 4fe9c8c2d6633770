"""Association measures over contingency tables, all pairs of columns in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import as_modality
from lodestat.operators.explore import missing_counts
from lodestat.operators.frequencies import is_numeric, present
from lodestat.operators.noise import permutation_test
from lodestat.operators.ranks import running_totals
from lodestat.session import FEW_GROUPS, materialized

Pair = tuple[str, str]
PAIR = ["variable_1", "variable_2"]
PAIRS_AT_ONCE = 60  # products that one aggregation sums up


def upper_pairs(names: Sequence[str]) -> list[Pair]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _per_pair(df: DataFrame, pairs: Sequence[Pair], fields) -> DataFrame:
    """One row per input row and pair; ``fields(a, b)`` gives the columns of the pair."""
    structs = [
        F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), *fields(a, b))
        for a, b in pairs
    ]
    return df.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")


def contingency(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """(variable_1, variable_2, a, b, n): the non-empty cells, absence being a modality."""
    return (
        _per_pair(
            df,
            pairs,
            lambda a, b: [
                as_modality(present(df, a)).alias("a"),
                as_modality(present(df, b)).alias("b"),
            ],
        )
        .groupBy(*PAIR, "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def association_pairs(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """(variable_1, variable_2, n_1, n_2, valeur): Cramér's V without bias correction.

    χ²/n + 1 = Σ n_ij² / (n_i · n_j) runs over non-empty cells only. 0 when a side is constant.
    """
    cells = contingency(df, pairs)
    left = cells.groupBy(*PAIR, "a").agg(F.sum("n").alias("n_a"))
    right = cells.groupBy(*PAIR, "b").agg(F.sum("n").alias("n_b"))
    share = F.col("n").cast("double") / F.col("n_a") * (F.col("n") / F.col("n_b"))
    n = F.col("n")
    # Σ n_ij / n_i over the cells of a line is 1, so the same pass counts lines and columns.
    total = (
        cells.join(left, [*PAIR, "a"])
        .join(right, [*PAIR, "b"])
        .groupBy(*PAIR)
        .agg(
            F.sum(share).alias("_s"),
            F.round(F.sum(n / F.col("n_a"))).cast("long").alias("n_1"),
            F.round(F.sum(n / F.col("n_b"))).cast("long").alias("n_2"),
        )
    )
    smaller = F.least("n_1", "n_2")
    value = F.when(smaller < 2, 0.0).otherwise(
        F.sqrt(F.greatest(F.col("_s") - 1, F.lit(0.0)) / (smaller - 1))
    )
    return total.select(*PAIR, "n_1", "n_2", value.alias("valeur"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return association_pairs(df, [(a, b)])


def cramers_v_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long upper triangle (variable_1, variable_2, valeur); see ``square_matrix``."""
    return association_pairs(df, upper_pairs(columns)).select(*PAIR, "valeur")


def square_matrix(pairs: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """Both triangles and the diagonal of a symmetric matrix given by its upper triangle."""
    swapped = pairs.select(
        F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), "valeur"
    )
    both = pairs.select(*PAIR, "valeur").unionByName(swapped)
    names = both.select("variable_1").distinct()
    return both.unionByName(
        names.select(
            "variable_1", F.col("variable_1").alias("variable_2"), F.lit(diagonal).alias("valeur")
        )
    )


def _group_moments(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Count, mean and population variance of the filled numbers of each modality of each pair."""
    rows = _per_pair(
        df,
        pairs,
        lambda a, b: [
            present(df, a).cast("double").alias("x"),
            as_modality(present(df, b)).alias("g"),
        ],
    )
    return rows.groupBy(*PAIR, "g").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )


def correlation_ratio_pairs(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """(variable_1 numeric, variable_2 nominal, n_2, valeur): η = √(between / total).

    0 below two groups or two values, or when the number is constant. The total is rebuilt as
    between + within, both sums of squares around means: no cancellation on large values.
    """
    groups = _group_moments(df, pairs)
    overall = groups.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_2"),
        F.sum("n").alias("_n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"),
    )
    shift = F.col("m") - F.col("_mean")
    sums = (
        groups.join(F.broadcast(overall), PAIR)
        .groupBy(*PAIR)
        .agg(
            F.first("n_2").alias("n_2"),
            F.first("_n").alias("_n"),
            F.sum(F.col("n") * shift * shift).alias("_between"),
            F.sum(F.col("n") * F.col("v")).alias("_within"),
        )
    )
    total = F.col("_between") + F.col("_within")
    defined = (F.col("n_2") >= 2) & (F.col("_n") >= 2) & (total > 0)
    value = F.when(defined, F.sqrt(F.col("_between") / total)).otherwise(0.0)
    return sums.select(*PAIR, "n_2", value.alias("valeur"))


def correlation_ratio(df: DataFrame, number: str, group: str) -> DataFrame:
    return correlation_ratio_pairs(df, [(number, group)])


def group_spread_pairs(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """(variable_1, variable_2, valeur): highest minus lowest group mean, absence included."""
    return (
        _group_moments(df, pairs)
        .groupBy(*PAIR)
        .agg((F.max("m") - F.min("m")).alias("valeur"))
    )


def group_spread(df: DataFrame, number: str, group: str) -> DataFrame:
    return group_spread_pairs(df, [(number, group)])


def correlation_pairs_all(
    df: DataFrame, columns: Sequence[str], method: str = "spearman"
) -> DataFrame:
    """(variable_1, variable_2, valeur) over rows where both are present; NULL if undefined.

    Spearman ranks are those of the rows the pair keeps. Pairs are formed inside a row and summed up before
    anything is shuffled; rows themselves move only where two columns and more have over ``FEW_GROUPS`` values.
    """
    if method == "pearson":
        rows = _per_pair(
            df,
            upper_pairs(columns),
            lambda a, b: [present(df, a).cast("double").alias("x"), present(df, b).cast("double").alias("y")],
        ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        return rows.groupBy(*PAIR).agg(F.corr("x", "y").alias("valeur"))

    gaps = {r["colonne"]: r["n_manquants"] for r in missing_counts(df, columns).collect()}
    found = _rank_products(df, list(columns), [c for c in columns if gaps[c] > 0])
    return df.sparkSession.createDataFrame(found, "variable_1 string, variable_2 string, valeur double")


def _rank_products(df: DataFrame, columns: list[str], holed: list[str]) -> list[tuple[str, str, float | None]]:
    """The rank correlation of every pair of columns that share rows.

    Ranks belong to distinct values, so all but the products of two ranks comes from tables of these. The ranks of
    columns of few values are looked up by every row in a broadcast table. The column of most values needs no look-up:
    the ranks of the others are added up by its values first, and these sums meet its ranks.
    """
    width = range(len(columns))
    wide = df.select(*[present(df, c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    # The ranks of a column are those of all its rows (place 0) and of the rows where a column with holes is present.
    place = [holed.index(c) + 1 if c in holed else 0 for c in columns]
    measures = [f"_n{k}" for k in range(len(holed) + 1)]
    counts = [F.count(F.lit(1)).alias("_n0"), *[F.count(f"_v{columns.index(c)}").alias(f"_n{k}") for k, c in enumerate(holed, 1)]]
    tables = [
        wide.where(F.col(f"_v{i}").isNotNull()).groupBy(F.col(f"_v{i}").alias("valeur")).agg(*counts).select(F.lit(i).alias("i"), "valeur", *measures)
        for i in width
    ]
    freq = materialized(reduce(DataFrame.unionByName, tables))
    totals = freq.groupBy("i").agg(*[F.sum(m).alias(f"_t{m}") for m in measures])
    ranks = materialized(
        running_totals(freq, ["i"], "valeur", measures)
        .join(F.broadcast(totals), "i")
        .select(
            "i",
            "valeur",
            F.array(*[F.col(f"avant_{m}") + (F.col(m) - F.col(f"_t{m}")) / 2 for m in measures]).alias("r"),
            F.array(*measures).alias("n"),
        )
    )
    cells = ranks.select("i", F.posexplode(F.arrays_zip("r", "n")).alias("k", "_c"))
    r, n = F.col("_c.r"), F.col("_c.n")
    sums = cells.groupBy("i", "k").agg(F.count(r).alias("values"), F.sum(n).alias("rows"), F.sum(r * r * n).alias("squares"))
    own = {(s["i"], s["k"]): s for s in sums.collect()}
    sizes = {i: own[i, 0]["values"] for i in width if (i, 0) in own}
    most = max(sizes, key=sizes.get, default=None)
    if most is not None and sizes[most] <= FEW_GROUPS:
        most = None
    looked = wide
    for i in sorted(set(sizes) - {most}, key=lambda i: -sizes[i]):
        table, value = ranks.where(F.col("i") == i).select(F.col("valeur").alias("_key"), F.col("r").alias(f"_r{i}")), F.col(f"_v{i}")
        if sizes[i] <= FEW_GROUPS:
            looked = looked.join(F.broadcast(table), value == F.col("_key"), "left").drop("_key")
        else:  # rows without the number are spread: they meet nothing
            spread = F.when(value.isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1000))).otherwise(F.lit(0).cast("long"))
            looked = (
                looked.withColumns({"_spread": spread, "_at": F.coalesce(value, F.lit(0.0))})
                .join(table.withColumn("_own", F.lit(0).cast("long")), (F.col("_at") == F.col("_key")) & (F.col("_spread") == F.col("_own")), "left")
                .drop("_key", "_own", "_at", "_spread")
            )
    pairs = [(i, j) for i in width for j in width if i < j and i in sizes and j in sizes and own[i, place[j]]["rows"]]
    rank = lambda i, j: F.get(F.col(f"_r{i}"), F.lit(place[j]))
    products: dict[tuple[int, int], float] = {}
    apart = [pair for pair in pairs if most not in pair]
    for begin in range(0, len(apart), PAIRS_AT_ONCE):
        lot = apart[begin : begin + PAIRS_AT_ONCE]
        products |= zip(lot, looked.agg(*[F.sum(rank(i, j) * rank(j, i)).alias(f"_p{k}") for k, (i, j) in enumerate(lot)]).first())
    with_most = [pair for pair in pairs if most in pair]
    for begin in range(0, len(with_most), PAIRS_AT_ONCE):
        lot = with_most[begin : begin + PAIRS_AT_ONCE]
        others = [i + j - most for i, j in lot]
        added = (
            looked.where(F.col(f"_v{most}").isNotNull())
            .groupBy(F.col(f"_v{most}").alias("valeur"))
            .agg(*[F.sum(rank(j, most)).alias(f"_s{j}") for j in others])
            .join(ranks.where(F.col("i") == most).select("valeur", "r"), "valeur")
        )
        met = added.agg(*[F.sum(F.get("r", F.lit(place[j])) * F.col(f"_s{j}")).alias(f"_p{j}") for j in others])
        products |= zip(lot, met.first())
    out = []
    for i, j in pairs:
        spread = math.sqrt(own[i, place[j]]["squares"]) * math.sqrt(own[j, place[i]]["squares"])
        out.append((columns[i], columns[j], products[i, j] / spread if spread > 0 else None))
    return out


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], method: str = "spearman"
) -> DataFrame:
    return correlation_pairs_all(df, columns, method)


def matrix_pairs(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs with |value| ≥ threshold, strongest first, undefined ones dropped."""
    return pairs.where(F.abs("valeur") >= threshold).orderBy(F.desc(F.abs("valeur")), *PAIR)


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "spearman", threshold: float = 0.0
) -> DataFrame:
    return matrix_pairs(correlation_pairs_all(df, columns, method), threshold)


def association_matrix(
    df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], method: str = "spearman"
) -> DataFrame:
    """(variable_1, variable_2, mesure, valeur) in 0–1 over mixed types, upper triangle.

    |ρ| between numbers (0 where undefined), η between a number and a nominal, V between nominals.
    """
    parts = []
    if len(numeric) > 1:
        rho = correlation_pairs_all(df, numeric, method)
        every = df.sparkSession.createDataFrame(upper_pairs(numeric), "variable_1 string, variable_2 string")
        parts.append(
            every.join(F.broadcast(rho), PAIR, "left").select(
                *PAIR,
                F.lit("correlation").alias("mesure"),
                F.coalesce(F.abs("valeur"), F.lit(0.0)).alias("valeur"),
            )
        )
    if numeric and nominal:
        crossed = [(a, b) for a in numeric for b in nominal]
        parts.append(
            correlation_ratio_pairs(df, crossed).select(*PAIR, F.lit("eta").alias("mesure"), "valeur")
        )
    if len(nominal) > 1:
        parts.append(
            association_pairs(df, upper_pairs(nominal)).select(
                *PAIR, F.lit("v_cramer").alias("mesure"), "valeur"
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def categorical_association(
    df: DataFrame, columns: Sequence[str], target: str, n_permutations: int = 500, seed: int = 0
) -> DataFrame:
    """Each nominal column against the target: groups, V, its noise ceiling and p-value."""
    observed = association_pairs(df, [(c, target) for c in columns])
    return (
        permutation_test(df, observed, n_permutations, seed, "v")
        .select(
            F.col("variable_1").alias("colonne"),
            F.col("n_1").alias("n_groupes"),
            F.col("valeur").alias("v_cramer"),
            F.col("bruit").alias("bruit_95"),
            "p_permutation",
        )
        .orderBy(F.desc("v_cramer"), "colonne")
    )


def association_with(
    df: DataFrame, features: Sequence[str], target: str, n_permutations: int = 500, seed: int = 0
) -> DataFrame:
    """Each feature against a nominal target on a 0–1 scale, with its own noise and p-value."""
    numeric = [f for f in features if is_numeric(df, f)]
    nominal = [f for f in features if f not in numeric]
    parts = []
    if numeric:
        observed = correlation_ratio_pairs(df, [(f, target) for f in numeric])
        parts.append(
            permutation_test(df, observed, n_permutations, seed, "eta").withColumns(
                {"type": F.lit("numérique"), "mesure": F.lit("η")}
            )
        )
    if nominal:
        observed = association_pairs(df, [(f, target) for f in nominal])
        parts.append(
            permutation_test(df, observed.drop("n_1"), n_permutations, seed, "v")
            .withColumns({"type": F.lit("catégorielle"), "mesure": F.lit("V de Cramér")})
        )
    tested = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return tested.select(
        F.col("variable_1").alias("colonne"),
        "type",
        "mesure",
        F.col("valeur").alias("association"),
        F.col("bruit").alias("bruit_95"),
        "p_permutation",
    ).orderBy(F.desc("association"), "colonne")


def matrix_from_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """φ of every pair of missing indicators that vary, from the counts of their combinations."""
    combos = df.groupBy(*[present(df, c).isNull().cast("long").alias(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    structs = [
        F.struct(
            F.lit(a).alias("variable_1"),
            F.lit(b).alias("variable_2"),
            F.col(f"`{a}`").alias("ia"),
            F.col(f"`{b}`").alias("ib"),
        )
        for a, b in upper_pairs(columns)
    ]
    n, ia, ib = F.col("_n").cast("double"), F.col("ia"), F.col("ib")
    sums = (
        combos.select("_n", F.explode(F.array(*structs)).alias("_p"))
        .select("_n", "_p.*")
        .groupBy(*PAIR)
        .agg(
            F.sum(n).alias("t"),
            F.sum(n * ia).alias("a"),
            F.sum(n * ib).alias("b"),
            F.sum(n * ia * ib).alias("ab"),
        )
    )
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    vary = (a > 0) & (a < t) & (b > 0) & (b < t)
    phi = (t * F.col("ab") - a * b) / (F.sqrt(a * (t - a)) * F.sqrt(b * (t - b)))
    return sums.where(vary).select(*PAIR, phi.alias("valeur"))

"""Population drift between a reference and a current batch, all variables in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.frequencies import long_numbers, modality_frequencies
from lodestat.operators.ranks import hash_positions, quantiles, running_totals, seeded_hash
from lodestat.session import materialized

# Fixed values.
STABLE, WATCH, ALERT = "stable", "à surveiller", "alerte"
EPSILON = 1e-6
WATCH_LEVEL, ALERT_LEVEL, MIN_ROWS = 0.1, 0.25, 200
RECALL_MARGIN = 0.05
_TERMS = 100  # of the Kolmogorov series; the terms vanish long before
_TURNS, _WALK = 4, 80  # of the network that shuffles numbers: its rounds, and how often it may leave the range


def _stability(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(colonne, psi) from (colonne, cell, n_ref, n_cur); NULL when a side is empty."""
    expected = F.col("n_ref") / F.col("t_ref")
    actual = F.col("n_cur") / F.col("t_cur")
    e = F.when(expected == 0, EPSILON).otherwise(expected)
    a = F.when(actual == 0, EPSILON).otherwise(actual)
    both = (F.col("t_ref") > 0) & (F.col("t_cur") > 0)
    return (
        counts.join(F.broadcast(totals), "colonne")
        .where(both)
        .groupBy("colonne")
        .agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    )


def _side_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("colonne").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")
    )


def _both_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of both samples with a weight on each side."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return reference.withColumns({"n_ref": one, "n_cur": none}).unionByName(
        current.withColumns({"n_ref": none, "n_cur": one})
    )


def psi_numeric(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """(colonne, psi): bins cut at the reference's quantiles, open at both ends.

    0 for a constant reference, NULL when a side has no value.
    """
    ref, cur = long_numbers(reference, columns), long_numbers(current, columns)
    cuts = [i / bins for i in range(bins + 1)]
    edges = quantiles(ref, cuts).select(
        "colonne", F.array_sort(F.array_distinct("quantiles")).alias("_edges")
    )
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.size(F.filter("_inner", lambda e: e <= F.col("valeur")))
    rows = _both_sides(ref, cur).join(
        F.broadcast(edges.withColumn("_inner", inner)), "colonne", "left"
    )
    counts = rows.groupBy("colonne", F.coalesce(place, F.lit(0)).alias("classe")).agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )
    return _stability(counts, _side_totals(counts))


def psi_categorical(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(colonne, psi): proportions over the union of the modalities of both samples."""
    none = F.lit(0).cast("long")
    ref = modality_frequencies(reference, columns).select(
        "colonne", "valeur", F.col("n").alias("n_ref"), none.alias("n_cur")
    )
    cur = modality_frequencies(current, columns).select(
        "colonne", "valeur", none.alias("n_ref"), F.col("n").alias("n_cur")
    )
    counts = ref.unionByName(cur).groupBy("colonne", "valeur").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )
    return _stability(counts, _side_totals(counts))


def _kolmogorov(x: Column) -> Column:
    """Survival function of the Kolmogorov law, by its two series (small and large arguments)."""
    orders = F.sequence(F.lit(1), F.lit(_TERMS))
    tail = F.aggregate(
        orders,
        F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), (k - 1).cast("double")) * F.exp(-2 * k * k * x * x),
    )
    head = F.aggregate(
        orders,
        F.lit(0.0),
        lambda acc, k: acc
        + F.exp(-F.pow((2 * k - 1).cast("double"), F.lit(2.0)) * (math.pi**2) / (8 * x * x)),
    )
    p = F.when(x <= 0, 1.0).when(x < 1, 1 - F.lit(math.sqrt(2 * math.pi)) / x * head).otherwise(2 * tail)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def ks_two_sample(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, ks_statistic, ks_pvalue): largest gap of the two distribution functions.

    The p-value is the asymptotic one.
    """
    rows = _both_sides(long_numbers(reference, columns), long_numbers(current, columns))
    counts = rows.groupBy("colonne", "valeur").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )
    totals = _side_totals(counts)
    upto = running_totals(counts, ["colonne"], "valeur", ["n_ref", "n_cur"]).join(
        F.broadcast(totals), "colonne"
    )
    gap = F.abs(
        (F.col("avant_n_ref") + F.col("n_ref")) / F.col("t_ref")
        - (F.col("avant_n_cur") + F.col("n_cur")) / F.col("t_cur")
    )
    a, b = F.col("t_ref").cast("double"), F.col("t_cur").cast("double")
    return (
        upto.where((F.col("t_ref") > 0) & (F.col("t_cur") > 0))
        .groupBy("colonne", "t_ref", "t_cur")
        .agg(F.max(gap).alias("ks_statistic"))
        .select(
            "colonne",
            "ks_statistic",
            _kolmogorov(F.col("ks_statistic") * F.sqrt(a * b / (a + b))).alias("ks_pvalue"),
        )
    )


def mean_shift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonne, shift_std): shift of the mean in population deviations of the reference."""
    ref = long_numbers(reference, columns).groupBy("colonne").agg(
        F.avg("valeur").alias("_m"), F.stddev_pop("valeur").alias("_s")
    )
    cur = long_numbers(current, columns).groupBy("colonne").agg(F.avg("valeur").alias("_c"))
    shift = F.when(F.col("_s") > 0, (F.col("_c") - F.col("_m")) / F.col("_s"))
    return ref.join(F.broadcast(cur), "colonne").select("colonne", shift.alias("shift_std"))


def verdict(psi: Column, watch: float = WATCH_LEVEL, alert: float = ALERT_LEVEL) -> Column:
    return F.when(psi >= alert, ALERT).when(psi >= watch, WATCH).otherwise(STABLE)


def assess_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    watch: float = WATCH_LEVEL,
    alert: float = ALERT_LEVEL,
    bins: int = 10,
) -> DataFrame:
    """(variable, psi, ks_statistic, ks_pvalue, shift_std, verdict), most drifted first."""
    spark = reference.sparkSession
    parts = []
    if numeric:
        names = spark.createDataFrame([(c,) for c in numeric], "colonne string")
        parts.append(
            names.join(F.broadcast(psi_numeric(reference, current, numeric, bins)), "colonne", "left")
            .join(F.broadcast(ks_two_sample(reference, current, numeric)), "colonne", "left")
            .join(F.broadcast(mean_shift(reference, current, numeric)), "colonne", "left")
        )
    if categorical:
        names = spark.createDataFrame([(c,) for c in categorical], "colonne string")
        nothing = F.lit(None).cast("double")
        parts.append(
            names.join(F.broadcast(psi_categorical(reference, current, categorical)), "colonne", "left")
            .withColumns({"ks_statistic": nothing, "ks_pvalue": nothing, "shift_std": nothing})
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return table.select(
        F.col("colonne").alias("variable"),
        "psi",
        "ks_statistic",
        "ks_pvalue",
        "shift_std",
        verdict(F.col("psi"), watch, alert).alias("verdict"),
    ).orderBy(F.desc_nulls_last("psi"), "variable")


def campaign_verdict(
    variables: DataFrame,
    current: DataFrame,
    min_rows: int = MIN_ROWS,
    watch: float = WATCH_LEVEL,
    alert: float = ALERT_LEVEL,
) -> DataFrame:
    """One row (mesurable, motif, psi_max, verdict) of the whole batch.

    Below ``min_rows`` the batch is not measurable, and says why.
    """
    size = current.agg(F.count(F.lit(1))).scalar()
    enough = F.col("_n") >= min_rows
    reason = F.concat(
        F.lit("campagne de "),
        F.col("_n").cast("string"),
        F.lit(f" dossiers : dérive non mesurable sous {min_rows}"),
    )
    return (
        variables.agg(F.max("psi").alias("_psi"))
        .withColumn("_n", size)
        .select(
            enough.alias("mesurable"),
            F.when(~enough, reason).alias("motif"),
            F.when(enough, F.col("_psi")).alias("psi_max"),
            F.when(enough, verdict(F.col("_psi"), watch, alert)).otherwise(STABLE).alias("verdict"),
        )
    )


def action(psi_max: Column, labelled_recall: Column, recall_target: float) -> Column:
    """What to do about a batch: retrain only on a measured loss of recall."""
    lost = labelled_recall <= recall_target - RECALL_MARGIN
    return (
        F.when(lost, "réentraîner").when(psi_max >= ALERT_LEVEL, "revue humaine").otherwise("aucune")
    )


def campaign_drift_table(variables: DataFrame) -> DataFrame:
    """Flat rows ready to be written: NaN as NULL."""
    numbers = [c for c, t in variables.dtypes if t == "double"]
    return variables.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in numbers})


def deidentified_reference(
    df: DataFrame, columns: Sequence[str], key: str, seed: int = 0
) -> DataFrame:
    """Each column shuffled on its own: marginals intact, no row left of the original.

    ``key`` identifies rows. They are numbered once, in the order of a seeded hash of the key, and each column
    moves its values by a keyed permutation of these numbers, so the result does not depend on how the data
    are spread. A column travels alone, as (number, value), and all are joined by number.
    """
    renamed = [F.col(c).alias(f"_v{k}") for k, c in enumerate(columns)]
    hashed = df.select(F.col(key).alias("_cle"), seeded_hash(seed, F.col(key)).alias("_h"), *renamed)
    placed = materialized(hash_positions(hashed, [], "_h", "_cle").drop("_h", "_cle"))
    n = placed.count()
    moved = [
        placed.select(permuted("position", n, seed, c).alias("_place"), F.col(f"_v{k}").alias(f"_v{k}"))
        for k, c in enumerate(columns)
    ]
    joined = reduce(lambda left, right: left.join(right, "_place"), moved)
    return joined.select(*[F.col(f"_v{k}").alias(c) for k, c in enumerate(columns)])


def permuted(place: Column | str, n: int, *secret) -> Column:
    """The image of a number of 0 to ``n`` - 1 under the permutation that ``secret`` names.

    A Feistel network permutes the numbers of as many bits as ``n`` needs, and a number that leaves the range goes
    through it again until it is back. Each turn ends with a chance over one half, so ``_WALK`` turns fail
    with a chance under 2**-80; the job would stop then.
    """
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    masks = ((1 << (bits - low)) - 1, (1 << low) - 1)

    def network(x: Column) -> Column:
        halves = [F.shiftright(x, low), x.bitwiseAND(F.lit(masks[1]).cast("long"))]
        for turn in range(_TURNS):
            mine, other = turn % 2, 1 - turn % 2
            noise = F.xxhash64(*[F.lit(s) for s in secret], F.lit(turn), halves[other])
            halves[mine] = halves[mine].bitwiseXOR(noise.bitwiseAND(F.lit(masks[mine]).cast("long")))
        return F.shiftleft(halves[0], low).bitwiseOR(halves[1])

    start = network((F.col(place) if isinstance(place, str) else place).cast("long"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)), start, lambda x, _: F.when(x < n, x).otherwise(network(x))
    )
    return F.when(walked < n, walked).otherwise(
        F.raise_error(F.lit("a number did not come back into its range")).cast("long")
    )

"""Metrics of scored tables ``(y, p)``: ranks, curves, calibration, thresholds, subgroups.

Everything that needs an order works on distinct scores with running totals, never on a global
window. ``keys`` group several models, folds or subgroups in one pass.

Per-key tables (totals, bucket offsets, bin edges) are broadcast: they hold a few hundred numbers
per key, so keys are meant to be few. ``score_totals`` counts them and drops the hint beyond
``FEW_KEYS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.ranks import attach, quantiles, running_totals

# The grid of decision thresholds.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
FEW_KEYS = 1_000  # groups whose bucket offsets are broadcast


def score_totals(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it, and at or above it (tp, fp)."""
    keys = list(keys)
    positive = F.col(y) == 1
    counts = df.groupBy(*keys, F.col(p).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    few = not keys or df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] <= FEW_KEYS
    ranked = running_totals(counts, keys, "score", ["pos", "neg"], few)
    return attach(ranked, totals, keys, ["n_pos", "n_neg"], few).withColumns(
        {
            "tp": F.col("n_pos") - F.col("avant_pos"),
            "fp": F.col("n_neg") - F.col("avant_neg"),
        }
    )


def roc_auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc): probability that a positive outranks a negative, ties counting half."""
    t = score_totals(df, y, p, keys)
    wins = F.col("pos") * (F.col("avant_neg") + F.col("neg") / 2.0)
    total = F.first("n_pos").cast("double") * F.first("n_neg")
    return t.groupBy(*keys).agg(F.try_divide(F.sum(wins), total).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pr_auc): step sum of precision over the gains of recall."""
    t = score_totals(df, y, p, keys)
    step = F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.groupBy(*keys).agg(F.sum(step).alias("pr_auc"))


def brier(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(error * error).alias("brier"))


def classification_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc, pr_auc, brier) from one table of distinct scores."""
    t = score_totals(df, y, p, keys)
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    wins = pos * (F.col("avant_neg") + neg / 2.0)
    step = pos / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    squares = pos * (score - 1) * (score - 1) + neg * score * score
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(wins), F.first("n_pos").cast("double") * F.first("n_neg")).alias("roc_auc"),
        F.sum(step).alias("pr_auc"),
        (F.sum(squares) / F.sum(pos + neg)).alias("brier"),
    )


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mae, rmse, r2)."""
    error = F.col(p) - F.col(y)
    squares = F.avg(error * error)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squares).alias("rmse"),
        (1 - F.try_divide(squares, F.var_pop(y))).alias("r2"),
    )


def roc_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, seuil, fpr, tpr) at each distinct score, and the origin (seuil infinite)."""
    t = score_totals(df, y, p, keys)
    points = t.select(
        *keys,
        F.col("score").alias("seuil"),
        (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )
    origin = df.groupBy(*keys).agg(
        F.max(F.lit(float("inf"))).alias("seuil"),
        F.max(F.lit(0.0)).alias("fpr"),
        F.max(F.lit(0.0)).alias("tpr"),
    )
    return points.unionByName(origin)


def pr_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, seuil, rappel, precision, prevalence) at each distinct score."""
    t = score_totals(df, y, p, keys)
    return t.select(
        *keys,
        F.col("score").alias("seuil"),
        (F.col("tp") / F.col("n_pos")).alias("rappel"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("prevalence"),
    )


def calibration_curve(
    df: DataFrame, y: str, p: str, n_bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, classe, n, moyenne_predite, frequence_observee) over quantile bins of the score.

    The bin of a score is the number of inner edges strictly below it; empty bins do not show.
    """
    rows = df.select(*keys, F.col(y).alias("_y"), F.col(p).cast("double").alias("_p"))
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles(rows, inner, keys, "_p").withColumnRenamed("quantiles", "_edges")
    place = F.size(F.filter("_edges", lambda e: e < F.col("_p")))
    return (
        attach(rows, edges, keys, ["_edges"])
        .groupBy(*keys, place.alias("classe"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("_p").alias("moyenne_predite"),
            F.avg("_y").alias("frequence_observee"),
        )
    )


def confusion_counts(
    df: DataFrame, y: str, p: str, threshold: float, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, tn, fp, fn, tp) where a score at or above the threshold is flagged."""
    flagged, positive = F.col(p) >= threshold, F.col(y) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~flagged & ~positive).alias("tn"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(flagged & positive).alias("tp"),
    )


def _ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def threshold_table(
    df: DataFrame, y: str, p: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Per threshold: recall, precision, F2, alerts, hits, misses, share of the population.

    Each row is reduced to the number of thresholds it reaches: the table of counts has one row
    per threshold whatever the data, and thresholds are read off its running sums.
    """
    cuts = sorted(float(t) for t in thresholds)
    reached = sum([(F.col(p) >= t).cast("int") for t in cuts], F.lit(0))
    counts = df.groupBy(reached.alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == 1).alias("_pos")
    )
    listed = counts.agg(
        F.collect_list(F.struct("_k", "_n", "_pos")).alias("_c"),
        F.sum("_n").alias("_total"),
        F.sum("_pos").alias("_positifs"),
    )

    def above(index: Column, field: str) -> Column:
        return F.aggregate(
            F.filter("_c", lambda c: c["_k"] > index),
            F.lit(0).cast("long"),
            lambda acc, c: acc + c[field],
        )

    grid = F.array(*[F.lit(t) for t in cuts])
    rows = listed.select("*", F.posexplode(grid).alias("_i", "seuil")).select(
        "seuil",
        above(F.col("_i"), "_n").alias("n_alertes"),
        above(F.col("_i"), "_pos").alias("tp"),
        "_total",
        "_positifs",
    )
    recall = _ratio_or_zero(F.col("tp"), F.col("_positifs"))
    precision = _ratio_or_zero(F.col("tp"), F.col("n_alertes"))
    return rows.withColumns({"rappel": recall, "precision": precision}).select(
        "seuil",
        "rappel",
        "precision",
        _ratio_or_zero(
            5 * F.col("precision") * F.col("rappel"), 4 * F.col("precision") + F.col("rappel")
        ).alias("f2"),
        "n_alertes",
        "tp",
        (F.col("_positifs") - F.col("tp")).alias("n_FN"),
        (F.col("n_alertes") / F.col("_total")).alias("pct_promo"),
    )


def pick_threshold(
    df: DataFrame,
    y: str,
    p: str,
    *,
    recall_target: float | None = None,
    capacity_n: int | None = None,
    capacity_pct: float | None = None,
) -> DataFrame:
    """One row ``seuil`` under exactly one policy.

    The highest score whose recall holds the target (the lowest score if none does), or the n-th
    highest score, n being clamped to the population and a share rounded half to even.
    """
    if sum(c is not None for c in (recall_target, capacity_n, capacity_pct)) != 1:
        raise ValueError("give exactly one of recall_target, capacity_n, capacity_pct")
    t = score_totals(df, y, p)
    if recall_target is not None:
        holds = F.col("tp") / F.col("n_pos") >= recall_target
        return t.agg(
            F.coalesce(F.max(F.when(holds, F.col("score"))), F.min("score")).alias("seuil")
        )
    size = F.col("n_pos") + F.col("n_neg")
    wanted = F.lit(capacity_n) if capacity_n is not None else F.bround(F.lit(capacity_pct) * size, 0)
    wanted = F.greatest(F.lit(1), F.least(wanted.cast("long"), size))
    return t.where(F.col("tp") + F.col("fp") >= wanted).agg(F.max("score").alias("seuil"))


def capacity_threshold(df: DataFrame, p: str, capacity: int) -> DataFrame:
    """One row ``seuil`` that flags at most ``capacity`` rows, ties at the cut included.

    1.0 for an empty batch, 0.0 when everyone fits.
    """
    scored = df.select(F.col(p).alias("_p"), F.lit(1).alias("_y"))
    found = score_totals(scored, "_y", "_p").where(F.col("tp") >= capacity).agg(
        F.max("score").alias("_cut")
    )
    size = scored.agg(F.count(F.lit(1))).scalar()
    return found.select(
        F.when(size == 0, 1.0).when(size <= capacity, 0.0).otherwise(F.col("_cut")).alias("seuil")
    )


def point_metrics(
    df: DataFrame, y: str, p: str, threshold: float, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, rappel, precision, f1, f2) at one threshold, 0 where undefined."""
    counts = confusion_counts(df, y, p, threshold, keys)
    recall = _ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    precision = _ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    r, q = F.col("rappel"), F.col("precision")
    return counts.withColumns({"rappel": recall, "precision": precision}).select(
        *keys,
        "rappel",
        "precision",
        _ratio_or_zero(2 * q * r, q + r).alias("f1"),
        _ratio_or_zero(5 * q * r, 4 * q + r).alias("f2"),
    )


def alert_volumes(points: DataFrame, prevalence: float, size: int) -> DataFrame:
    """Expected volumes of a cohort: positives, detected, missed and flagged rows."""
    expected = F.lit(prevalence * size)
    detected = F.col("rappel") * expected
    return points.select(
        expected.alias("n_attendus"),
        detected.alias("n_detectes"),
        (expected - detected).alias("n_manques"),
        F.when(F.col("precision") > 0, detected / F.col("precision")).otherwise(0.0).alias("n_signales"),
    )


def fairness_audit(
    df: DataFrame, y: str, p: str, threshold: float, attributes: Sequence[str]
) -> DataFrame:
    """(attribut, groupe, n, positifs, rappel, precision): overall row, then every subgroup.

    All attributes in one pass, as grouping sets. Rates are NULL where undefined.
    """
    flagged, positive = F.col(p) >= threshold, F.col(y) == 1
    marks = df.select(
        *[F.col(a).cast("string").alias(a) for a in attributes],
        flagged.alias("_flag"),
        positive.alias("_pos"),
    )
    names = F.filter(
        F.array(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in attributes]), lambda a: a.isNotNull()
    )
    tp = F.count_if(F.col("_flag") & F.col("_pos"))
    sets = marks.groupingSets([[], *[[F.col(a)] for a in attributes]], *[F.col(a) for a in attributes]).agg(
        F.coalesce(F.get(names, F.lit(0)), F.lit("ensemble")).alias("attribut"),
        F.coalesce(*[F.col(a) for a in attributes]).alias("groupe"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_pos")).alias("positifs"),
        F.try_divide(tp, F.count_if(F.col("_pos"))).alias("rappel"),
        F.try_divide(tp, F.count_if(F.col("_flag"))).alias("precision"),
    )
    return sets.select("attribut", "groupe", "n", "positifs", "rappel", "precision")


def rare_subgroups(audit: DataFrame, max_share: float = 0.05) -> DataFrame:
    """Subgroups of an audit that hold less than ``max_share`` of the rows."""
    total = audit.where(F.col("attribut") == "ensemble").agg(F.max("n")).scalar()
    return audit.where((F.col("attribut") != "ensemble") & (F.col("n") / total < max_share))

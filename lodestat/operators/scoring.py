"""Batch scoring: probabilities, flags, exact additive explanations, views of a campaign."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.numbers import clip, decimal_comma, sigmoid
from lodestat.operators.contract import ERRORS, Contract, accepted, reference_of, validate_rows
from lodestat.operators.metrics import capacity_threshold
from lodestat.session import materialized

# Fixed values.
MARK_RANGE = (0.0, 20.0)
UNGROUPED = "autres"
TOP_VARIABLES = 6
CAPACITY_ORIGIN = "capacite"


def resolve_threshold(
    call: float | None = None, configured: float | None = None, declared: float | None = None
) -> tuple[float | None, str | None]:
    """Effective threshold and where it comes from: the call, the configuration, the model."""
    for value, origin in ((call, "appel"), (configured, "configuration"), (declared, "fiche")):
        if value is not None:
            if not 0 <= value <= 1:
                raise ValueError("a threshold lies between 0 and 1")
            return float(value), origin
    return None, None


def check_policy(threshold: float | None, capacity: int | None, shows_flag: bool) -> None:
    """Threshold and capacity set the same cut, and mean nothing when no flag is shown."""
    if threshold is not None and capacity is not None:
        raise ValueError("threshold and capacity are exclusive")
    if not shows_flag and (threshold is not None or capacity is not None):
        raise ValueError("threshold and capacity require the flag to be shown")
    if capacity is not None and capacity < 1:
        raise ValueError("a capacity is at least 1")


def score_columns(
    probability: Column,
    mark: Column,
    threshold: Column | float | None = None,
    origin: str | None = None,
) -> dict[str, Column]:
    """Output columns of a scored row; the flag is NULL when no threshold is given."""
    cut = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    flag = F.lit(None).cast("boolean") if cut is None else probability >= cut
    return {
        "probability": probability,
        "moyenne_finale": clip(mark, *MARK_RANGE),
        "signaled": flag,
        "seuil_applique": F.lit(None).cast("double") if cut is None else cut,
        "provenance_seuil": F.lit(origin).cast("string"),
    }


def score_batch(
    df: DataFrame,
    probability: Column,
    mark: Column,
    references: Sequence[str] = (),
    threshold: Column | float | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Adds reference, probability, bounded mark and flag; rows are never reordered by risk."""
    return df.withColumns(
        {
            "reference": reference_of(df, references),
            **score_columns(probability, mark, threshold, origin),
        }
    )


def score_cohort(
    df: DataFrame, contract: Contract, score, capacity: int | None = None, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, refused, summary) of a batch; ``score(accepted)`` adds ``_p`` and ``_note``.

    With a ``capacity``, the threshold is the one that flags so many rows of this batch at most; the scores are
    then written first, so that no model runs twice.
    """
    judged = validate_rows(df, contract)
    valid = accepted(judged)
    rated = score(valid)
    if capacity is not None:
        check_policy(options.get("threshold"), capacity, True)
        rated = materialized(rated)
        cut = capacity_threshold(rated, "_p", capacity).scalar()
        options = {**options, "threshold": cut, "origin": CAPACITY_ORIGIN}
    scored = score_batch(rated, F.col("_p"), F.col("_note"), contract.references, **options).drop(
        "_p", "_note"
    )
    bad = judged.where(F.size(ERRORS) > 0).withColumn("reference", reference_of(df, contract.references))
    return scored, bad, cohort_summary(scored_union_refused(scored, bad))


def scored_union_refused(scored: DataFrame, refused: DataFrame) -> DataFrame:
    """Both outcomes in one table, the columns a side lacks being NULL."""
    a = scored.withColumn("statut", F.lit("score"))
    b = refused.withColumn("statut", F.lit("refuse"))
    return a.unionByName(b, allowMissingColumns=True)


def cohort_summary(both: DataFrame) -> DataFrame:
    """One row: received, scored, refused, share flagged (NULL when no flag is shown)."""
    scored = F.col("statut") == "score"
    return both.agg(
        F.count(F.lit(1)).alias("recus"),
        F.count_if(scored).alias("scores"),
        F.count_if(~scored).alias("refuses"),
        F.avg(F.when(scored, F.col("signaled").cast("int"))).alias("part_signalee"),
    )


def _entries(cells: Mapping[str, Column], ordered: bool, top: int | None = None) -> Column:
    """Array of (nom, contribution), strongest first if ``ordered``; built-in functions only."""
    if not ordered:
        return F.array(
            *[F.struct(F.lit(n).alias("nom"), c.alias("contribution")) for n, c in cells.items()]
        )
    keyed = F.sort_array(
        F.array(
            *[
                F.struct((-F.abs(c)).alias("k"), F.lit(n).alias("nom"), c.alias("contribution"))
                for n, c in cells.items()
            ]
        )
    )
    kept = F.slice(keyed, 1, top) if top is not None else keyed
    names, values = kept.getField("nom").alias("nom"), kept.getField("contribution")
    return F.arrays_zip(names, values.alias("contribution"))


def contributions(
    df: DataFrame,
    terms: Mapping[str, Column],
    intercept: float,
    themes: Mapping[str, str] | None = None,
    ordered: bool = False,
    top: int | None = None,
) -> DataFrame:
    """Exact additive log-odds of a linear model, per source variable and per theme.

    ``terms`` gives the summed ``coefficient × encoded value`` of each source variable. Adds
    ``logit``, ``probability``, ``par_variable`` and ``par_theme`` (arrays of nom, contribution).
    One projection: no shuffle and no Python.
    """
    by_theme: dict[str, list[str]] = {}
    for name in terms:
        by_theme.setdefault((themes or {}).get(name, UNGROUPED), []).append(name)
    cells = {name: f"_c{i}" for i, name in enumerate(terms)}
    wide = df.withColumns({cells[name]: term for name, term in terms.items()})

    def total(names: Sequence[str]) -> Column:
        result = F.col(cells[names[0]])
        for name in names[1:]:
            result = result + F.col(cells[name])
        return result

    logit = F.lit(float(intercept)) + total(list(terms))
    variables = {n: F.col(c) for n, c in cells.items()}
    grouped = {t: total(names) for t, names in by_theme.items()}
    return wide.withColumns(
        {
            "logit": logit,
            "probability": sigmoid(logit),
            "par_variable": _entries(variables, ordered, top),
            "par_theme": _entries(grouped, ordered),
        }
    ).drop(*cells.values())


def top_contributions(
    df: DataFrame,
    terms: Mapping[str, Column],
    intercept: float,
    themes: Mapping[str, str] | None = None,
    top: int = TOP_VARIABLES,
) -> DataFrame:
    """``contributions`` with the strongest variables only, and all themes strongest first."""
    return contributions(df, terms, intercept, themes, ordered=True, top=top)


def global_importance(df: DataFrame, encoded: Mapping[str, Sequence[tuple[float, Column]]]) -> DataFrame:
    """(variable, importance): mean |coefficient × (z − mean z)| summed over encoded columns.

    ``encoded`` maps a source variable to its (coefficient, encoded column) pairs. The means are
    one scalar sub-query; the second pass is one aggregation.
    """
    flat = [(name, coef, z) for name, pairs in encoded.items() for coef, z in pairs]
    means = df.agg(F.array(*[F.avg(z) for _, _, z in flat])).scalar()
    per_output = (
        df.withColumn("_means", means)
        .agg(
            *[
                F.avg(F.abs(F.lit(coef) * (z - F.col("_means")[i]))).alias(f"_o{i}")
                for i, (_, coef, z) in enumerate(flat)
            ]
        )
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("variable"), F.col(f"_o{i}").alias("v"))
                for i, (name, _, _) in enumerate(flat)
            ]
        )
    )
    return (
        per_output.select(rows.alias("_r"))
        .select("_r.*")
        .groupBy("variable")
        .agg(F.sum("v").alias("importance"))
    )


def campaign_view(scored: DataFrame, text: str = "", flagged_only: bool = False) -> DataFrame:
    """Rows whose reference contains the text (case ignored), flagged ones only if asked."""
    view = scored
    if text:
        view = view.where(F.lower("reference").contains(text.lower()))
    return view.where(F.coalesce("signaled", F.lit(False))) if flagged_only else view


def page_view(
    df: DataFrame, order: Sequence[tuple[str, bool]], page: int, size: int
) -> DataFrame:
    """One page of a table sorted by (column, descending) keys, missing values last."""
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    return df.orderBy(*keys).offset(page * size).limit(size)


def score_table(scored: DataFrame) -> DataFrame:
    """The written score table: probability on 4 decimals, mark on 2."""
    return scored.select(
        "reference",
        F.bround("probability", 4).alias("probability"),
        F.bround("moyenne_finale", 2).alias("moyenne_finale"),
        "signaled",
    )


def export_table(both: DataFrame) -> DataFrame:
    """The exported campaign: text cells, decimal commas, reasons of refusal in one field."""
    has_errors = ERRORS in both.columns
    reasons = (
        F.array_join(
            F.transform(ERRORS, lambda e: F.concat(e["champ"], F.lit(" : "), e["message"])), " | "
        )
        if has_errors
        else F.lit(None).cast("string")
    )
    return both.select(
        "reference",
        "statut",
        decimal_comma(F.col("probability"), 4).alias("probability"),
        decimal_comma(F.col("moyenne_finale"), 2).alias("moyenne_finale"),
        F.when(F.col("signaled"), "oui").when(~F.col("signaled"), "non").alias("signale"),
        F.coalesce(reasons, F.lit("")).alias("motifs"),
    )

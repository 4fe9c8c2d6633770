"""The three entry points: discover a table, train again on a new one, score a batch."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.numbers import clip
from lodestat.operators import metrics
from lodestat.operators.contract import Contract
from lodestat.operators.drift import assess_drift
from lodestat.operators.frequencies import long_text
from lodestat.operators.modeling import (
    MAX_NEW_CATEGORIES,
    Family,
    FittedModel,
    Preprocessor,
    build_regressors,
    logistic,
    out_of_fold,
    resolve_categories,
)
from lodestat.operators.prepare import (
    Vocabulary,
    build_gold,
    conform,
    declared_types,
    recode,
    table_fingerprint,
    transform,
)
from lodestat.operators.profiling import detect_units, infer_semantic_types
from lodestat.operators.protocol import assign_folds, stratified_split
from lodestat.operators.scoring import MARK_RANGE, check_policy, resolve_threshold, score_cohort
from lodestat.session import materialized

MAX_UNITS = 1_000


@dataclass(frozen=True)
class Spec:
    """Frozen decisions of a project: roles, exclusions, seed, policy, limits."""

    version: str
    target: str
    target_secondary: str
    key: tuple[str, ...]
    numeric_columns: tuple[str, ...]
    ordinal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    nominal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    vocabulary: Vocabulary = field(default_factory=dict)
    exclusions: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    matrix_excluded: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    ratios: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    themes: Mapping[str, str] = field(default_factory=dict)
    seed: int = 0
    test_size: float = 0.2
    n_splits: int = 5
    c: float = 0.1
    recall_target: float = 0.8
    trees: int = 100

    def roles(self, columns: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
        """(numeric, ordinal, nominal): numeric is what no other role claims."""
        ordinal = [c for c in self.ordinal if c in columns]
        nominal = [c for c in self.nominal if c in columns]
        reserved = {
            self.target,
            self.target_secondary,
            *self.protected,
            *self.matrix_excluded,
            *self.key,
            *self.ordinal,
            *self.nominal,
        }
        return [c for c in columns if c not in reserved], ordinal, nominal

    def features(self, columns: Sequence[str]) -> list[str]:
        """The minimised set: every feature but those of the removed blocks."""
        removed = set(self.removed)
        return [c for role in self.roles(columns) for c in role if c not in removed]


@dataclass
class TrainedRun:
    """What training leaves for scoring; ``units`` are those of the training table, so that the reading of a
    row never depends on the batch it comes in. ``refused`` names the columns left out of training, and why."""

    classifier: FittedModel
    regressor: FittedModel
    threshold: float
    holdout: dict[str, float]
    fingerprint: str
    rows: int
    units: dict[str, list[str]] = field(default_factory=dict)
    reference: DataFrame | None = None
    refused: dict[str, str] = field(default_factory=dict)


def discover(raw: DataFrame, vocabulary: Vocabulary | None = None) -> tuple[dict[str, str], DataFrame]:
    """Semantic types of a raw table and the curated table they lead to."""
    types = {r["colonne"]: r["type_semantique"] for r in infer_semantic_types(raw).collect()}
    return types, transform(raw, types, vocabulary)


def curate(raw: DataFrame, spec: Spec, units: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Raw text to the gold table, on declared types; numeric columns that hold free text are left out."""
    if units is None:
        units = known_units(raw, spec)
        spec = _without(spec, _free_text(raw, spec, units))
    types = declared_types(raw.columns, spec.numeric_columns)
    drop = [c for c in spec.exclusions if c not in spec.key]
    return build_gold(transform(raw, types, spec.vocabulary, units=units), drop, spec.ratios)


def known_units(raw: DataFrame, spec: Spec) -> dict[str, list[str]]:
    """The units written in the numeric columns of a table, an empty list where there is none.

    A column with more than ``MAX_UNITS`` of them holds free text and is not in the result.
    """
    columns = [c for c in spec.numeric_columns if c in raw.columns]
    if not columns:
        return {}
    written = materialized(detect_units(long_text(raw, columns)))
    counts = {r["colonne"]: r["count"] for r in written.groupBy("colonne").count().collect()}  # a row a column
    found: dict[str, list[str]] = {c: [] for c in columns if counts.get(c, 0) <= MAX_UNITS}
    if found:
        for row in written.where(F.col("colonne").isin(*found)).orderBy("colonne", "unite").collect():
            found[row["colonne"]].append(row["unite"])
    return found


def _free_text(raw: DataFrame, spec: Spec, units: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Numeric columns without known units, and why. Keys and targets cannot be left out: an error."""
    refused = {c: f"more than {MAX_UNITS} units" for c in spec.numeric_columns if c in raw.columns and c not in units}
    needed = [c for c in refused if c in (*spec.key, spec.target, spec.target_secondary)]
    if needed:
        raise ValueError(f"{needed[0]} holds free text: more than {MAX_UNITS} units")
    return refused


def _without(spec: Spec, refused: Mapping[str, str]) -> Spec:
    """The decisions without some columns and the ratios made of them."""
    if not refused:
        return spec
    ratios = {name: pair for name, pair in spec.ratios.items() if not set(pair) & set(refused)}
    return replace(spec, exclusions=(*spec.exclusions, *refused), ratios=ratios)


def _families(spec: Spec, gold: DataFrame) -> tuple[Family, Family, dict[str, str]]:
    """The two models, and the nominal columns that are too varied to be categories."""
    kept = set(spec.features(gold.columns))
    numeric, ordinal, nominal = spec.roles(gold.columns)
    categories, _ = resolve_categories(gold, {c: spec.nominal[c] for c in nominal if c in kept})
    roles = {
        "numeric": tuple(c for c in numeric if c in kept),
        "ordinal": {c: spec.ordinal[c] for c in ordinal if c in kept},
        "nominal": categories,
    }
    classifier = Family("logreg", logistic(spec.c), True, True, **roles, penalty=spec.c)
    varied = {
        c: f"more than {MAX_NEW_CATEGORIES} undeclared categories" for c in nominal if c in kept and c not in categories
    }
    return classifier, build_regressors(roles, spec.seed, spec.trees)["gradient_boosting"], varied


def retrain(raw: DataFrame, spec: Spec) -> TrainedRun:
    """Curate, split, fix the threshold out of fold, fit, and measure once on the sealed test.

    The curated table is written once: every fold reads it back instead of redoing the cleaning. A numeric column
    of free text and a nominal one of too many categories are left out of training and named in ``refused``.
    """
    units = known_units(raw, spec)
    refused = _free_text(raw, spec, units)
    spec = _without(spec, refused)
    gold = materialized(curate(raw, spec, units))
    marked = stratified_split(gold, spec.target, spec.key, spec.test_size, spec.seed)
    train = materialized(
        assign_folds(
            marked.where(~F.col("est_test")).drop("est_test"),
            spec.key,
            spec.n_splits,
            spec.seed,
            spec.target,
        )
    )
    test = marked.where("est_test").drop("est_test")
    by_class, by_value, varied = _families(spec, train.drop("fold"))
    oof = out_of_fold(train, by_class, spec.target, spec.n_splits)
    threshold = metrics.pick_threshold(
        oof, spec.target, "p", recall_target=spec.recall_target
    ).first()["seuil"]
    classifier = by_class.fit(train, spec.target)
    regressor = by_value.fit(train, spec.target_secondary)
    scored = regressor.predict(classifier.predict(test, "_p"), "_note").withColumn(
        "_note", clip(F.col("_note"), *MARK_RANGE)
    )
    measures = {
        **metrics.classification_metrics(scored, spec.target, "_p").first().asDict(),
        **metrics.point_metrics(scored, spec.target, "_p", threshold).first().asDict(),
        **metrics.regression_metrics(scored, spec.target_secondary, "_note").first().asDict(),
    }
    print_of = table_fingerprint(gold).first()
    return TrainedRun(
        classifier, regressor, float(threshold), measures, print_of["empreinte"], print_of["n_lignes"], units,
        train.drop("fold"), refused | varied,
    )


def predict(
    raw: DataFrame,
    spec: Spec,
    contract: Contract,
    run: TrainedRun,
    show_flag: bool = False,
    capacity: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, refused, summary) of a raw batch: each received row is judged once, none dropped.

    References keep the spelling they came with. The whole chain is one narrow plan per row, with the units of
    the training table. A ``capacity`` flags so many rows of the batch at most, in place of the run's threshold.
    """
    check_policy(None, capacity, show_flag)
    types = declared_types(raw.columns, spec.numeric_columns)
    types |= {c: "brut" for c in contract.references if c in types}
    units = {c: run.units.get(c, []) for c, kind in types.items() if kind == "decimal"}
    typed, _ = recode(conform(raw, types, units), spec.vocabulary)

    def score(valid: DataFrame) -> DataFrame:
        ready = build_gold(valid, [], spec.ratios)
        return run.regressor.predict(run.classifier.predict(ready, "_p"), "_note")

    if capacity is not None:
        return score_cohort(typed, contract, score, capacity)
    cut, origin = resolve_threshold(declared=run.threshold) if show_flag else (None, None)
    return score_cohort(typed, contract, score, threshold=cut, origin=origin)


def batch_drift(scored: DataFrame, run: TrainedRun) -> DataFrame:
    """Drift of the variables of a scored batch against the training table of the run."""
    if run.reference is None:
        raise ValueError("the run has no drift reference")
    prepared = run.classifier.preprocessor
    numeric = [c for c in prepared.numeric if c in scored.columns]
    nominal = [c for c in [*prepared.ordinal, *prepared.nominal] if c in scored.columns]
    return assess_drift(run.reference, scored, numeric, nominal)


# ---------------------------------------------------------------------------------------------
#  A run on disk: two Spark ML models, and tables for everything else.
# ---------------------------------------------------------------------------------------------


def _prepared_rows(name: str, prepared: Preprocessor) -> list[tuple]:
    rows = []
    for role, labels in (("numerique", {c: [] for c in prepared.numeric}), ("ordinal", prepared.ordinal), ("nominal", prepared.nominal)):
        for place, (column, known) in enumerate(labels.items()):
            numbers = [prepared.medians.get(column), prepared.means.get(column), prepared.deviations.get(column)]
            rows.append((name, prepared.scale, role, place, column, list(known), *(None if v is None else float(v) for v in numbers)))
    # The numbers that part bins are written as text, which keeps every digit.
    rows += [(name, prepared.scale, "bornes", place, str(place), [repr(float(e)) for e in edges], None, None, None) for place, edges in enumerate(prepared.edges)]
    return rows


_PREPARED = (
    "modele string, echelle boolean, role string, rang int, variable string, etiquettes array<string>, mediane double, "
    "moyenne double, ecart_type double"
)


def save_run(run: TrainedRun, path: str, version: str) -> str:
    """Writes a run under ``path`` in a folder of its own and returns that folder.

    Any earlier run stays. A run is complete when its last table, ``fiche``, is there.
    """
    spark = SparkSession.getActiveSession()
    root = f"{path.rstrip('/')}/run={version}-{run.fingerprint}-{uuid.uuid4().hex[:8]}"
    run.classifier.model.write().save(f"{root}/classifieur")
    run.regressor.model.write().save(f"{root}/regresseur")
    rows = _prepared_rows("classifieur", run.classifier.preprocessor) + _prepared_rows("regresseur", run.regressor.preprocessor)
    spark.createDataFrame(rows, _PREPARED).write.parquet(f"{root}/preparation")
    units = [(c, list(u)) for c, u in run.units.items()]
    spark.createDataFrame(units, "colonne string, unites array<string>").write.parquet(f"{root}/unites")
    if run.reference is not None:
        run.reference.write.parquet(f"{root}/reference")
    sheet = [(version, run.threshold, run.fingerprint, int(run.rows), run.reference is not None, {k: float(v) for k, v in run.holdout.items() if v is not None}, run.refused)]
    kinds = "version string, seuil double, empreinte string, lignes bigint, reference boolean, mesures map<string,double>, refus map<string,string>"
    spark.createDataFrame(sheet, kinds).write.parquet(f"{root}/fiche")
    return root


def load_run(spark: SparkSession, root: str) -> TrainedRun:
    """A run as it was saved."""
    sheet = spark.read.parquet(f"{root}/fiche").first()
    rows = spark.read.parquet(f"{root}/preparation").orderBy("modele", "role", "rang").collect()  # one per variable

    def prepared(name: str) -> Preprocessor:
        mine = [r for r in rows if r["modele"] == name]
        role = lambda kind: [r for r in mine if r["role"] == kind]
        number = lambda key: {r["variable"]: r[key] for r in mine if r[key] is not None}
        return Preprocessor(
            [r["variable"] for r in role("numerique")],
            {r["variable"]: list(r["etiquettes"]) for r in role("ordinal")},
            {r["variable"]: list(r["etiquettes"]) for r in role("nominal")},
            bool(mine and mine[0]["echelle"]),
            number("mediane"),
            number("moyenne"),
            number("ecart_type"),
            [[float(e) for e in r["etiquettes"]] for r in role("bornes")],
        )

    return TrainedRun(
        FittedModel(prepared("classifieur"), LogisticRegressionModel.load(f"{root}/classifieur"), True),
        FittedModel(prepared("regresseur"), GBTRegressionModel.load(f"{root}/regresseur"), False),
        sheet["seuil"],
        dict(sheet["mesures"]),
        sheet["empreinte"],
        sheet["lignes"],
        {r["colonne"]: list(r["unites"]) for r in spark.read.parquet(f"{root}/unites").collect()},
        spark.read.parquet(f"{root}/reference") if sheet["reference"] else None,
        dict(sheet.asDict().get("refus") or {}),
    )

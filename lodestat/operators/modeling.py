"""Preprocessing, model families, out-of-fold evaluation and search, on Spark ML."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators import trees
from lodestat.operators.frequencies import long_numbers, present
from lodestat.operators.isotonic import isotonic_blocks, isotonic_predict
from lodestat.operators.metrics import classification_metrics, regression_metrics
from lodestat.operators.prepare import table_fingerprint
from lodestat.operators.protocol import assign_folds
from lodestat.operators.ranks import quantiles
from lodestat.session import materialized

MISSING_CATEGORY = "inconnu"  # fixed value
MAX_NEW_CATEGORIES = 10_000
MAX_AT_ONCE = 300  # encoded columns of linear fits that are solved together, and of trees from cells
AT_ONCE = 8  # fits of a search that run side by side
FEATURES, LABEL, WEIGHT = "features", "label", "weight"


def resolve_categories(
    df: DataFrame, declared: Mapping[str, Sequence[str]], extend: bool = True
) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(categories per column, undeclared ones seen). Declared ones keep their position.

    One pass for all columns; only categories that nobody declared reach the driver. Each would be a feature of
    its own, so a column with more than ``MAX_NEW_CATEGORIES`` of them is no category: it is in neither result.
    """
    columns = list(declared)
    if not columns:
        return {}, {}
    known = reduce(
        lambda a, b: a | b,
        [(F.col("colonne") == c) & F.col("valeur").isin(*declared[c]) for c in columns],
    )
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    found = materialized(
        wide.unpivot([], columns, "colonne", "valeur").where(F.col("valeur").isNotNull() & ~known).distinct()
    )
    counts = {r["colonne"]: r["count"] for r in found.groupBy("colonne").count().collect()}  # a row a column
    columns = [c for c in columns if counts.get(c, 0) <= MAX_NEW_CATEGORIES]
    seen = found.where(F.col("colonne").isin(*columns)).collect() if columns else []
    extras: dict[str, list[str]] = {}
    for row in sorted(seen, key=lambda r: (r["colonne"], r["valeur"])):
        extras.setdefault(row["colonne"], []).append(row["valeur"])
    return {
        c: [*declared[c], *(extras.get(c, []) if extend else [])] for c in columns
    }, extras


@dataclass
class Preprocessor:
    """Median imputation, ordinal codes, scaling and one-hot as plain column expressions."""

    numeric: list[str]
    ordinal: dict[str, list[str]]
    nominal: dict[str, list[str]]
    scale: bool
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    #: Of a model on bins: the numbers that part the bins of each encoded column.
    edges: list[list[float]] = field(default_factory=list)

    def _raw(self, df: DataFrame, name: str) -> Column:
        if name in self.ordinal:
            code = F.lit(None).cast("double")
            for i, label in enumerate(self.ordinal[name]):
                code = F.when(F.col(name) == label, float(i)).otherwise(code)
            return code
        return present(df, name).cast("double")

    def _filled(self, df: DataFrame, name: str) -> Column:
        return F.coalesce(self._raw(df, name), F.lit(self.medians[name]))

    def fit(self, df: DataFrame) -> Preprocessor:
        """Medians, then means and population deviations of the filled columns: one number each."""
        names = [*self.numeric, *self.ordinal]
        if not names:
            return self
        coded = df.select(*[self._raw(df, c).alias(c) for c in names])
        middle = quantiles(long_numbers(coded, names), [0.5]).collect()
        self.medians = {c: 0.0 for c in names} | {r["colonne"]: r["quantiles"][0] for r in middle}
        if self.scale:
            row = df.agg(
                *[F.avg(self._filled(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
                *[F.stddev_pop(self._filled(df, c)).alias(f"s{i}") for i, c in enumerate(names)],
            ).first()
            self.means = {c: row[f"m{i}"] for i, c in enumerate(names)}
            self.deviations = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(names)}
        return self

    def outputs(self, df: DataFrame) -> list[tuple[str, Column]]:
        """(source variable, encoded column) in the order of the feature vector."""
        encoded = []
        for name in [*self.numeric, *self.ordinal]:
            z = self._filled(df, name)
            if self.scale:
                z = (z - self.means[name]) / self.deviations[name]
            encoded.append((name, z))
        for name, labels in self.nominal.items():
            cell = F.coalesce(F.col(name).cast("string"), F.lit(MISSING_CATEGORY))
            encoded += [(name, (cell == label).cast("double")) for label in labels]
        return encoded

    @property
    def sources(self) -> list[str]:
        return [
            *self.numeric,
            *self.ordinal,
            *[name for name, labels in self.nominal.items() for _ in labels],
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        columns = {f"_z{i}": z for i, (_, z) in enumerate(self.outputs(df))}
        if self.edges:
            columns = {c: trees.bin_number(z, e).cast("double") for (c, z), e in zip(columns.items(), self.edges)}
        wide = df.withColumns(columns)
        return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(wide).drop(
            *columns
        )


@dataclass
class FittedModel:
    """A preprocessor and its model; ``predict`` gives a column ``prediction_``."""

    preprocessor: Preprocessor
    model: object
    classifier: bool

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        if isinstance(self.model, trees.Forest):
            encoded = [z for _, z in self.preprocessor.outputs(df)]
            return df.select(*df.columns, self.model.score(df, encoded).alias(name))
        scored = self.model.transform(self.preprocessor.transform(df))
        if self.classifier:
            value = vector_to_array(F.col("probability"))[1]
        else:
            value = F.col("prediction")
        return scored.select(*df.columns, value.alias(name))

    def terms(self, df: DataFrame) -> tuple[dict[str, Column], float]:
        """Summed ``coefficient × encoded value`` per source variable, and the intercept."""
        terms: dict[str, Column] = {}
        for (name, z), coef in zip(self.preprocessor.outputs(df), self.model.coefficients):
            part = F.lit(float(coef)) * z
            terms[name] = terms[name] + part if name in terms else part
        return terms, float(self.model.intercept)

    def encoded(self, df: DataFrame) -> dict[str, list[tuple[float, Column]]]:
        result: dict[str, list[tuple[float, Column]]] = {}
        for (name, z), coef in zip(self.preprocessor.outputs(df), self.model.coefficients):
            result.setdefault(name, []).append((float(coef), z))
        return result


@dataclass(frozen=True)
class Family:
    """A family of models: how to prepare its input, and its estimator given the number of rows
    and the deviation of the label."""

    name: str
    estimator: Callable[[int, float], object]
    scale: bool
    classifier: bool
    numeric: tuple[str, ...]
    ordinal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    nominal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: Of a linear family: ``c`` of ``logistic`` or ``alpha`` of ``ridge``. Many such fits are solved at once.
    penalty: float | None = None

    def fit(self, df: DataFrame, target: str, weight: str | None = None) -> FittedModel:
        prep = Preprocessor(
            list(self.numeric),
            {c: list(v) for c, v in self.ordinal.items()},
            {c: list(v) for c, v in self.nominal.items()},
            self.scale,
        ).fit(df)
        if weight is None:
            found = self._from_cells(prep, df, target)
            if found:
                return found
        labelled = prep.transform(df).select(
            FEATURES,
            F.col(target).cast("double").alias(LABEL),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias(WEIGHT),
        ).where(F.col(LABEL).isNotNull() & F.col(WEIGHT).isNotNull())
        rows, deviation = labelled.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first()
        estimator = self.estimator(rows, deviation)
        if weight:
            estimator = estimator.setWeightCol(WEIGHT)
        return FittedModel(prep, estimator.fit(labelled), self.classifier)

    def _from_cells(self, prep: Preprocessor, df: DataFrame, target: str) -> FittedModel | None:
        """The model of a family of trees, from the cells of its rows; none where these do not serve."""
        estimator = self.estimator(1, 1.0)
        if not isinstance(estimator, trees.FORESTS + trees.BOOSTED) or not 0 < _width(self) <= MAX_AT_ONCE:
            return None
        learnt = df.where(F.col(target).cast("double").isNotNull())
        values = [z for _, z in prep.outputs(df)]
        edges = trees.bin_edges(learnt.select(*[z.alias(f"_z{i}") for i, z in enumerate(values)]), estimator.getMaxBins())
        if not trees.grows(estimator, edges):
            return None
        rows = learnt.select(trees.cell_code(values, edges).alias("code"), F.col(target).cast("double").alias("label"))
        if isinstance(estimator, trees.BOOSTED):
            model = trees.fit_boosted(rows, edges, estimator, (FEATURES, LABEL, WEIGHT))
            return FittedModel(replace(prep, edges=edges), model, self.classifier)
        forest = trees.fit_forest(rows, edges, estimator)
        return FittedModel(prep, forest, self.classifier) if forest else None

    def restricted(self, features: Sequence[str]) -> Family:
        """The same family on fewer variables."""
        kept = set(features)
        return Family(
            self.name,
            self.estimator,
            self.scale,
            self.classifier,
            tuple(c for c in self.numeric if c in kept),
            {c: v for c, v in self.ordinal.items() if c in kept},
            {c: v for c, v in self.nominal.items() if c in kept},
            self.penalty,
        )

    @property
    def roles(self) -> tuple:
        return self.numeric, dict(self.ordinal), dict(self.nominal), self.scale, self.classifier

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.ordinal, *self.nominal]


def logistic(c: float = 1.0) -> Callable[[int, float], object]:
    """L2 logistic regression of inverse strength ``c`` on the summed loss."""
    return lambda n, _: LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, tol=1e-8, maxIter=1000,
    )


def ridge(alpha: float = 1.0) -> Callable[[int, float], object]:
    """Ridge regression of strength ``alpha`` on the summed squares.

    Spark penalises in units of the label's deviation, hence the factor.
    """
    return lambda n, sd: LinearRegression(
        featuresCol=FEATURES, labelCol=LABEL, regParam=alpha * sd / n, elasticNetParam=0.0,
        standardization=False, solver="normal",
    )


def forest(
    trees: int = 100, depth: int = 5, leaf: int = 1, subset: str = "auto", seed: int = 0
) -> Callable[[int, float], object]:
    """Random forest of ``trees`` trees: their depth, least rows of a leaf and features tried at a split."""
    return lambda n, sd: RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
        featureSubsetStrategy=subset, seed=seed, maxMemoryInMB=1024,
    )


def build_classifiers(roles: Mapping, seed: int = 0, trees: int = 100) -> dict[str, Family]:
    """The three classification families; only the linear one is scaled."""
    boosted = lambda n, sd: GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=trees, maxDepth=6, stepSize=0.3, seed=seed
    )
    return {
        "logreg": Family("logreg", logistic(), True, True, **roles, penalty=1.0),
        "random_forest": Family("random_forest", forest(trees, seed=seed), False, True, **roles),
        "boosting": Family("boosting", boosted, False, True, **roles),
    }


def build_regressors(roles: Mapping, seed: int = 0, trees: int = 100) -> dict[str, Family]:
    """The three regression families."""
    forest = lambda n, sd: RandomForestRegressor(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, seed=seed
    )
    boosted = lambda n, sd: GBTRegressor(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed
    )
    return {
        "ridge": Family("ridge", ridge(), True, False, **roles, penalty=1.0),
        "random_forest": Family("random_forest", forest, False, False, **roles),
        "gradient_boosting": Family("gradient_boosting", boosted, False, False, **roles),
    }


def out_of_fold(
    df: DataFrame, family: Family, target: str, n_splits: int = 5, weight: str | None = None
) -> DataFrame:
    """Each row with ``p`` from a model that never saw it; ``df`` carries ``fold``.

    Preprocessing is fitted again inside each fold. The scores are written once: metrics read
    them in several branches, and none should score again. A linear family is fitted in one go.
    """
    if family.penalty is not None and weight is None and _width(family) <= MAX_AT_ONCE:
        from lodestat.operators import linear

        carried = [c for c in df.columns if c != target]
        scored = linear.out_of_fold_many(df, family, target, linear.by_fold("oof", n_splits, c=family.penalty), carried)
        return scored.select(*df.columns, "p")
    parts = []
    for k in range(n_splits):
        fitted = family.fit(df.where(F.col("fold") != k), target, weight)
        parts.append(fitted.predict(df.where(F.col("fold") == k)))
    return materialized(reduce(DataFrame.unionByName, parts))


def _width(family: Family) -> int:
    """Encoded columns of a family."""
    return len(family.numeric) + len(family.ordinal) + sum(len(labels) for labels in family.nominal.values())


def _out_of_fold(df: DataFrame, family: Family, target: str, n_splits: int) -> DataFrame:
    """``out_of_fold``, with the mean of the label for a family without features."""
    if family.features:
        return out_of_fold(df, family, target, n_splits)
    sums = df.groupBy("fold").agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(target).alias("n")).collect()
    n, total = sum(r["n"] for r in sums), sum(r["s"] or 0.0 for r in sums)
    means = [
        v for r in sums if r["fold"] is not None
        for v in (F.lit(r["fold"]), F.lit((total - (r["s"] or 0.0)) / (n - r["n"]) if n > r["n"] else None).cast("double"))
    ]
    return df.where(F.col("fold").isNotNull()).withColumn("p", F.create_map(*means)[F.col("fold")] if means else F.lit(None).cast("double"))


def _metrics(family: Family):
    return classification_metrics if family.classifier else regression_metrics


def fold_scores(scored: DataFrame, target: str, classifier: bool = True) -> DataFrame:
    """(fold, metrics) of an out-of-fold table, to read the dispersion."""
    measure = classification_metrics if classifier else regression_metrics
    return measure(scored, target, "p", ["fold"])


def fold_dispersion(scores: DataFrame, metric: str) -> DataFrame:
    return scores.agg(F.avg(metric).alias("moyenne"), F.stddev_pop(metric).alias("ecart_type"))


def train_vs_oof(df: DataFrame, family: Family, target: str, n_splits: int = 5) -> DataFrame:
    """One row: AUC on the training rows against out-of-fold AUC. A linear family is fitted in one go."""
    if family.penalty is not None:
        from lodestat.operators import linear

        fits = [linear.Fit("train", (), family.penalty), *linear.by_fold("oof", n_splits, c=family.penalty)]
        both = linear.out_of_fold_many(df, family, target, fits).withColumnRenamed("nom", "_jeu")
    else:
        inside = family.fit(df, target).predict(df)
        outside = out_of_fold(df, family, target, n_splits)
        both = inside.withColumn("_jeu", F.lit("train")).unionByName(
            outside.withColumn("_jeu", F.lit("oof"))
        )
    scores = classification_metrics(both, target, "p", ["_jeu"])
    return scores.agg(
        F.max(F.when(F.col("_jeu") == "train", F.col("roc_auc"))).alias("train_roc_auc"),
        F.max(F.when(F.col("_jeu") == "oof", F.col("roc_auc"))).alias("oof_roc_auc"),
    )


def ablation_scenarios(
    features: Sequence[str], blocks: Mapping[str, Sequence[str]]
) -> dict[str, list[str]]:
    """Kept variables per scenario: all, all but each block, all but every block."""
    every = {c for block in blocks.values() for c in block}
    scenarios = {"complet": list(features)}
    for name, block in blocks.items():
        scenarios[f"sans {name}"] = [f for f in features if f not in set(block)]
    scenarios["minimisé"] = [f for f in features if f not in every]
    return scenarios


def ablate(
    df: DataFrame,
    family: Family,
    target: str,
    blocks: Mapping[str, Sequence[str]],
    n_splits: int = 5,
    postprocess: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(scenario, n_features, metrics, deltas to the full set), measured out of fold.

    A scenario without features predicts the mean of the label over the rows learnt from. All scenarios of a linear
    family are fitted in one go.
    """
    scenarios = ablation_scenarios(family.features, blocks)
    if family.penalty is not None:
        from lodestat.operators import linear

        fits = [
            f for name, kept in scenarios.items()
            for f in linear.by_fold(name, n_splits, c=family.penalty, features=tuple(kept))
        ]
        scored = linear.out_of_fold_many(df, family, target, fits)
        sizes = F.create_map(*[F.lit(v) for name, kept in scenarios.items() for v in (name, len(kept))])
        parts = [scored.select(F.col("nom").alias("scenario"), sizes[F.col("nom")].alias("n_features"), target, "p")]
    else:
        parts = []
        for name, kept in scenarios.items():
            scored = _out_of_fold(df, family.restricted(kept), target, n_splits)
            parts.append(
                scored.select(F.lit(name).alias("scenario"), F.lit(len(kept)).alias("n_features"), target, "p")
            )
    if postprocess:
        parts = [part.withColumn("p", postprocess(F.col("p"))) for part in parts]
    scores = _metrics(family)(
        reduce(DataFrame.unionByName, parts), target, "p", ["scenario", "n_features"]
    )
    metrics = [c for c in scores.columns if c not in ("scenario", "n_features")]
    full = scores.where(F.col("scenario") == "complet").select(
        *[F.col(m).alias(f"_{m}") for m in metrics], F.lit("complet").alias("_ref")
    )
    joined = scores.withColumn("_ref", F.lit("complet")).join(F.broadcast(full), "_ref")
    return joined.select(
        "scenario",
        "n_features",
        *metrics,
        *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in metrics],
    )


def search(
    df: DataFrame,
    build: Callable[[dict], Family],
    candidates: Sequence[dict],
    target: str,
    metric: str = "roc_auc",
    n_splits: int = 5,
) -> DataFrame:
    """(essai, parametres, score): mean of the metric over folds, best first.

    Linear families of the same features are fitted all at once. Others are fitted ``AT_ONCE`` at a time, on rows
    that each fold prepares and writes once.
    """
    families = [build(params) for params in candidates]
    if not families:
        raise ValueError("a search needs candidates")
    texts = [_parameters(params) for params in candidates]
    first = families[0]
    if all(f.penalty is not None and f.roles == first.roles for f in families):
        from lodestat.operators import linear

        fits = [fit for i, f in enumerate(families) for fit in linear.by_fold(str(i), n_splits, c=f.penalty)]
        scored = linear.out_of_fold_many(df, first, target, fits, ["fold"]).withColumn("essai", F.col("nom").cast("int"))
    elif all(f.roles == first.roles for f in families):
        scored = _searched(df, families, target, n_splits)
    else:
        parts = [out_of_fold(df, f, target, n_splits).select(F.lit(i).alias("essai"), "fold", target, "p") for i, f in enumerate(families)]
        scored = reduce(DataFrame.unionByName, parts)
    per_fold = _metrics(first)(scored, target, "p", ["essai", "fold"])
    best_first = F.desc("score") if first.classifier else F.asc("score")
    named = F.array(*map(F.lit, texts))
    return (
        per_fold.groupBy("essai").agg(F.avg(metric).alias("score"))
        .select("essai", named[F.col("essai")].alias("parametres"), "score")
        .orderBy(best_first, "essai")
    )


def _parameters(params: Mapping) -> str:
    return ", ".join(f"{k}={v}" for k, v in params.items())


def _searched(df: DataFrame, families: Sequence[Family], target: str, n_splits: int) -> DataFrame:
    """(essai, fold, target, p) of families that differ in their estimators only."""
    estimators = [family.estimator(1, 1.0) for family in families]
    if all(isinstance(e, RandomForestClassifier) for e in estimators):
        found = _searched_forests(df, families[0], estimators, target, n_splits)
        if found is not None:
            return found
    parts = []
    for k in range(n_splits):
        first = families[0]
        inside = df.where(F.col("fold") != k)
        prep = Preprocessor(
            list(first.numeric), {c: list(v) for c, v in first.ordinal.items()}, {c: list(v) for c, v in first.nominal.items()}, first.scale
        ).fit(inside)
        learnt, held = (
            materialized(prep.transform(part).select(FEATURES, F.col(target).cast("double").alias(LABEL), "fold", target))
            for part in (inside, df.where(F.col("fold") == k))
        )
        learnt = learnt.where(F.col(LABEL).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
        rows, deviation = learnt.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first()

        def one(job, learnt=learnt, held=held, rows=rows, deviation=deviation):
            i, family = job
            model = family.estimator(rows, deviation).fit(learnt)
            value = vector_to_array(F.col("probability"))[1] if family.classifier else F.col("prediction")
            return materialized(model.transform(held).select(F.lit(i).alias("essai"), "fold", target, value.alias("p")))

        with ThreadPool(AT_ONCE) as pool:
            parts += pool.map(inheritable_thread_target(df.sparkSession)(one), list(enumerate(families)))
        learnt.unpersist()
    return reduce(DataFrame.unionByName, parts)


def _searched_forests(df: DataFrame, family: Family, estimators: Sequence, target: str, n_splits: int) -> DataFrame | None:
    """``_searched`` for forests on labels 0 and 1, all folds at once; none where cells do not serve.

    Each fold's rows are summed up in cells once, whatever the number of forests. Lots of trees are grown in tasks of
    their own and score the cells of the held-out rows.
    """

    def prepared(k):
        """The held-out rows of a fold with their cells, and what its tasks need."""
        inside = df.where((F.col("fold") != k) & F.col(target).cast("double").isNotNull())
        prep = Preprocessor(
            list(family.numeric), {c: list(v) for c, v in family.ordinal.items()}, {c: list(v) for c, v in family.nominal.items()}, family.scale
        ).fit(df.where(F.col("fold") != k))
        values = [z for _, z in prep.outputs(df)]
        edges = trees.bin_edges(inside.select(*[z.alias(f"_z{i}") for i, z in enumerate(values)]), estimators[0].getMaxBins())
        if not all(trees.grows(e, edges) for e in estimators):
            return None
        code = trees.cell_code(values, edges).alias("code")
        cells = trees.binary_cells(inside.select(code, F.col(target).cast("double").alias("label")))
        held = materialized(df.where(F.col("fold") == k).select("fold", code, target))
        asked = held.select("code").distinct()
        if cells is None or asked.count() > trees.MAX_CELLS:
            return None
        return held, edges, cells, asked.orderBy("code").toPandas()["code"].to_numpy("int64")

    spark = df.sparkSession
    if not 0 < _width(family) <= MAX_AT_ONCE or len({e.getMaxBins() for e in estimators}) > 1:
        return None
    with ThreadPool(AT_ONCE) as pool:
        folds = pool.map(inheritable_thread_target(spark)(prepared), range(n_splits))
    if any(fold is None for fold in folds):
        return None
    shapes = [trees.shape(e, len(folds[0][1])) for e in estimators]
    scores = trees.forest_scores(spark, [fold[1:] for fold in folds], shapes)
    held = reduce(DataFrame.unionByName, [fold[0] for fold in folds])
    return materialized(held.join(F.broadcast(scores), ["fold", "code"]).select("essai", "fold", target, "p"))


def refit(df: DataFrame, build: Callable[[dict], Family], candidates: Sequence[dict], found: DataFrame, target: str) -> FittedModel:
    """The best candidate of a search, fitted to all rows."""
    best = found.first()  # best first
    return build(candidates[best["essai"]]).fit(df, target)


def cached_search(
    folder: str, name: str, df: DataFrame, compute: Callable[[], DataFrame], use_cache: bool = True
) -> DataFrame:
    """The result of ``compute`` for these rows, kept as a table under ``folder``.

    The table is found again by ``name`` and by the fingerprint of the rows, whatever their order, so other rows or
    another name never get it. With ``use_cache`` a table that is there is read and nothing is computed; otherwise
    it is computed and written anew. A table counts only once it is whole: one that a lost job left half written is
    computed again.
    """
    spark = df.sparkSession
    row = table_fingerprint(df).first()
    text = "\x1f".join([name, *df.columns, *map(str, row)])
    path = f"{folder.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if use_cache and done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path)
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def random_candidates(
    space: Mapping[str, Callable[[random.Random], object]], n_trials: int, seed: int = 0
) -> list[dict]:
    """Seeded draws from a space of one sampler per parameter."""
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(n_trials)]


def with_class_weight(df: DataFrame, target: str, name: str = "poids") -> DataFrame:
    """Balanced weights n / (2 · n_class) over the labelled rows; a row without label has no weight.

    The class counts are one small row per class; adaptive execution picks the join by their size.
    """
    counts = df.groupBy(F.col(target).alias("_classe")).agg(F.count(target).alias("_k"))
    total = df.agg(F.count(target)).scalar()
    weights = counts.where(F.col("_k") > 0).select("_classe", (total / (2.0 * F.col("_k"))).alias(name))
    return df.join(weights, F.col(target) == F.col("_classe"), "left").drop("_classe")


def compare_weighting(df: DataFrame, family: Family, target: str, n_splits: int = 5) -> DataFrame:
    """(ponderation, metrics): out-of-fold metrics without and with balanced weights."""
    weighted = with_class_weight(df, target)
    if family.penalty is not None and family.classifier:
        from lodestat.operators import linear

        fits = [
            f for name, use in (("aucune", False), ("equilibree", True))
            for f in linear.by_fold(name, n_splits, c=family.penalty, weighted=use)
        ]
        both = linear.out_of_fold_many(weighted, family, target, fits, weight="poids")
        return classification_metrics(both.withColumnRenamed("nom", "ponderation"), target, "p", ["ponderation"])
    plain = out_of_fold(df, family, target, n_splits).select(
        F.lit("aucune").alias("ponderation"), target, "p"
    )
    balanced = out_of_fold(weighted, family, target, n_splits, "poids").select(
        F.lit("equilibree").alias("ponderation"), target, "p"
    )
    return classification_metrics(plain.unionByName(balanced), target, "p", ["ponderation"])


def isotonic_recalibration(
    df: DataFrame,
    family: Family,
    target: str,
    n_splits: int = 5,
    inner_splits: int = 5,
    key: Sequence[str] = ("doc_id",),
    seed: int = 0,
) -> DataFrame:
    """(version, brier) before and after isotonic calibration learnt in inner folds.

    For each outer fold the other rows are dealt into ``inner_splits`` folds of their own. A model of all but one
    inner fold is calibrated on that one, and the mean of the calibrated models scores the outer fold. ``df``
    carries ``fold``; ``key`` identifies its rows. The models of a linear family are fitted in one go.
    """
    rows = df
    for k in range(n_splits):
        inside = assign_folds(df.where(F.col("fold") != k).drop("fold"), key, inner_splits, seed + 1 + k, target)
        inner = inside.select(*key, F.col("fold").alias(f"_pli{k}"))
        rows = rows.join(inner, list(key), "left")
    rows = materialized(rows)
    scored = (_inner_linear if family.penalty is not None else _inner_fits)(rows, family, target, n_splits, inner_splits, list(key))
    names = ["_externe", "_interne"]
    blocks = isotonic_blocks(scored.where("_calibre"), "p", target, names)
    outside = isotonic_predict(scored.where("NOT _calibre AND _interne >= 0"), "p", blocks, names)
    raw = scored.where("_interne < 0").select(*key, target, F.lit("brute").alias("version"), F.col("p").alias("q"))
    calibrated = outside.groupBy(*key, target).agg(F.avg("prediction").alias("q"))
    long = raw.unionByName(calibrated.withColumn("version", F.lit("isotonique")))
    error = F.col("q") - F.col(target)
    return long.groupBy("version").agg(F.avg(error * error).alias("brier"))


def _inner_linear(rows, family: Family, target: str, n_splits: int, inner_splits: int, key: list[str]) -> DataFrame:
    """key, target, p, the outer and inner fold (-1: the model of all inner folds) and whether the row calibrates."""
    from lodestat.operators import linear

    fits = linear.by_fold("-1", n_splits, c=family.penalty)
    for k in range(n_splits):
        fits += [
            linear.Fit(str(j), (("fold", k), (f"_pli{k}", j)), family.penalty, on=(("fold", k),)) for j in range(inner_splits)
        ]
    encoded = linear.encode(rows, family, target, ["fold", *[f"_pli{k}" for k in range(n_splits)]], [*key, target])
    solved = (linear.logistic_fits if family.classifier else linear.ridge_fits)(encoded, fits)
    asked = []
    for fit, solution in zip(fits, solved):
        k = fit.held[0][1]
        asked.append((replace(fit, name=f"{k} {fit.name} 0"), solution))
        if len(fit.held) > 1:
            asked.append((replace(fit, name=f"{k} {fit.name} 1", on=fit.held[1:]), solution))
    scored = linear.scores(encoded, *zip(*asked), family.classifier)
    part = F.split("nom", " ")
    return materialized(
        scored.select(
            *key, target, "p", part[0].cast("int").alias("_externe"), part[1].cast("int").alias("_interne"), (part[2] == "1").alias("_calibre")
        )
    )


def _inner_fits(rows, family: Family, target: str, n_splits: int, inner_splits: int, key: list[str]) -> DataFrame:
    """``_inner_linear`` for any family, one fit after another."""
    parts = []

    def keep(scored: DataFrame, k: int, j: int, calibrates: bool) -> None:
        place = [F.lit(k).alias("_externe"), F.lit(j).alias("_interne"), F.lit(calibrates).alias("_calibre")]
        parts.append(scored.select(*key, target, "p", *place))

    for k in range(n_splits):
        inside, outside, inner = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), F.col(f"_pli{k}")
        keep(family.fit(inside, target).predict(outside), k, -1, False)
        for j in range(inner_splits):
            fitted = family.fit(inside.where(inner != j), target)
            keep(fitted.predict(outside), k, j, False)
            keep(fitted.predict(inside.where(inner == j)), k, j, True)
    return materialized(reduce(DataFrame.unionByName, parts))


def metrics_panel(
    configurations: DataFrame, retained: Sequence[str], tolerance: float = 1e-3
) -> DataFrame:
    """One row per configuration: recomputed metric, stored one, their agreement and status.

    ``configurations`` holds (configuration, cout, mesure, stockee); lower is better.
    """
    best = configurations.agg(F.min("mesure")).scalar()
    return configurations.withColumns(
        {
            "statut": F.when(F.col("configuration").isin(*retained), "retenue")
            .when(F.col("mesure") == best, "meilleure")
            .otherwise("écartée"),
            "conforme": F.abs(F.col("mesure") - F.col("stockee")) <= tolerance,
        }
    )


def frugal_choice(configurations: DataFrame, epsilon: float = 0.03) -> DataFrame:
    """The cheapest configuration within ``epsilon`` of the best measure."""
    best = configurations.agg(F.min("mesure")).scalar()
    near = configurations.where(F.col("mesure") <= best + epsilon)
    return near.agg(
        F.min_by("configuration", F.struct("cout", "mesure")).alias("configuration")
    )


def score_panel(
    scores: DataFrame,
    target: str,
    stored: DataFrame,
    metric: str,
    retained: Sequence[str] = (),
    classifier: bool = True,
    tolerance: float = 1e-3,
    configuration: str = "configuration",
    fold: str = "fold",
) -> DataFrame:
    """One row per configuration, from its written out-of-fold scores ``p``: every metric as the mean and deviation
    over folds and over all rows together, ``metric`` against the value kept in ``stored`` (configuration, stockee),
    and the status of the configuration.

    Each row counts in its fold and in the whole, so one pass over the distinct scores gives both. A row without
    score or label is left out; a configuration without kept value has NULL in ``stockee`` and ``conforme``.
    """
    rows = scores.where(F.col(target).isNotNull() & F.col("p").isNotNull())
    both = rows.select(
        F.col(configuration).alias("configuration"),
        F.explode(F.array(F.coalesce(F.col(fold).cast("int"), F.lit(-1)), F.lit(None).cast("int"))).alias("_pli"),
        F.col(target).alias("_y"),
        "p",
    ).withColumn("_ensemble", F.col("_pli").isNull())
    measure = classification_metrics if classifier else regression_metrics
    found = measure(both.withColumn("_pli", F.coalesce("_pli", F.lit(-2))), "_y", "p", ["configuration", "_pli", "_ensemble"])
    names = [c for c in found.columns if c not in ("configuration", "_pli", "_ensemble")]
    inside = lambda m: F.when(~F.col("_ensemble"), F.col(m))
    panel = found.groupBy("configuration").agg(
        F.count_if(~F.col("_ensemble")).alias("n_plis"),
        *[F.avg(inside(m)).alias(f"moyenne_{m}") for m in names],
        *[F.stddev_pop(inside(m)).alias(f"ecart_{m}") for m in names],
        *[F.max(F.when(F.col("_ensemble"), F.col(m))).alias(m) for m in names],
    )
    kept = stored.select("configuration", F.col("stockee").cast("double").alias("stockee"))
    joined = materialized(panel.join(kept, "configuration", "left"))
    higher = classifier and metric != "brier" or metric == "r2"
    best = joined.agg((F.max if higher else F.min)(metric)).scalar()
    return joined.withColumns(
        {
            "conforme": F.abs(F.col(metric) - F.col("stockee")) <= tolerance,
            "statut": F.when(F.col("configuration").isin(*retained), "retenue")
            .when(F.col(metric) == best, "meilleure")
            .otherwise("écartée"),
        }
    )

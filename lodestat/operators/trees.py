"""Forests and boosted trees from cells: what a tree learns from rows is only how many, and with which labels, fall
in each combination of bins of the features.

Spark ML cuts a feature into at most ``maxBins`` bins and looks at the rows again for each level of each tree. Here
the rows are read a few times whatever the number of trees: once or thrice to find the bins, once to sum them up in
cells. Then

* boosted trees are fitted by Spark ML to the cells, each with its rows as weight: rows of a cell always get the same
  prediction, so the sums that decide a split are those of the rows;
* a tree of a forest counts every row a Poisson(1) number of times. Rows of one cell and label are alike, so their
  counts together are one Poisson(n) number; for a numeric label one pass over the rows draws the counts of all
  trees. Trees are grown in tasks of their own, from the cells alone, by the rules of Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.ranks import quantiles
from lodestat.session import materialized, ship_by_value

ship_by_value(__name__)

MAX_CELLS = 20_000  # of a forest; each task that grows trees holds them
MAX_DRAWN = 4_000_000  # cells x trees that one task sums up before it hands them on
ROWS_AT_ONCE = 100_000
LOT = 25  # trees of a task
FORESTS, BOOSTED = (RandomForestClassifier, RandomForestRegressor), (GBTClassifier, GBTRegressor)


def bin_edges(rows: DataFrame, bins: int) -> list[list[float]]:
    """Per column, the rising numbers that part its bins; a value equal to one lies below it.

    Up to ``bins`` distinct values have a bin each, parted in the middle; more are parted at quantiles.
    """
    names = rows.columns

    def work(batches):
        known: list = [np.zeros(0) for _ in names]
        for batch in batches:
            for j, values in enumerate(known):
                if values is not None:
                    merged = np.union1d(values, batch.column(j).to_numpy(zero_copy_only=False))
                    known[j] = merged if len(merged) <= bins else None
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(names)), type=pa.int32()),
                pa.array([v is None for v in known], type=pa.bool_()),
                pa.array([[] if v is None else v for v in known], type=pa.list_(pa.float64())),
            ],
            names=["j", "many", "values"],
        )

    found = rows.mapInArrow(work, "j int, many boolean, values array<double>")
    merged = found.groupBy("j").agg(F.max("many").alias("many"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))
    edges: dict[int, list[float]] = {}
    for row in merged.collect():
        values = sorted(row["values"])
        if not row["many"] and len(values) <= bins:
            edges[row["j"]] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    wide = [c for j, c in enumerate(names) if j not in edges]
    if wide:
        long = rows.select(*wide).unpivot([], wide, "colonne", "valeur")
        for row in quantiles(long, [k / bins for k in range(1, bins)]).collect():
            edges[names.index(row["colonne"])] = sorted(set(row["quantiles"]))
    return [edges.get(j, []) for j in range(len(names))]


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges below a value."""
    return sum([(value > F.lit(float(e))).cast("long") for e in edges], F.lit(0).cast("long"))


def _steps(edges: Sequence[Sequence[float]]) -> list[int]:
    steps = [1]
    for e in edges:
        steps.append(steps[-1] * (len(e) + 1))
    return steps


def cell_code(values: Sequence[Column], edges: Sequence[Sequence[float]]) -> Column:
    """The cell of a row: its bins as digits of one number."""
    parts = [bin_number(v, e) * F.lit(s) for v, e, s in zip(values, edges, _steps(edges)) if e]
    return sum(parts, F.lit(0).cast("long"))


def bins_of(codes: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """The bins of cells, one line per cell."""
    return np.column_stack([(codes // s) % (len(e) + 1) for e, s in zip(edges, _steps(edges))]).astype("int64")


def _tried(subset: str, features: int, trees: int, classifier: bool) -> int:
    """How many features a split tries, as Spark ML reads ``featureSubsetStrategy``."""
    if subset == "auto":
        subset = "all" if trees == 1 else "sqrt" if classifier else "onethird"
    if subset == "all":
        return features
    if subset == "sqrt":
        return math.ceil(math.sqrt(features))
    if subset == "log2":
        return max(1, math.ceil(math.log2(features)))
    if subset == "onethird":
        return math.ceil(features / 3)
    share = float(subset)
    return min(features, int(share)) if share > 1 else math.ceil(share * features)


@dataclass(frozen=True)
class Shape:
    """What a forest asks of its trees."""

    trees: int
    depth: int
    leaf: int
    tried: int
    seed: int
    bootstrap: bool


def shape(estimator, features: int) -> Shape:
    trees = estimator.getNumTrees()
    tried = _tried(estimator.getFeatureSubsetStrategy(), features, trees, isinstance(estimator, RandomForestClassifier))
    return Shape(trees, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), tried, estimator.getSeed(), estimator.getBootstrap())


def grows(estimator, edges: Sequence[Sequence[float]]) -> bool:
    """Whether the cells of these bins have numbers, and the estimator no setting that only Spark ML knows."""
    if math.prod(len(e) + 1 for e in edges) >= 2**62 or not isinstance(estimator, FORESTS + BOOSTED):
        return False
    return estimator.getSubsamplingRate() == 1.0 and not estimator.getMinInfoGain() and not estimator.getMinWeightFractionPerNode()


def grow(bins: np.ndarray, widths: np.ndarray, n: np.ndarray, s: np.ndarray, ask: Shape, rng: np.random.Generator) -> np.ndarray:
    """A tree of cells with ``n`` rows of label sum ``s``, as lines (feature or -1, last bin to the left, left child, value).

    The right child follows the left one. A split takes the largest fall of the variance, which for labels of 0 and 1
    is half the Gini impurity.
    """
    kept = n > 0
    bins, n, s = bins[kept], n[kept], s[kept]
    features = bins.shape[1]
    offsets = np.concatenate([[0], np.cumsum(widths)])
    flat, size = bins + offsets[:-1], int(offsets[-1])
    feature_of = np.repeat(np.arange(features), widths)
    tree = [[-1, 0, 0, s.sum() / n.sum() if len(n) else 0.0]]
    nodes, local = np.array([0]), np.zeros(len(n), dtype="int64")  # nodes of this level; the place of each cell's node
    for _ in range(ask.depth):
        if not len(n):
            break
        k = len(nodes)
        place = (local[:, None] * size + flat).ravel()
        rows = np.bincount(place, weights=np.repeat(n, features), minlength=k * size).reshape(k, size)
        sums = np.bincount(place, weights=np.repeat(s, features), minlength=k * size).reshape(k, size)
        all_n, all_s = np.bincount(local, weights=n, minlength=k)[:, None], np.bincount(local, weights=s, minlength=k)[:, None]
        for a, b in zip(offsets, offsets[1:]):
            rows[:, a:b], sums[:, a:b] = rows[:, a:b].cumsum(axis=1), sums[:, a:b].cumsum(axis=1)
        rest, rest_s = all_n - rows, all_s - sums
        whole = all_s * all_s / all_n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums * sums / rows + rest_s * rest_s / rest - whole
        good = (rows >= max(ask.leaf, 1)) & (rest >= max(ask.leaf, 1))
        if ask.tried < features:
            drawn = rng.random((k, features)).argsort(axis=1).argsort(axis=1) < ask.tried
            good &= drawn[:, feature_of]
        gain = np.where(good, gain, -np.inf)
        best = gain.argmax(axis=1)
        split = gain[np.arange(k), best] > 1e-13 * np.abs(whole[:, 0])
        feature, cut = feature_of[best], best - offsets[feature_of[best]]
        left = np.full(k, -1)
        for i in np.flatnonzero(split):
            parent, b = tree[nodes[i]], best[i]
            parent[0], parent[1], parent[2] = int(feature[i]), int(cut[i]), len(tree)
            left[i] = len(tree)
            tree.append([-1, 0, 0, sums[i, b] / rows[i, b]])
            tree.append([-1, 0, 0, rest_s[i, b] / rest[i, b]])
        on = split[local]
        bins, n, s, flat, local = bins[on], n[on], s[on], flat[on], local[on]
        child = left[local] + (bins[np.arange(len(bins)), feature[local]] > cut[local])
        nodes, local = np.unique(child, return_inverse=True)
    return np.array(tree, dtype="float64")


def tree_values(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """What a tree predicts for cells."""
    at, lines = np.zeros(len(bins), dtype="int64"), np.arange(len(bins))
    feature, cut, left = (tree[:, i].astype("int64") for i in range(3))
    while len(moving := np.flatnonzero(feature[at] >= 0)):
        node = at[moving]
        at[moving] = left[node] + (bins[lines[moving], feature[node]] > cut[node])
    return tree[at, 3]


def binary_cells(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(codes, rows of label 0, rows of label 1) of rows (code, label); none if there are other labels or too many cells."""
    label = F.col("label")
    cells = materialized(
        rows.groupBy("code").agg(F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"), F.count("label").alias("n"))
    )
    size, others = cells.agg(F.count(F.lit(1)), F.count_if(F.col("n") != F.col("n0") + F.col("n1"))).first()
    if others or not 0 < size <= MAX_CELLS:
        return None
    found = cells.orderBy("code").toPandas()
    return tuple(found[c].to_numpy("int64") for c in ("code", "n0", "n1"))


def binary_tree(bins, widths, n0, n1, ask: Shape, number: int) -> np.ndarray:
    """Tree ``number`` of a forest on labels 0 and 1: each row counts a Poisson(1) number of times, or once."""
    rng = np.random.default_rng([ask.seed & (2**63 - 1), number])
    zeros, ones = (rng.poisson(n0), rng.poisson(n1)) if ask.bootstrap else (n0, n1)
    return grow(bins, widths, (zeros + ones).astype("float64"), ones.astype("float64"), ask, rng)


def forest_scores(spark, folds: Sequence[tuple], shapes: Sequence[Shape]) -> DataFrame:
    """(essai, fold, code, p): what forests learnt from the cells of each fold predict for the cells asked for.

    A fold is (edges, (codes, rows of label 0, of label 1), codes asked for).
    """
    ready = []
    for edges, (codes, n0, n1), asked in folds:
        widths = np.array([len(e) + 1 for e in edges])
        ready.append((widths, bins_of(codes, edges), n0, n1, asked, bins_of(asked, edges)))
    jobs = [
        (k, i, begin, min(begin + LOT, ask.trees)) for i, ask in enumerate(shapes) for begin in range(0, ask.trees, LOT) for k in range(len(ready))
    ]
    shared, asks = spark.sparkContext.broadcast(ready), list(shapes)

    def work(batches):
        for batch in batches:
            for job in batch.column(0).to_pylist():
                k, i, begin, end = jobs[job]
                widths, bins, n0, n1, asked, asked_bins = shared.value[k]
                total = sum(tree_values(binary_tree(bins, widths, n0, n1, asks[i], t), asked_bins) for t in range(begin, end))
                rows = len(asked)
                place = [pa.array(np.full(rows, v), type=pa.int32()) for v in (i, k, begin)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(asked), pa.array(total)], names=["essai", "fold", "lot", "code", "total"])

    grown = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(work, "essai int, fold int, lot int, code long, total double")
    trees = F.array(*[F.lit(float(ask.trees)) for ask in shapes])[F.col("essai")]
    # Lots are added in their order, so that equal cells get equal numbers each time.
    lots = F.array_sort(F.collect_list(F.struct("lot", "total")))
    added = F.aggregate(lots, F.lit(0.0), lambda a, x: a + x["total"])
    return materialized(grown.groupBy("essai", "fold", "code").agg(added.alias("p")).withColumn("p", F.col("p") / trees))


def _numeric_cells(rows: DataFrame, edges, ask: Shape, centre: float, cells: int) -> DataFrame:
    """(tree, code, n, s): rows and sum of centred labels of each cell, as each tree counts them."""
    lot = max(1, min(ask.trees, MAX_DRAWN // max(cells, 1)))
    seed, trees, bootstrap = ask.seed & (2**63 - 1), ask.trees, ask.bootstrap

    def work(batches):
        """Sums of the trees over stretches of rows. A row's counts depend on the partition and its place there."""
        part, stretch, held, size = TaskContext.get().partitionId(), 0, [], 0

        def added():
            code = np.concatenate([h[0] for h in held])
            label = np.concatenate([h[1] for h in held]) - centre
            own, place = np.unique(code, return_inverse=True)
            for begin in range(0, trees, lot):
                many = min(lot, trees - begin)
                n, s = np.empty((many, len(own))), np.empty((many, len(own)))
                for t in range(many):
                    rng = np.random.default_rng([seed, begin + t, part, stretch])
                    w = rng.poisson(1.0, len(code)) if bootstrap else np.ones(len(code))
                    n[t] = np.bincount(place, weights=w, minlength=len(own))
                    s[t] = np.bincount(place, weights=w * label, minlength=len(own))
                yield begin, own, n, s

        totals: dict[int, list] = {}

        def keep(parts):
            for begin, own, n, s in parts:
                if begin not in totals:
                    totals[begin] = [own, n, s]
                    continue
                old, old_n, old_s = totals[begin]
                both = np.union1d(old, own)
                fresh_n, fresh_s = np.zeros((len(n), len(both))), np.zeros((len(n), len(both)))
                for codes, a, b in ((old, old_n, old_s), (own, n, s)):
                    at = np.searchsorted(both, codes)
                    fresh_n[:, at] += a
                    fresh_s[:, at] += b
                totals[begin] = [both, fresh_n, fresh_s]

        def out():
            for begin, (own, n, s) in totals.items():
                for t in range(len(n)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), begin + t), type=pa.int32()), pa.array(own), pa.array(n[t]), pa.array(s[t])],
                        names=["tree", "code", "n", "s"],
                    )

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                keep(added())
                held, size, stretch = [], 0, stretch + 1
        if size:
            keep(added())
        yield from out()

    drawn = rows.select("code", "label").mapInArrow(work, "tree int, code long, n double, s double")
    return drawn.groupBy("tree", "code").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def forest_values(codes: np.ndarray, edges: Sequence[Sequence[float]], trees: Sequence[np.ndarray], shift: float) -> np.ndarray:
    """The mean of the trees' predictions for cells."""
    bins = bins_of(codes, edges)
    return shift + sum(tree_values(tree, bins) for tree in trees) / len(trees)


@dataclass
class Forest:
    """Trees on bins."""

    edges: list[list[float]]
    trees: list[np.ndarray]
    shift: float

    def score(self, df: DataFrame, values: Sequence[Column]) -> Column:
        """Prediction, or probability of label 1, of the rows of ``df``."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, self.trees, self.shift))

        @F.pandas_udf("double")
        def predicted(code: pd.Series) -> pd.Series:
            own, place = np.unique(code.to_numpy("int64"), return_inverse=True)
            return pd.Series(forest_values(own, *shared.value)[place])

        return predicted(cell_code(values, self.edges))


def fit_forest(rows: DataFrame, edges: list[list[float]], estimator) -> Forest | None:
    """The forest of rows (code, label); none where cells are too many, or labels of classes not 0 and 1."""
    ask = shape(estimator, len(edges))
    widths = np.array([len(e) + 1 for e in edges])
    spark = rows.sparkSession
    if isinstance(estimator, RandomForestClassifier):
        found = binary_cells(rows)
        if found is None:
            return None
        codes, n0, n1 = found
        shared = spark.sparkContext.broadcast((bins_of(codes, edges), n0, n1))

        def one(batches):
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    bins, zeros, ones = shared.value
                    tree = binary_tree(bins, widths, zeros, ones, ask, number)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], type=pa.int32()), pa.array([tree.ravel()], type=pa.list_(pa.float64()))], names=["tree", "nodes"]
                    )

        grown = spark.range(0, ask.trees, 1, math.ceil(ask.trees / LOT)).mapInArrow(one, "tree int, nodes array<double>")
        shift = 0.0
    else:
        size, shift = rows.agg(F.count_distinct("code"), F.avg("label")).first()
        if not 0 < size <= MAX_CELLS:
            return None
        cells = _numeric_cells(rows, edges, ask, shift, size)

        def each(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
            number, cell = int(key[0]), cell.sort_values("code")
            code, n, s = (cell[c].to_numpy() for c in ("code", "n", "s"))
            rng = np.random.default_rng([ask.seed & (2**63 - 1), number])
            tree = grow(bins_of(code, edges), widths, n, s, ask, rng)
            return pd.DataFrame({"tree": [number], "nodes": [tree.ravel()]})

        grown = cells.groupBy("tree").applyInPandas(each, "tree int, nodes array<double>")
    trees = [np.array(r["nodes"]).reshape(-1, 4) for r in grown.orderBy("tree").collect()]
    return Forest(edges, trees, shift)


def fit_boosted(rows: DataFrame, edges: list[list[float]], estimator, names: tuple[str, str, str]):
    """Spark ML's boosted trees on bins, fitted to the cells of rows (code, label)."""
    features, label, weight = names
    classes = isinstance(estimator, GBTClassifier)
    grouped = rows.groupBy("code", "label") if classes else rows.groupBy("code")
    mean = F.first("label") if classes else F.avg("label")
    cells = materialized(grouped.agg(F.count(F.lit(1)).cast("double").alias(weight), mean.alias("_label")))
    bins = {f"_b{j}": (F.floor(F.col("code") / s) if s == 1 else F.expr(f"code div {s}")) % (len(e) + 1) for j, (e, s) in enumerate(zip(edges, _steps(edges)))}
    wide = cells.select(weight, F.col("_label").alias(label), *[b.cast("double").alias(c) for c, b in bins.items()])
    parts = max(1, math.ceil(cells.count() / MAX_CELLS))
    table = VectorAssembler(inputCols=list(bins), outputCol=features).transform(wide).select(features, label, weight)
    return estimator.setWeightCol(weight).fit(table.repartition(parts) if parts > 1 else table.coalesce(1))

"""Many linear models at once: all folds, penalties and sets of features from the same passes over the rows.

A fit is a configuration (held-out rows, penalty, features, weighting). The rows are encoded and written once. Then

* one call of ``quantiles`` finds the medians of all held-out sets;
* one pass adds up a moment matrix per cell of fold numbers: the products of values, holes and label. Medians, means
  and deviations of any held-out set turn these into its own matrix, so leaving folds out means leaving their
  matrices out, and ridge models of all folds and penalties are solved from them without another look at the rows;
* logistic models take Newton steps: each pass gives loss, gradient and Hessian of all of them, added up in each
  task, and only these sums reach the driver. Five folds of seven penalties take as many passes as the slowest one.

A Hessian has (features + 1)² numbers; fits go through in lots of ``STATE`` numbers, so wide models cost passes and
not memory. Fits are those of ``modeling.logistic`` and ``modeling.ridge``: the intercept is not penalised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.modeling import Family, Preprocessor
from lodestat.operators.ranks import quantiles
from lodestat.session import materialized, ship_by_value

ship_by_value(__name__)

STATE = 4_000_000
MAX_STEPS = 100
_FOLDS, _Y, _W, _X = "_plis", "_y", "_w", "_x"

Held = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Fit:
    """A configuration. Rows with any of the fold numbers ``held`` are not learnt from; those with all of the
    numbers ``on`` (by default ``held``) are scored. ``c`` is the inverse penalty of a logistic fit, the penalty of a
    ridge fit."""

    name: str
    held: Held = ()
    c: float = 1.0
    features: tuple[str, ...] | None = None
    weighted: bool = False
    on: Held | None = None

    @property
    def scores(self) -> Held:
        return self.held if self.on is None else self.on


@dataclass
class Encoded:
    """Rows ready for fits: ``table`` holds the carried columns, fold numbers, label, weight and values."""

    table: DataFrame
    carried: list[str]
    folds: list[str]
    sources: list[str]  # the variable behind each value
    filled: int  # so many first values are filled and scaled; the others are 0 or 1
    scale: bool

    def cells(self, held: Held) -> tuple[tuple[int, int], ...]:
        return tuple((self.folds.index(name), number) for name, number in held)


@dataclass
class Solution:
    """Centre, scale and coefficients of a fit, on filled values; ``weights`` has the intercept last."""

    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    steps: int = 0

    def values(self, x: np.ndarray) -> np.ndarray:
        return _standardised(x, self.medians, self.means, self.deviations)[:, [*self.columns, -1]] @ self.weights


def encode(
    df: DataFrame,
    family: Family,
    target: str,
    folds: Sequence[str] = ("fold",),
    carry: Sequence[str] = (),
    weight: str | None = None,
) -> Encoded:
    """``df`` with its values in one array, written once. A row without label or weight is scored only; a row
    without a fold number is neither learnt from nor scored where that fold matters."""
    prep = Preprocessor(list(family.numeric), {c: list(v) for c, v in family.ordinal.items()}, {}, False)
    raw = [F.coalesce(prep._raw(df, c), F.lit(float("nan"))) for c in (*family.numeric, *family.ordinal)]
    hot = Preprocessor([], {}, {c: list(v) for c, v in family.nominal.items()}, False).outputs(df)
    values = F.array(*raw, *[z for _, z in hot]) if raw or hot else F.array().cast("array<double>")
    table = materialized(
        df.select(
            *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
            F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in folds]).alias(_FOLDS),
            F.coalesce(F.col(target).cast("double"), F.lit(float("nan"))).alias(_Y),
            (F.coalesce(F.col(weight).cast("double"), F.lit(float("nan"))) if weight else F.lit(1.0)).alias(_W),
            values.alias(_X),
        )
    )
    return Encoded(table, list(carry), list(folds), [*family.numeric, *family.ordinal, *[c for c, _ in hot]], len(raw), family.scale)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """(fold numbers, labels, weights, values) of a batch."""
    def at(name):
        return batch.column(batch.schema.get_field_index(name))

    n = batch.num_rows
    folds = at(_FOLDS).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    x = at(_X).flatten().to_numpy(zero_copy_only=False).reshape(n, width) if width else np.zeros((n, 0))
    return folds, at(_Y).to_numpy(zero_copy_only=False), at(_W).to_numpy(zero_copy_only=False), x


def _learns(folds: np.ndarray, held) -> np.ndarray:
    good = np.ones(len(folds), dtype=bool)
    for place, number in held:
        good &= (folds[:, place] != number) & (folds[:, place] >= 0)
    return good


def _scores(folds: np.ndarray, on) -> np.ndarray:
    good = np.ones(len(folds), dtype=bool)
    for place, number in on:
        good &= folds[:, place] == number
    return good


def _standardised(x: np.ndarray, medians, means, deviations) -> np.ndarray:
    """Filled and scaled values, with a one at the end."""
    k = len(medians)
    head = np.where(np.isnan(x[:, :k]), medians, x[:, :k])
    return np.column_stack([(head - means) / deviations, x[:, k:], np.ones(len(x))])


def _added_up(rows: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Sums by key and place of rows (key, values), as one array per key; a bounded number of both."""
    places = rows.select(key, F.posexplode("values").alias("place", "value"))
    sums = places.groupBy(key, "place").agg(F.sum("value").alias("value")).toPandas().sort_values([key, "place"])
    return {int(k): part["value"].to_numpy() for k, part in sums.groupby(key)}


def _medians(encoded: Encoded, held: Sequence[Held]) -> np.ndarray:
    """Medians of the filled columns without each of the held-out sets, one row per set; 0 for an empty column."""
    out = np.zeros((len(held), encoded.filled))
    if not encoded.filled:
        return out
    keep = []
    for i, cells in enumerate(map(encoded.cells, held)):
        good = F.lit(True)
        for place, number in cells:
            good &= (F.col(_FOLDS)[place] != number) & (F.col(_FOLDS)[place] >= 0)
        keep.append(F.when(good, F.lit(i)))
    cells = F.posexplode(F.slice(_X, 1, encoded.filled)).alias("colonne", "valeur")
    long = encoded.table.select(F.array_compact(F.array(*keep)).alias("_h"), cells).where(~F.isnan("valeur"))
    found = quantiles(long.select(F.explode("_h").alias("_h"), "colonne", "valeur"), [0.5], ("_h", "colonne"))
    for row in found.collect():
        out[row["_h"], row["colonne"]] = row["quantiles"][0]
    return out


def moments(encoded: Encoded, shift: np.ndarray) -> dict[tuple, np.ndarray]:
    """Moment matrices of (1, values - shift, holes, hot values, label) by (labelled, fold numbers), from one pass."""
    width, k = len(encoded.sources), encoded.filled
    size = 1 + width + k + 1

    def work(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            folds, y, _, x = _arrays(batch, width)
            hole = np.isnan(x[:, :k])
            known = ~np.isnan(y)
            row = np.column_stack(
                [np.ones(len(x)), np.where(hole, 0.0, x[:, :k] - shift), hole, x[:, k:], np.where(known, y, 0.0)]
            )
            cells, number = np.unique(np.column_stack([known, folds]), axis=0, return_inverse=True)
            for i, cell in enumerate(cells.tolist()):
                part = row[number.ravel() == i]
                total[tuple(cell)] = total.get(tuple(cell), 0.0) + part.T @ part
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c) for c in total], type=pa.list_(pa.int32())), pa.array([m.ravel() for m in total.values()], type=pa.list_(pa.float64()))],
                names=["cell", "values"],
            )

    rows = encoded.table.select(_FOLDS, _Y, _W, _X).mapInArrow(work, "cell array<int>, values array<double>")
    places = rows.select("cell", F.posexplode("values").alias("place", "value"))
    out: dict[tuple, np.ndarray] = {}
    for row in places.groupBy("cell", "place").agg(F.sum("value").alias("value")).collect():
        matrix = out.setdefault(tuple(row["cell"]), np.zeros(size * size))
        matrix[row["place"]] = row["value"]
    return {cell: matrix.reshape(size, size) for cell, matrix in out.items()}


class Prepared:
    """Medians, means, deviations and moment matrices of every held-out set."""

    def __init__(self, encoded: Encoded, held: Sequence[Held]) -> None:
        self.encoded, self.held = encoded, list(dict.fromkeys(held))
        k = encoded.filled
        self.medians = _medians(encoded, self.held)
        self.shift = self.medians[0] if len(self.held) else np.zeros(k)
        found = moments(encoded, self.shift)
        size = 2 + len(encoded.sources) + k
        self.all, self.labelled = [], []
        for cells in map(encoded.cells, self.held):
            both = [np.zeros((size, size)), np.zeros((size, size))]
            for (known, *numbers), matrix in found.items():
                if _learns(np.array([numbers]), cells)[0]:
                    both[int(known)] += matrix
            self.all.append(both[0] + both[1])
            self.labelled.append(both[1])
        self.means, self.deviations = np.zeros((len(self.held), k)), np.ones((len(self.held), k))
        if encoded.scale:
            for h, matrix in enumerate(self.all):
                n = matrix[0, 0] or 1.0
                fill = self.medians[h] - self.shift
                diagonal = np.diag(matrix)
                first = (matrix[0, 1 : 1 + k] + matrix[0, 1 + k : 1 + 2 * k] * fill) / n
                second = (diagonal[1 : 1 + k] + diagonal[1 + k : 1 + 2 * k] * fill * fill) / n
                spread = np.sqrt(np.maximum(second - first * first, 0.0))
                self.means[h] = first + self.shift
                self.deviations[h] = np.where(spread > 1e-12 * np.sqrt(second), spread, 1.0)

    def columns(self, features: tuple[str, ...] | None) -> np.ndarray:
        kept = None if features is None else set(features)
        return np.array([i for i, s in enumerate(self.encoded.sources) if kept is None or s in kept], dtype=int)

    def solution(self, fit: Fit, weights: np.ndarray, steps: int = 0) -> Solution:
        h = self.held.index(fit.held)
        return Solution(self.medians[h], self.means[h], self.deviations[h], self.columns(fit.features), weights, steps)

    def matrix(self, held: Held) -> np.ndarray:
        """Moments of the labelled rows of a held-out set: its scaled values, one, and the label."""
        h, k, width = self.held.index(held), self.encoded.filled, len(self.encoded.sources)
        size = 2 + width + k
        turn = np.zeros((width + 2, size))
        scale = 1.0 / self.deviations[h]
        for i in range(k):
            turn[i, 1 + i] = scale[i]
            turn[i, 1 + k + i] = (self.medians[h, i] - self.shift[i]) * scale[i]
            turn[i, 0] = (self.shift[i] - self.means[h, i]) * scale[i]
        for i in range(k, width):
            turn[i, 1 + k + i] = 1.0
        turn[width, 0] = turn[width + 1, size - 1] = 1.0
        return turn @ self.labelled[h] @ turn.T


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


def ridge_fits(encoded: Encoded, fits: Sequence[Fit], prepared: Prepared | None = None) -> list[Solution]:
    """Ridge models of all fits from the moments alone. A fit without labelled rows predicts NaN."""
    prepared = prepared or Prepared(encoded, [f.held for f in fits])
    out = []
    for fit in fits:
        if fit.weighted:
            raise ValueError("ridge fits take no weights")
        matrix = prepared.matrix(fit.held)
        columns = prepared.columns(fit.features)
        used = [*columns, len(encoded.sources)]
        gram, right = matrix[np.ix_(used, used)], matrix[used, -1]
        if not gram[-1, -1]:
            out.append(prepared.solution(fit, np.full(len(used), np.nan)))
            continue
        gram = gram + np.diag([*[fit.c] * len(columns), 0.0])
        out.append(prepared.solution(fit, _solved(gram, right), 1))
    return out


def _newton_pass(encoded: Encoded, jobs: list[tuple]) -> dict[int, np.ndarray]:
    """By job: loss, sum of weights, of positive weights, number of rows, gradient and Hessian, unpenalised.

    A job is (held cells, weighted, solution)."""
    width = len(encoded.sources)
    shared = encoded.table.sparkSession.sparkContext.broadcast(jobs)

    def work(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, y, w, x = _arrays(batch, width)
            known, ready = ~np.isnan(y) & ~np.isnan(w), {}
            for number, (held, weighted, s) in enumerate(shared.value):
                if held not in ready:
                    rows = known & _learns(folds, held)
                    ready[held] = rows, _standardised(x[rows], s.medians, s.means, s.deviations)
                rows, z = ready[held]
                z = z[:, [*s.columns, -1]]
                label, weight = y[rows], w[rows] if weighted else np.ones(len(z))
                eta = z @ s.weights
                mean = np.exp(-np.logaddexp(0.0, -eta))
                loss = (weight * (np.logaddexp(0.0, eta) - label * eta)).sum()
                gradient = z.T @ (weight * (mean - label))
                hessian = z.T @ (z * (weight * mean * (1 - mean))[:, None])
                head = [loss, weight.sum(), (weight * label).sum(), float(len(z))]
                total[number] = total.get(number, 0.0) + np.concatenate([head, gradient, hessian.ravel()])
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), type=pa.int32()), pa.array(list(total.values()), type=pa.list_(pa.float64()))],
                names=["job", "values"],
            )

    rows = encoded.table.select(_FOLDS, _Y, _W, _X).mapInArrow(work, "job int, values array<double>")
    return _added_up(rows, "job")


def logistic_fits(encoded: Encoded, fits: Sequence[Fit], prepared: Prepared | None = None) -> list[Solution]:
    """Logistic models of all fits, by Newton steps that are halved where a loss would rise.

    A fit whose rows have one class predicts it for certain; a fit without labelled rows predicts NaN; a fit without
    features predicts the share of positive rows.
    """
    prepared = prepared or Prepared(encoded, [f.held for f in fits])
    at = [prepared.solution(f, np.zeros(len(prepared.columns(f.features)) + 1)) for f in fits]
    before: list[tuple[np.ndarray, float] | None] = [None] * len(fits)
    width = len(encoded.sources) + 1
    lot = max(1, STATE // (width * width))
    active = list(range(len(fits)))
    for step in range(1, MAX_STEPS + 1):
        still = []
        for begin in range(0, len(active), lot):
            part = active[begin : begin + lot]
            found = _newton_pass(encoded, [(encoded.cells(fits[i].held), fits[i].weighted, at[i]) for i in part])
            for job, i in enumerate(part):
                s, n = at[i], len(at[i].weights)
                s.steps = step
                sums = found.get(job)
                if sums is None or not sums[3] or not sums[1]:
                    s.weights = np.full(n, np.nan)
                    continue
                loss, weight, positive, rows = sums[:4]
                if positive <= 0 or positive >= weight:
                    s.weights = np.array([*[0.0] * (n - 1), np.inf if positive > 0 else -np.inf])
                    continue
                penalty = np.array([*[weight / (fits[i].c * rows)] * (n - 1), 0.0])
                loss += 0.5 * (penalty * s.weights**2).sum()
                gradient = sums[4 : 4 + n] + penalty * s.weights
                hessian = sums[4 + n :].reshape(n, n) + np.diag(penalty)
                old = before[i]
                if old is not None and loss > old[1] + 1e-12 * (1 + abs(old[1])):
                    s.weights = (s.weights + old[0]) / 2
                    still.append(i)
                    continue
                move = _solved(hessian, gradient)
                before[i] = (s.weights, loss)
                s.weights = s.weights - move
                if float(gradient @ move) > 1e-10 * (1 + abs(loss)):
                    still.append(i)
        active = still
        if not active:
            break
    return at


def scores(encoded: Encoded, fits: Sequence[Fit], solutions: Sequence[Solution], logistic: bool = True) -> DataFrame:
    """The carried columns, ``nom`` and ``p`` of every row that a fit scores, from one pass."""
    width, carried = len(encoded.sources), [f"_c{i}" for i in range(len(encoded.carried))]
    shared = encoded.table.sparkSession.sparkContext.broadcast(
        [(f.name, encoded.cells(f.scores), s) for f, s in zip(fits, solutions)]
    )

    def work(batches):
        for batch in batches:
            folds, _, _, x = _arrays(batch, width)
            for name, on, s in shared.value:
                rows = np.flatnonzero(_scores(folds, on))
                if not len(rows):
                    continue
                value = s.values(x[rows])
                p = np.exp(-np.logaddexp(0.0, -value)) if logistic else value
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([name] * len(rows), type=pa.string()), pa.array(p, from_pandas=True)],
                    names=[*carried, "nom", "p"],
                )

    kinds = dict(encoded.table.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in carried], "nom string, p double"])
    out = encoded.table.mapInArrow(work, schema)
    return out.select(*[F.col(c).alias(n) for c, n in zip(carried, encoded.carried)], "nom", "p")


def by_fold(name: str, n_splits: int, **options) -> list[Fit]:
    """A configuration fitted without each of the folds, and scored on it."""
    return [Fit(name, (("fold", k),), **options) for k in range(n_splits)]


def out_of_fold_many(
    df: DataFrame,
    family: Family,
    target: str,
    fits: Sequence[Fit],
    carry: Sequence[str] = (),
    weight: str | None = None,
    target_name: str | None = None,
) -> DataFrame:
    """The carried columns, the target (as ``target_name``), ``nom`` and ``p`` of all fits of a family, written once."""
    folds = list(dict.fromkeys([name for f in fits for name, _ in (*f.held, *f.scores)])) or ["fold"]
    named = df.withColumn(target_name, F.col(target)) if target_name else df
    encoded = encode(named, family, target, folds, [*carry, target_name or target], weight)
    solve = logistic_fits if family.classifier else ridge_fits
    return materialized(scores(encoded, fits, solve(encoded, fits), family.classifier))

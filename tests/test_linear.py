"""Many linear models at once against single fits, closed forms and plain Newton steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import linear, modeling

ROLES = {"numeric": ("a", "b"), "ordinal": {"o": ["bas", "haut"]}, "nominal": {"g": ["x", "y", "z"]}}


def rows(seed=1, n=400):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        a, g = draw.gauss(1000, 50), draw.choice(["x", "y", "z", None, "w"])
        t = 0.02 * (a - 1000) + (g == "x") + draw.gauss(0, 1)
        out.append((k, None if k % 17 == 0 else a, float("nan") if k % 13 == 0 else draw.random(), draw.choice(["bas", "haut", None]), g,
                    None if k % 41 == 0 else int(t > 0.3), 3 * t, k % 4 if k % 97 else None, draw.random() + 0.5))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "k int, a double, b double, o string, g string, y int, t double, fold int, w double").repartition(3).cache()


def test_logistic_fits_are_those_of_single_fits(table):
    family = modeling.Family("logreg", modeling.logistic(), True, True, **ROLES)
    fits = [f for c in (0.01, 1.0, 30.0) for f in linear.by_fold(str(c), 4, c=c)]
    encoded = linear.encode(table, family, "y", carry=["k"])
    solved = linear.logistic_fits(encoded, fits)
    assert max(s.steps for s in solved) <= 10
    got = {(r.k, r.nom): r.p for r in linear.scores(encoded, fits, solved).collect()}
    for c in (0.01, 30.0):
        single = modeling.Family("logreg", modeling.logistic(c), True, True, **ROLES)
        for r in modeling.out_of_fold(table.where("fold IS NOT NULL"), single, "y", 4).collect():
            assert abs(got[r.k, str(c)] - r.p) < 1e-6
    assert len(got) == 3 * table.where("fold IS NOT NULL").count()


def test_ridge_fits_are_those_of_the_normal_equations(table):
    family = modeling.Family("ridge", modeling.ridge(), True, False, **ROLES)
    fits = [f for c in (0.5, 20.0) for f in linear.by_fold(str(c), 4, c=c)] + [linear.Fit("tout", (), 3.0, ("a", "g"))]
    encoded = linear.encode(table, family, "t", carry=["k"])
    solved = linear.ridge_fits(encoded, fits)
    got = {(r.k, r.nom): r.p for r in linear.scores(encoded, fits, solved, False).collect()}
    for fit in fits:
        learnt = [r for r in rows() if not fit.held or (r[7] is not None and r[7] != fit.held[0][1])]
        scored = [r for r in rows() if not fit.held or r[7] == fit.held[0][1]]

        def design(part):
            x = np.array([[np.nan if r[1] is None else r[1], r[2], {"bas": 0, "haut": 1}.get(r[3], np.nan)] for r in part], dtype=float)
            hot = np.array([[r[4] == v for v in "xyz"] for r in part], dtype=float)
            return x, hot

        x, hot = design(learnt)
        middle = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), middle, x)
        mean, spread = x.mean(axis=0), x.std(axis=0)
        keep = slice(0, 1) if fit.features else slice(0, 3)
        z = np.column_stack([((x - mean) / spread)[:, keep], hot])
        y = np.array([r[6] for r in learnt])
        centred = z - z.mean(axis=0)
        beta = np.linalg.solve(centred.T @ centred + fit.c * np.eye(z.shape[1]), centred.T @ (y - y.mean()))
        x, hot = design(scored)
        z2 = np.column_stack([((np.where(np.isnan(x), middle, x) - mean) / spread)[:, keep], hot])
        want = (z2 - z.mean(axis=0)) @ beta + y.mean()
        assert np.allclose([got[r[0], fit.name] for r in scored], want, atol=1e-8)


def test_weighted_fits_and_fewer_features(table):
    family = modeling.Family("logreg", modeling.logistic(), True, True, **ROLES)
    fits = [linear.Fit("w", (), 2.0, weighted=True), linear.Fit("a", (), 2.0, ("a",)), linear.Fit("rien", (), 2.0, ())]
    encoded = linear.encode(table, family, "y", carry=["k", "y"], weight="w")
    solved = linear.logistic_fits(encoded, fits)
    got = linear.scores(encoded, fits, solved)
    share = table.agg(F.avg("y")).first()[0]
    assert all(abs(r.p - share) < 1e-9 for r in got.where("nom = 'rien'").collect())
    assert [s.columns.tolist() for s in solved[1:]] == [[0], []]
    known = [r for r in rows() if r[5] is not None]
    x = np.array([[np.nan if r[1] is None else r[1]] for r in rows()], dtype=float)
    middle = np.nanmedian(x)
    x = np.where(np.isnan(x), middle, x)
    at = np.zeros(2)
    z = np.column_stack([([middle if r[1] is None else r[1] for r in known] - x.mean()) / x.std(), np.ones(len(known))])
    y = np.array([r[5] for r in known])
    for _ in range(30):
        mean = 1 / (1 + np.exp(-z @ at))
        penalty = np.array([1 / 2.0, 0.0])
        at -= np.linalg.solve((z.T * (mean * (1 - mean))) @ z + np.diag(penalty), z.T @ (mean - y) + penalty * at)
    assert np.allclose(solved[1].weights, at, atol=1e-9)


def test_weights_count_as_copies(spark):
    data = [(k % 7 * 1.0, k % 2 if k % 3 else 1, 1 + k % 3) for k in range(60)]
    family = modeling.Family("logreg", modeling.logistic(), False, True, ("a",))
    one = spark.createDataFrame([(a, y, float(w), 0) for a, y, w in data], "a double, y int, w double, fold int")
    many = spark.createDataFrame([(a, y, 1.0, 0) for a, y, w in data for _ in range(w)], "a double, y int, w double, fold int")
    rows_, copies = len(data), sum(w for _, _, w in data)
    weighted = linear.logistic_fits(linear.encode(one, family, "y", weight="w"), [linear.Fit("w", (), 1.0 * copies / rows_, weighted=True)])
    plain = linear.logistic_fits(linear.encode(many, family, "y"), [linear.Fit("p", (), 1.0)])
    assert np.allclose(weighted[0].weights, plain[0].weights, atol=1e-8)


def test_odd_inputs(spark):
    family = modeling.Family("logreg", modeling.logistic(), True, True, ("a",), {}, {"g": ["x"]})
    schema = "a double, g string, y int, fold int"
    empty = spark.createDataFrame([], schema)
    assert linear.out_of_fold_many(empty, family, "y", linear.by_fold("e", 2)).count() == 0
    one_class = spark.createDataFrame([(1.0, "x", 1, 0), (2.0, None, 1, 1), (None, "x", 1, 1), (3.0, "q", None, 0)], schema)
    got = linear.out_of_fold_many(one_class, family, "y", linear.by_fold("u", 2)).collect()
    assert len(got) == 4 and all(r.p == 1.0 for r in got)
    unlabelled = spark.createDataFrame([(1.0, "x", None, 0), (2.0, "x", 1, 1)], schema)
    assert {r.p for r in linear.out_of_fold_many(unlabelled, family, "y", [linear.Fit("n", (("fold", 1),))]).collect()} == {None}
    separable = spark.createDataFrame([(float(k), "x", int(k > 20), k % 2) for k in range(40) if k not in (20, 21)], schema)
    got = linear.out_of_fold_many(separable, family, "y", linear.by_fold("s", 2, c=1e6)).collect()
    assert all((r.p > 0.5) == bool(r.y) for r in got)


def test_small_lots_change_nothing(table, monkeypatch):
    family = modeling.Family("logreg", modeling.logistic(), True, True, **ROLES)
    encoded, fits = linear.encode(table, family, "y"), linear.by_fold("c", 4)
    want = linear.logistic_fits(encoded, fits)
    monkeypatch.setattr(linear, "STATE", 1)
    assert all(np.allclose(a.weights, b.weights) for a, b in zip(want, linear.logistic_fits(encoded, fits)))

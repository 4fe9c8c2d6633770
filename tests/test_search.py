"""Searches, kept results, scenarios without features, panels of written scores, and the model queries as they are."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lodestat.operators import modeling

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(k % 11), "xyz"[k % 3], int(k * 7 % 13 > 5 - k % 11 / 3), k % 3) for k in range(150)]
    return spark.createDataFrame(rows, "k int, a double, g string, y int, fold int").coalesce(1).cache()


ROLES = {"numeric": ("a",), "nominal": {"g": ["x", "y", "z"]}}


def logreg(c=1.0, many=True):
    return modeling.Family("logreg", modeling.logistic(c), True, True, **ROLES, penalty=c if many else None)


def rounded(df):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]


def test_a_search_at_once_is_the_search_one_by_one(table):
    candidates = modeling.grid({"C": [0.01, 1.0, 30.0]})
    many = modeling.search(table, lambda p: logreg(p["C"]), candidates, "y", n_splits=3)
    each = modeling.search(table, lambda p: logreg(p["C"], False), candidates, "y", n_splits=3)
    assert rounded(many) == rounded(each)
    best = modeling.refit(table, lambda p: logreg(p["C"]), candidates, many, "y")
    assert best.predict(table).where("p BETWEEN 0 AND 1").count() == 150


def test_scenarios_with_and_without_features(table):
    blocks = {"nombre": ["a"], "groupe": ["g"]}
    many = {r[0]: r for r in rounded(modeling.ablate(table, logreg(), "y", blocks, 3))}
    each = {r[0]: r for r in rounded(modeling.ablate(table, logreg(many=False), "y", blocks, 3))}
    assert set(many) == {"complet", "sans nombre", "sans groupe", "minimisé"} and many["minimisé"][1] == 0
    assert all(abs(a - b) < 1e-5 for name in many for a, b in zip(many[name][1:], each[name][1:]))
    shares = {k: table.where(f"fold <> {k}").agg(F.avg("y")).first()[0] for k in range(3)}
    want = sum((r.y - shares[r.fold]) ** 2 for r in table.collect()) / 150
    assert abs(many["minimisé"][4] - want) < 1e-6


def test_weights_and_calibration(table):
    for compare in (
        lambda family: modeling.compare_weighting(table, family, "y", 3).orderBy("ponderation"),
        lambda family: modeling.isotonic_recalibration(table, family, "y", 3, 2, ["k"]).orderBy("version"),
    ):
        many, each = rounded(compare(logreg())), rounded(compare(logreg(many=False)))
        assert all(abs(a - b) < 1e-5 for x, y in zip(many, each) for a, b in zip(x, y) if isinstance(a, float))


def test_kept_results(spark, table, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(0, len(calls))], "essai int, n int")

    ask = lambda name, df, **more: modeling.cached_search(str(tmp_path), name, df, compute, **more).first()["n"]
    assert [ask("s", table), ask("s", table.repartition(7)), ask("t", table), ask("s", table.where("k > 0"))] == [1, 1, 2, 3]
    assert ask("s", table.withColumnRenamed("a", "b")) == 4 and ask("s", table, use_cache=False) == 5 and ask("s", table) == 5


@pytest.mark.parametrize("name", ["ablate", "grid_search", "train_vs_oof"])
def test_model_queries_run(spark, name):
    rows = contract.queries()[name](spark, FOLDER).collect()
    assert len(rows) == {"ablate": 5, "grid_search": 7, "train_vs_oof": 1}[name]
    assert all(v is not None for r in rows for v in r)


def test_forest_search_side_by_side(table):
    build = lambda p: modeling.Family("random_forest", modeling.forest(**p), False, True, **ROLES)
    # One tree is grown from all rows and features; more would draw them by partition.
    candidates = [{"trees": 1, "depth": 2, "subset": "all"}, {"trees": 1, "depth": 4, "subset": "all"}]
    found = modeling.search(table, build, candidates, "y", n_splits=3).collect()
    want = []
    for i, params in enumerate(candidates):
        scores = modeling.fold_scores(modeling.out_of_fold(table, build(params), "y", 3), "y")
        want.append((i, round(scores.agg(F.avg("roc_auc")).first()[0], 6)))
    assert sorted((r.essai, round(r.score, 6)) for r in found) == want


def test_forests_of_a_search_share_their_cells(spark, table, monkeypatch):
    """Many forests are grown from the cells of each fold, without a fit to the rows each, and the same ones each time."""
    def refused(*args):
        raise AssertionError("a forest was fitted to the rows")

    monkeypatch.setattr(modeling.RandomForestClassifier, "fit", refused)
    build = lambda p: modeling.Family("random_forest", modeling.forest(**p), False, True, **ROLES)
    candidates = [{"trees": 40, "depth": d, "seed": 5} for d in (2, 6)]
    found, again = ([(r.essai, r.score) for r in modeling.search(table, build, candidates, "y", n_splits=3).collect()] for _ in range(2))
    assert found == again and len(found) == 2 and all(0.5 < score < 1 for _, score in found)


def test_folds_of_a_linear_family_are_fitted_together(table, monkeypatch):
    each = {r.k: r.p for r in modeling.out_of_fold(table, logreg(many=False), "y", 3).collect()}

    def refused(*args):
        raise AssertionError("a fold was fitted on its own")

    monkeypatch.setattr(modeling.Family, "fit", refused)
    found = modeling.out_of_fold(table, logreg(), "y", 3)
    assert found.columns == [*table.columns, "p"]
    many = {r.k: r.p for r in found.collect()}
    assert set(many) == set(each) and all(abs(many[k] - each[k]) < 1e-5 for k in each)

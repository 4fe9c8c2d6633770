"""Registered model queries ask for the whole job of their operators."""

import inspect

import pytest

import __spark_entry__ as contract
from lodestat.operators import modeling
from lodestat.plans import runs

FOLDER = "/root/testdata/sf0.001"


class Asked(Exception):
    """Ends a query where its operator would begin."""


@pytest.fixture
def asked(spark, monkeypatch):
    def ask(name, module, function):
        signature = inspect.signature(getattr(module, function))

        def stop(*args, **options):
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            raise Asked(bound.arguments)

        with monkeypatch.context() as patched, pytest.raises(Asked) as found:
            patched.setattr(module, function, stop)
            contract.queries()[name](spark, FOLDER)
        return found.value.args[0]

    return ask


@pytest.mark.parametrize(
    "name, function",
    [
        ("out_of_fold", "out_of_fold"), ("fold_scores", "out_of_fold"), ("train_vs_oof", "train_vs_oof"),
        ("ablate", "ablate"), ("grid_search", "search"), ("random_search", "search"),
        ("class_weighting_metrics", "compare_weighting"), ("isotonic_recalibration", "isotonic_recalibration"),
    ],
)
def test_five_folds(asked, name, function):
    found = asked(name, modeling, function)
    assert found["n_splits"] == 5 and found.get("inner_splits", 5) == 5
    assert {r["fold"] for r in found["df"].select("fold").distinct().collect()} == set(range(5))


def test_candidates_and_blocks(asked):
    assert len(asked("grid_search", modeling, "search")["candidates"]) == 7
    drawn = asked("random_search", modeling, "search")
    assert len(drawn["candidates"]) == 20
    assert all(set(c) == {"trees", "depth", "leaf", "subset"} for c in drawn["candidates"])
    built = drawn["build"]({"trees": 300, "depth": 9, "leaf": 4, "subset": "log2"}).estimator(100, 1.0)
    assert (built.getNumTrees(), built.getMaxDepth(), built.getMinInstancesPerNode()) == (300, 9, 4)
    assert built.getFeatureSubsetStrategy() == "log2"
    assert set(asked("ablate", modeling, "ablate")["blocks"]) == {"langue", "longueur", "espaces"}


def test_default_trees(asked):
    assert asked("fit_classifier", modeling, "build_classifiers")["trees"] == 100
    assert asked("fit_regressor", modeling, "build_regressors")["trees"] == 100
    spec = asked("retrain", runs, "retrain")["spec"]
    assert (spec.trees, spec.n_splits) == (100, 5)

"""Trees from cells of binned features, against Spark ML on the rows."""

import pytest
from pyspark.sql import functions as F

from lodestat.operators import modeling, trees

ROLES = {"numeric": ("a", "b"), "nominal": {"g": ["x", "y", "z"]}}


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (k, float(k % 11), float(k * 37 % 101), "xyz"[k % 3], float(k % 11 * 3 + k**3 * 0.6180339887 % 13 + (k % 3 == 1) * 20), int(k * 7 % 13 > 5 - k % 11 / 3))
        for k in range(400)
    ]
    return spark.createDataFrame(rows, "k int, a double, b double, g string, v double, y int").coalesce(1).cache()


def on_rows(family, df, target):
    """The family's estimator on rows, with the features as ``Family.fit`` prepares them."""
    prep = modeling.Preprocessor(["a"], {}, {"g": ["x", "y", "z"]}, False).fit(df)
    ready = prep.transform(df).withColumn("label", F.col(target).cast("double"))
    return modeling.FittedModel(prep, family.estimator(1, 1.0).fit(ready), family.classifier)


def values(model, df):
    return [r.p for r in model.predict(df).orderBy("k").collect()]


def test_boosted_trees_of_cells_are_those_of_rows(table):
    family = modeling.build_regressors({**ROLES, "numeric": ("a",)}, trees=4)["gradient_boosting"]
    mine = family.fit(table, "v")
    assert mine.preprocessor.edges and mine.model.getNumTrees == 4
    assert values(mine, table) == pytest.approx(values(on_rows(family, table, "v"), table), abs=1e-9)


def test_one_tree_and_many(table):
    regressor = modeling.RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=1, maxDepth=4, seed=3, bootstrap=False)
    family = modeling.Family("tree", lambda n, sd: regressor, False, False, ("a",), {}, {"g": ["x", "y", "z"]})
    mine = family.fit(table, "v")
    assert isinstance(mine.model, trees.Forest)
    assert values(mine, table) == pytest.approx(values(on_rows(family, table, "v"), table), abs=1e-9)
    for kind, target in ((modeling.build_regressors, "v"), (modeling.build_classifiers, "y")):
        forest = kind(ROLES, 5, 60)["random_forest"].fit(table, target)
        assert isinstance(forest.model, trees.Forest) and len(forest.model.trees) == 60
        found = values(forest, table)
        assert found == values(kind(ROLES, 5, 60)["random_forest"].fit(table, target), table)  # the same again
        truth = [float(r[0]) for r in table.orderBy("k").select(target).collect()]
        mean = sum(truth) / 400
        assert sum((p - t) ** 2 for p, t in zip(found, truth)) < 0.9 * sum((mean - t) ** 2 for t in truth)


def test_other_classes_are_left_to_spark(table):
    three = table.withColumn("c", F.col("k") % 3)
    found = modeling.build_classifiers(ROLES, 0, 3)["random_forest"].fit(three, "c")
    assert not isinstance(found.model, trees.Forest)

"""Exact ranks and quantiles, one value holding a third of the rows, any partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators.protocol import assign_folds, stratified_split
from lodestat.operators.ranks import average_ranks, quantiles, running_totals


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    return np.where(rng.random(30_000) < 0.34, 7.5, rng.normal(0, 100, 30_000).round(2))


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles(spark, skewed, partitions):
    df = spark.createDataFrame([("a", float(v)) for v in skewed], "colonne string, valeur double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles(df.repartition(partitions), probs).first()["quantiles"]
    assert np.allclose(got, np.quantile(skewed, probs), rtol=0, atol=1e-9)


def test_quantiles_when_the_sketch_is_coarse(spark, skewed):
    df = spark.createDataFrame([("a", float(v)) for v in skewed], "colonne string, valeur double")
    got = quantiles(df, [0.3, 0.8], accuracy=100).first()["quantiles"]
    assert np.allclose(got, np.quantile(skewed, [0.3, 0.8]))


@pytest.mark.parametrize("size", [1, 2, 3, 15, 99, 101, 733, 4999, 5003])
def test_quantiles_of_small_tables(spark, size):
    """Neighbouring ranks are far apart in a small table: every one must stay in its bracket."""
    values = np.random.default_rng(size).normal(0, 1, size)
    df = spark.createDataFrame([("a", float(v)) for v in values], "colonne string, valeur double")
    probs = [i / 20 for i in range(21)] + [0.123, 0.987]
    got = quantiles(df, probs).first()["quantiles"]
    assert np.allclose(got, np.quantile(values, probs))


def test_ranks(spark, skewed):
    df = spark.createDataFrame([("a", float(v)) for v in skewed], "colonne string, valeur double")
    freq = df.groupBy("colonne", "valeur").agg(F.count("*").alias("n"))
    got = average_ranks(freq, ["colonne"]).toPandas().set_index("valeur")["rang"]
    expected = pd.Series(skewed).rank().groupby(skewed).first()
    assert (got.sort_index() == expected.sort_index()).all()


def test_running_totals_are_per_key(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 5), ("b", 2, 9)], "k string, v int, n int")
    got = {(r["k"], r["v"]): r["avant_n"] for r in running_totals(df, ["k"], "v", ["n"]).collect()}
    assert got == {("a", 1): 0, ("a", 3): 2, ("b", 2): 0}


def test_split_keeps_rates_and_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 < 3).cast("int"))
    one = stratified_split(df.repartition(1), "y", ["id"], 0.2, 42)
    many = stratified_split(df.repartition(9), "y", ["id"], 0.2, 42)
    counts = {(r["y"], r["est_test"]): r["count"] for r in one.groupBy("y", "est_test").count().collect()}
    assert counts == {(1, True): 60, (1, False): 240, (0, True): 140, (0, False): 560}
    assert one.join(many.withColumnRenamed("est_test", "autre"), "id").where("est_test <> autre").count() == 0
    other = stratified_split(df, "y", ["id"], 0.2, 43)
    assert one.join(other.withColumnRenamed("est_test", "autre"), "id").where("est_test <> autre").count() > 0


def test_folds_are_balanced(spark):
    df = spark.range(503).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    sizes = assign_folds(df, ["id"], 5, 1, "y").groupBy("y", "fold").count().toPandas()
    assert len(sizes) == 10
    assert sizes.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1

"""Draws come from written counts of values, not from the rows."""

from lodestat.operators import noise


def test_draws_do_not_read_the_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(400).selectExpr("CAST(id % 90 AS DOUBLE) AS x", "CAST(id % 3 AS STRING) AS g").write.parquet(path)
    draws = noise.permutation_draws(spark.read.parquet(path), [("x", "g")], 20, 1, "eta")
    assert path not in draws._jdf.queryExecution().toString()
    assert draws.count() == 20

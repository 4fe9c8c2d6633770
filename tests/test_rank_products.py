"""Rank correlations by tables of ranks: few values looked up, many joined, the most values grouped."""

import pytest

from lodestat.operators import association


def plain(rows, a, b):
    """Spearman's ρ of two columns over the rows that have both, ranks shared among ties."""
    kept = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]

    def ranks(values):
        return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]

    x, y = ranks([k[0] for k in kept]), ranks([k[1] for k in kept])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    spread = (sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y)) ** 0.5
    return sum((v - mx) * (w - my) for v, w in zip(x, y)) / spread if spread else None


@pytest.mark.parametrize("few", [100_000, 20, 0])
def test_every_way_to_the_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(association, "FEW_GROUPS", few)
    monkeypatch.setattr(association, "PAIRS_AT_ONCE", 2)
    rows = [
        (
            float(k * 37 % 101) if k % 9 else None, float(k % 7) if k % 5 else 0.0, float(k * k % 83) if k % 4 else None, 3.0,
            None if k % 2 else 1.0, 1.0 * k if k % 9 == 0 else None, None,
        )
        for k in range(180)
    ]
    names = list("abcdefg")
    table = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = {(r.variable_1, r.variable_2): r.valeur for r in association.correlation_matrix(table, names).collect()}
    # a and f share no row, and g has no number at all.
    assert set(found) == {p for p in association.upper_pairs(names) if "g" not in p and p != ("a", "f")}
    for (a, b), value in found.items():
        assert value == pytest.approx(plain(rows, names.index(a), names.index(b)), abs=1e-12)


def test_rows_do_not_move(spark):
    """The work is done when the operator returns: a row for each pair is all that is left."""
    table = spark.range(1000).selectExpr("CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    plan = association.correlation_matrix(table, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

import numpy as np
import pandas as pd
import pytest

from lodestat.operators import association, drift, explore, metrics, missing, noise


def pairs(spark, a, b, schema="a string, b string"):
    return spark.createDataFrame(list(zip(a, b)), schema)


def test_closed_forms(spark):
    v = association.cramers_v(pairs(spark, "aabb", "0011"), "a", "b").first()
    assert (v["valeur"], v["n_1"], v["n_2"]) == (1.0, 2, 2)
    constant = association.cramers_v(pairs(spark, "aaaa", "0011"), "a", "b").first()
    assert constant["valeur"] == 0.0
    numbers = pairs(spark, [10.0, 12.0, 16.0, 18.0], "aabb", "x double, g string")
    assert association.group_spread(numbers, "x", "g").first()["valeur"] == 6.0
    exact = pairs(spark, [5.0, 5.0, 12.0, 12.0], "aabb", "x double, g string")
    assert association.correlation_ratio(exact, "x", "g").first()["valeur"] == pytest.approx(1.0)


def test_eta_is_the_point_biserial_correlation(spark):
    rng = np.random.default_rng(0)
    x, g = rng.normal(1e6, 1, 500), rng.integers(0, 2, 500)
    df = pairs(spark, x.tolist(), g.tolist(), "x double, g long")
    eta = association.correlation_ratio(df, "x", "g").first()["valeur"]
    assert abs(eta - abs(np.corrcoef(x, g)[0, 1])) < 1e-9


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.integers(0, 9, (400, 3)).astype(float), columns=list("abc"))
    frame.loc[rng.random(400) < 0.3, "a"] = np.nan
    frame.loc[rng.random(400) < 0.2, "b"] = np.nan
    df = spark.createDataFrame(frame)
    for method in ("spearman", "pearson"):
        expected = frame.corr(method=method)
        for r in association.correlation_matrix(df, list("abc"), method).collect():
            assert r["valeur"] == pytest.approx(expected.loc[r["variable_1"], r["variable_2"]], abs=1e-12)


def test_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    row = explore.iqr_bounds(df, ["x"]).first()
    assert (row["borne_basse"], row["borne_haute"]) == (-1.0, 7.0)
    flat = spark.createDataFrame([(10.0,)] * 20 + [(900.0,)], "x double")
    row = explore.iqr_outliers(flat, ["x"]).first()
    assert row["n_hors_iqr"] == 1 and round(row["part_%"], 2) == 4.76
    row = explore.domain_check(spark.createDataFrame([(0.0,), (25.0,)], "x double"), {"x": (0, 20)}).first()
    assert (row["fin_%"], row["n_hors_domaine"], row["domaine"]) == (125.0, 1, "[0 ; 20]")


def test_overview_matches_pandas(spark):
    x = pd.Series([1.0, 2.0, 2.5, 9.0, np.nan, 40.0])
    row = explore.numeric_overview(spark.createDataFrame(x.to_frame("x")), ["x"]).first()
    assert row["n"] == 5 and row["mediane"] == x.median()
    assert row["ecart_type"] == pytest.approx(x.std())
    assert row["asymetrie"] == pytest.approx(x.skew())


def test_missing_together(spark):
    rows = [(None, None) if i < 50 else (1, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = [tuple(r) for r in missing.missing_per_row(df, ["a", "b"]).collect()]
    assert got == [(0, 50, 25), (1, 0, 50), (2, 50, 25)]


def draws_by_shuffling(values, groups, measure, n=1500):
    rng = np.random.default_rng(5)
    return np.array([measure(values, rng.permutation(groups)) for _ in range(n)])


def cramers(a, b):
    table = pd.crosstab(a, b).to_numpy(float)
    n = table.sum()
    chi = ((table - np.outer(table.sum(1), table.sum(0)) / n) ** 2 / (np.outer(table.sum(1), table.sum(0)) / n)).sum()
    return np.sqrt(chi / n / (min(table.shape) - 1))


def eta(x, g):
    m = x.mean()
    between = sum((g == k).sum() * (x[g == k].mean() - m) ** 2 for k in np.unique(g))
    return np.sqrt(between / ((x - m) ** 2).sum())


def spread(x, g):
    means = [x[g == k].mean() for k in np.unique(g)]
    return max(means) - min(means)


@pytest.mark.parametrize("per_task", [20_000, 60])
def test_noise_has_the_law_of_shuffled_rows(spark, per_task, monkeypatch):
    """Also when one value holds a third of the rows and its column spans several tasks."""
    monkeypatch.setattr(noise, "VALUES_PER_TASK", per_task)
    rng = np.random.default_rng(2)
    x = np.where(rng.random(600) < 0.34, 3.0, rng.normal(0, 2, 600))
    c, g = rng.integers(0, 4, 600), rng.integers(0, 3, 600)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": c.astype(str), "g": g.astype(str)}))
    for kind, first, values, measure in (("v", "c", c, cramers), ("eta", "x", x, eta), ("spread", "x", x, spread)):
        got = noise.permutation_draws(df, [(first, "g")], 1500, 1, kind).toPandas()
        assert sorted(got["tirage"]) == list(range(1500))
        expected = draws_by_shuffling(values, g, measure)
        for q in (0.5, 0.95):
            a, b = np.quantile(got["valeur"], q), np.quantile(expected, q)
            assert abs(a - b) < 0.09 * b, (kind, q, a, b)


def test_more_groups_than_travel_are_drawn_by_blocks(spark, monkeypatch):
    """The law of shuffled rows holds in blocks, where both sides span several buckets; other pairs are drawn beside."""
    monkeypatch.setattr(noise, "GROUPS_AT_ONCE", 10)
    monkeypatch.setattr(noise, "BLOCK_SIDE", 9)
    rng = np.random.default_rng(3)
    x = np.where(rng.random(600) < 0.34, 3.0, rng.integers(-20, 20, 600))
    c, g, h = (rng.integers(0, k, 600).astype(str) for k in (60, 40, 3))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": c, "g": g, "h": h}))
    for kind, first, values, measure in (("v", "c", c, cramers), ("eta", "x", x, eta), ("spread", "x", x, spread)):
        got = noise.permutation_draws(df, [(first, "g"), (first, "h")], 400, 1, kind).toPandas()
        for second, groups in (("g", g), ("h", h)):
            mine = got[got["variable_2"] == second]
            assert sorted(mine["tirage"]) == list(range(400))
            expected = draws_by_shuffling(values, groups, measure, 400)
            for q in (0.5, 0.95):
                a, b = np.quantile(mine["valeur"], q), np.quantile(expected, q)
                assert abs(a - b) < 0.15 * b, (kind, second, q, a, b)


def test_blocks_keep_both_margins():
    counts, groups = [np.array([5, 9]), np.array([20]), np.array([1, 15])], [np.array([7, 3]), np.array([30, 10])]
    rows, columns = np.array([14, 20, 16]), np.array([10, 40])
    blocks = {
        (i, j): noise._block_shares([1, 2], counts[i], groups[j], rows, columns, i, j, 40) for i in range(3) for j in range(2)
    }
    assert all((values.sum(axis=1) == inside.sum(axis=1)).all() for values, inside in blocks.values())
    assert all((sum(blocks[i, j][0] for j in range(2)) == counts[i]).all() for i in range(3))
    assert all((sum(blocks[i, j][1] for i in range(3)) == groups[j]).all() for j in range(2))


def test_noise_is_reproducible_and_p_never_zero(spark):
    df = pairs(spark, ["a"] * 50 + ["b"] * 50, ["0"] * 50 + ["1"] * 50)
    observed = association.association_pairs(df, [("a", "b")])
    one = noise.permutation_test(df, observed, 99, 7).first()
    two = noise.permutation_test(df.repartition(6), observed, 99, 7).first()
    assert one == two
    assert one["p_permutation"] == pytest.approx(0.01) and one["bruit"] < 1


def test_summary(spark):
    draws = spark.createDataFrame([("a", "b", 0.0)] * 99, "variable_1 string, variable_2 string, valeur double")
    observed = spark.createDataFrame([("a", "b", 10.0)], "variable_1 string, variable_2 string, valeur double")
    row = noise.permutation_summary(draws, observed).first()
    assert (row["bruit"], row["p_permutation"]) == (0.0, 0.01)


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30
    df = pairs(spark, y.tolist(), p.tolist(), "y long, p double")
    row = metrics.classification_metrics(df, "y", "p").first()
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    assert row["roc_auc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean())
    steps, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = ((p >= t) & (y == 1)).sum() / y.sum()
        steps += (recall - before) * y[p >= t].mean()
        before = recall
    assert row["pr_auc"] == pytest.approx(steps)
    assert row["brier"] == pytest.approx(((p - y) ** 2).mean())
    target = metrics.pick_threshold(df, "y", "p", recall_target=0.8).first()["seuil"]
    assert target == max(t for t in set(p) if ((p >= t) & (y == 1)).sum() / y.sum() >= 0.8)
    with pytest.raises(ValueError):
        metrics.pick_threshold(df, "y", "p", capacity_n=3, recall_target=0.5)


def test_capacity(spark):
    df = spark.createDataFrame([(0.1,), (0.9,), (0.9,), (0.5,)], "p double")
    assert metrics.capacity_threshold(df, "p", 1).first()["seuil"] == 0.9
    assert metrics.capacity_threshold(df, "p", 4).first()["seuil"] == 0.0
    assert metrics.capacity_threshold(df.where("p > 2"), "p", 4).first()["seuil"] == 1.0


def test_drift_cases(spark):
    flat = spark.createDataFrame([(1.0,)] * 50, "x double")
    wide = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    assert drift.psi_numeric(flat, wide, ["x"]).first()["psi"] == 0.0
    assert drift.psi_numeric(wide, wide.where("x < 0"), ["x"]).count() == 0
    a = spark.createDataFrame([("a",)] * 700 + [("b",)] * 300, "x string")
    b = spark.createDataFrame([("a",)] * 300 + [("b",)] * 700, "x string")
    assert drift.psi_categorical(a, b, ["x"]).first()["psi"] > 0.25
    row = drift.campaign_verdict(drift.assess_drift(wide, wide, ["x"]), wide, 200).first()
    assert row["mesurable"] is False and "50" in row["motif"]
    same = drift.ks_two_sample(wide, wide, ["x"]).first()
    assert (same["ks_statistic"], same["ks_pvalue"]) == (0.0, 1.0)


def test_deidentified_keeps_marginals_and_breaks_rows(spark):
    df = spark.range(300).selectExpr("id AS k", "id AS a", "id * 3 AS b")
    out = drift.deidentified_reference(df, ["a", "b"], "k", 1).toPandas()
    assert sorted(out["a"]) == list(range(300)) and sorted(out["b"]) == list(range(0, 900, 3))
    assert (out["b"] == 3 * out["a"]).mean() < 0.1
    again = drift.deidentified_reference(df.repartition(5), ["a", "b"], "k", 1).toPandas()
    assert set(map(tuple, out.values)) == set(map(tuple, again.values))
    assert drift.deidentified_reference(df.where("false"), ["a", "b"], "k", 1).count() == 0
    few = df.limit(1).selectExpr("k", "CAST(NULL AS string) AS a", "array(b) AS b", "1.5D AS k2")
    assert [tuple(r) for r in drift.deidentified_reference(few, ["a", "b", "k2"], "k", 1).collect()] == [(None, [0], 1.5)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 4_099])
def test_numbers_are_permuted_within_their_range(spark, n):
    rows = spark.range(n).select(*[drift.permuted("id", n, 7, c).alias(c) for c in "ab"]).toPandas()
    for c in "ab":
        assert sorted(rows[c]) == list(range(n))
    if n > 1_000:
        assert (rows["a"] != rows["b"]).mean() > 0.99 and (rows["a"].diff().abs() == 1).mean() < 0.01
        assert abs(rows["a"].corr(rows["b"])) < 0.06 and abs(rows["a"].corr(pd.Series(range(n)))) < 0.06


def test_rank_correlation_with_ties_holes_and_columns_that_never_meet(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.integers(0, 4, (600, 5)).astype(float), columns=list("abcde"))
    frame["b"] = 7.0
    frame.loc[rng.random(600) < 0.5, "c"] = np.nan
    frame["d"] = np.where(frame["c"].isna(), frame["d"], np.nan)
    df = spark.createDataFrame(frame).repartition(7)
    found = {(r[0], r[1]): r[2] for r in association.correlation_matrix(df, list("abcde")).collect()}
    expected = frame.corr(method="spearman")
    assert ("c", "d") not in found and len(found) == 9
    for (x, y), value in found.items():
        assert value is None if "b" in (x, y) else value == pytest.approx(expected.loc[x, y], abs=1e-12)


def test_ratio_of_uniforms_has_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    n = 200_000
    for good, bad, drawn in [(30, 50, 20), (400, 300, 650), (5, 9_000, 4_000), (2_000, 1_500, 1_200)]:
        mine = noise._ratio_of_uniforms(rng, np.full(n, good), np.full(n, bad), np.full(n, drawn))
        theirs = rng.hypergeometric(good, bad, drawn, n)
        assert mine.min() >= max(0, drawn - bad) and mine.max() <= min(good, drawn)
        low = int(min(mine.min(), theirs.min()))
        a, b = (np.bincount(v - low, minlength=int(max(mine.max(), theirs.max())) - low + 1) for v in (mine, theirs))
        seen = a + b > 20
        z = (a[seen] - b[seen]) / np.sqrt(a[seen] + b[seen])
        assert (z**2).sum() < 2 * seen.sum() + 12
    huge = noise._ratio_of_uniforms(rng, np.full(5_000, 3 * 10**11), np.full(5_000, 10**11), np.full(5_000, 4 * 10**9))
    spread = np.sqrt(4e9 * 0.75 * 0.25 * (4e11 - 4e9) / 4e11)
    assert abs(huge.mean() - 3e9) < 5 * spread / np.sqrt(5_000) and 0.95 < huge.std() / spread < 1.05


def test_tree_of_shares_keeps_both_margins():
    groups, sizes = np.array([7, 30, 13]), np.array([5, 20, 0, 11, 14])
    parts = [noise._share([1, 2], groups, sizes, k, 40) for k in range(5)]
    assert all((part.sum(axis=1) == size).all() for part, size in zip(parts, sizes))
    assert (sum(parts) == groups).all()


def test_halved_buckets_keep_the_law(monkeypatch):
    counts, groups = np.array([40, 25, 20, 10, 5]), np.array([60, 30, 10])
    means = []
    for most in (10**6, 30, 0):
        monkeypatch.setattr(noise, "ROWS_AT_ONCE", most)
        sums = noise._Sums("v", counts, np.zeros(5), groups, 4_000)
        noise._draw_bucket(np.random.default_rng(5), sums, np.tile(groups, (4_000, 1)))
        means.append(sums.q.mean() - 1)
    assert all(abs(m - 8 / 99) < 0.003 for m in means)


def test_missing_mechanism_finds_the_cause(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(0, 1, 500), rng.normal(0, 1, 500)
    c = rng.choice(["a", "b", "c"], 500)
    hole, free, by_c = x > 0.8, rng.random(500) < 0.2, c == "a"
    rows = [
        (None if h else 1.0, None if f else 2.0, None if k else "v", float(a), float(b), str(t))
        for h, f, k, a, b, t in zip(hole, free, by_c, x, z, c)
    ]
    df = spark.createDataFrame(rows, "m double, r double, n string, x double, z double, c string")
    found = {r["colonne"]: r for r in missing.missing_mechanism(df, ["m", "r", "n"], ["x", "z", "c"], 199, 1).collect()}
    assert set(found) == {"m", "r", "n"}
    assert (found["m"]["variable_liee"], found["m"]["type"], found["m"]["mcar_rejete"]) == ("x", "numérique", True)
    assert (found["n"]["variable_liee"], found["n"]["type"]) == ("c", "catégorielle")
    assert found["n"]["mesure"] > found["n"]["bruit_95"] and found["r"]["mesure"] < 0.35
    assert all(0 < r["p_permutation"] <= 1 for r in found.values())

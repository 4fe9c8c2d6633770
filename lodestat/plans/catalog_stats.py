"""Registered queries: exploration, missing values, associations, noise, chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import association, explore, missing, noise
from lodestat.operators.frequencies import long_numbers, number_frequencies
from lodestat.operators.ranks import average_ranks, quantiles
from lodestat.plans.registry import SQL_HOLES, R, holes, register, table

NUMBERS = ["q", "p", "d", "t"]
NOMINALS = ["f", "s", "g"]
_SQL_NUMBERS = f"WITH {SQL_HOLES}, long AS (SELECT colonne, v FROM holes UNPIVOT (v FOR colonne IN (q, p, d, t)))"
_SQL_NOMINALS = (
    f"WITH {SQL_HOLES}, freq AS (SELECT colonne, valeur, count(*) AS n FROM "
    "(SELECT colonne, valeur FROM holes UNPIVOT (valeur FOR colonne IN (f, s, g))) GROUP BY ALL), "
    "shares AS (SELECT *, sum(n) OVER (PARTITION BY colonne) AS total FROM freq)"
)


# --- distributions ----------------------------------------------------------------------------


@register(
    "class_balance",
    f"WITH {SQL_HOLES} SELECT coalesce(f, '(manquant)') AS modalite, count(*) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM holes)')} AS \"part_%\" FROM holes GROUP BY 1",
)
def _(spark, folder):
    return explore.class_balance(holes(spark, folder), "f")


@register(
    "imbalance_ratio",
    f"WITH {SQL_HOLES} SELECT {R('max(n) / min(n)')} AS ratio FROM (SELECT f, count(*) AS n FROM holes GROUP BY f)",
)
def _(spark, folder):
    return explore.imbalance_ratio(holes(spark, folder), "f")


@register(
    "numeric_overview",
    _SQL_NUMBERS + f" SELECT colonne, count(*) AS n, {R('avg(v)')} AS moyenne, {R('stddev_samp(v)')} AS ecart_type, {R('min(v)')} AS \"min\", "
    f"{R('quantile_cont(v, 0.5)')} AS mediane, {R('max(v)')} AS \"max\", {R('skewness(v)')} AS asymetrie FROM long GROUP BY colonne",
)
def _(spark, folder):
    return explore.numeric_overview(holes(spark, folder), NUMBERS)


@register(
    "modality_counts",
    f"WITH {SQL_HOLES} SELECT coalesce(g, '(manquant)') AS modalite, count(*) AS n FROM holes GROUP BY 1",
)
def _(spark, folder):
    return explore.modality_counts(holes(spark, folder), "g")


@register(
    "modality_overview",
    _SQL_NOMINALS
    + ", m AS (SELECT 'f' AS colonne, 100.0 * avg(CASE WHEN f IS NULL THEN 1 ELSE 0 END) AS v FROM holes UNION ALL SELECT 's', 0.0 UNION ALL "
    "SELECT 'g', 100.0 * avg(CASE WHEN g IS NULL THEN 1 ELSE 0 END) FROM holes) "
    "SELECT s.colonne, count(*) AS n_modalites, arg_min(valeur, (-n, valeur)) AS dominante, "
    f"{R('100.0 * max(n) / any_value(total)')} AS \"part_dominante_%\", arg_max(valeur, (-n, valeur)) AS plus_rare, "
    f"{R('100.0 * min(n) / any_value(total)')} AS \"part_rare_%\", {R('any_value(m.v)')} AS \"manquants_%\" FROM shares s JOIN m USING (colonne) GROUP BY s.colonne",
)
def _(spark, folder):
    return explore.modality_overview(holes(spark, folder), NOMINALS)


@register(
    "rare_modalities",
    _SQL_NOMINALS + f" SELECT colonne, valeur AS modalite, n, {R('100.0 * n / total')} AS \"part_%\" FROM shares WHERE n / total < 0.2",
)
def _(spark, folder):
    return explore.rare_modalities(holes(spark, folder), NOMINALS, 0.2)


@register(
    "quasi_constant",
    _SQL_NOMINALS + f" SELECT colonne, arg_min(valeur, (-n, valeur)) AS dominante, {R('100.0 * max(n) / any_value(total)')} AS \"part_%\" "
    "FROM shares GROUP BY colonne HAVING max(n) / any_value(total) >= 0.34",
)
def _(spark, folder):
    return explore.quasi_constant(holes(spark, folder), NOMINALS, 0.34)


@register(
    "iqr_bounds",
    _SQL_NUMBERS + f" SELECT colonne, {R('quantile_cont(v, 0.25)')} AS q1, {R('quantile_cont(v, 0.75)')} AS q3, "
    f"{R('quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))')} AS borne_basse, "
    f"{R('quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))')} AS borne_haute FROM long GROUP BY colonne",
)
def _(spark, folder):
    return explore.iqr_bounds(holes(spark, folder), NUMBERS)


_SQL_BOUNDS = ", b AS (SELECT colonne, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY colonne)"


@register(
    "iqr_outliers",
    _SQL_NUMBERS + _SQL_BOUNDS + f" SELECT colonne, {R('min(v)')} AS \"min\", {R('max(v)')} AS \"max\", {R('any_value(q1 - 0.2 * (q3 - q1))')} AS borne_basse, "
    f"{R('any_value(q3 + 0.2 * (q3 - q1))')} AS borne_haute, count(*) FILTER (v < q1 - 0.2 * (q3 - q1) OR v > q3 + 0.2 * (q3 - q1)) AS n_hors_iqr, "
    f"{R('100.0 * count(*) FILTER (v < q1 - 0.2 * (q3 - q1) OR v > q3 + 0.2 * (q3 - q1)) / count(*)')} AS \"part_%\" FROM long JOIN b USING (colonne) GROUP BY colonne",
)
def _(spark, folder):
    return explore.iqr_outliers(holes(spark, folder), NUMBERS, 0.2)


@register(
    "rows_with_outlier",
    _SQL_NUMBERS + _SQL_BOUNDS + ", w AS (SELECT max(q1) FILTER (colonne = 'q') AS q1, max(q3) FILTER (colonne = 'q') AS q3, "
    "max(q1) FILTER (colonne = 'p') AS p1, max(q3) FILTER (colonne = 'p') AS p3 FROM b) "
    "SELECT count(*) FILTER (coalesce(q < q1 - 0.1 * (q3 - q1) OR q > q3 + 0.1 * (q3 - q1), FALSE) OR "
    "coalesce(p < p1 - 0.1 * (p3 - p1) OR p > p3 + 0.1 * (p3 - p1), FALSE)) AS n_lignes_hors_iqr, count(*) AS n_lignes FROM holes, w",
)
def _(spark, folder):
    return explore.rows_with_outlier(holes(spark, folder), ["q", "p"], 0.1)


@register(
    "domain_check",
    f"WITH {SQL_HOLES} SELECT 'q' AS colonne, '[5 ; 45]' AS domaine, min(q) AS \"min\", max(q) AS \"max\", count(*) FILTER (q < 5 OR q > 45) AS n_hors_domaine, "
    f"{R('100 * (min(q) - 5) / 40')} AS \"debut_%\", {R('100 * (max(q) - 5) / 40')} AS \"fin_%\" FROM holes UNION ALL "
    f"SELECT 't', '[0 ; 0.1]', min(t), max(t), count(*) FILTER (t < 0 OR t > 0.1), {R('100 * min(t) / 0.1')}, {R('100 * max(t) / 0.1')} FROM holes",
)
def _(spark, folder):
    ranges = {"q": (5.0, 45.0), "t": (0.0, 0.1), "p": (0.0, float("inf"))}
    return explore.domain_check(holes(spark, folder), ranges)


@register(
    "target_rate_by_modality",
    f"WITH {SQL_HOLES} SELECT coalesce(g, '(manquant)') AS modalite, count(*) AS n, {R('100.0 * avg(y)')} AS \"taux_%\" FROM holes GROUP BY 1",
)
def _(spark, folder):
    return explore.target_rate_by_modality(holes(spark, folder), "g", "y")


@register(
    "histogram",
    _SQL_NUMBERS + ", r AS (SELECT colonne, min(v) AS lo, max(v) AS hi, least(30, count(DISTINCT v)) AS k FROM long GROUP BY colonne), "
    "h AS (SELECT colonne, lo, (hi - lo) / k AS w, CAST(least(floor((v - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS classe FROM long JOIN r USING (colonne)) "
    f"SELECT colonne, classe, {R('any_value(lo + classe * w)')} AS debut, {R('any_value(lo + (classe + 1) * w)')} AS fin, count(*) AS n FROM h GROUP BY colonne, classe",
)
def _(spark, folder):
    return explore.histogram(holes(spark, folder), NUMBERS)


@register(
    "histogram_by_class",
    _SQL_NUMBERS.replace("SELECT colonne, v FROM holes UNPIVOT", "SELECT s, colonne, v FROM holes UNPIVOT")
    + ", r AS (SELECT colonne, min(v) AS lo, max(v) AS hi, least(30, count(DISTINCT v)) AS k FROM long GROUP BY colonne), "
    "h AS (SELECT colonne, s, lo, (hi - lo) / k AS w, CAST(least(floor((v - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS classe FROM long JOIN r USING (colonne)) "
    f"SELECT colonne, s, classe, {R('any_value(lo + classe * w)')} AS debut, {R('any_value(lo + (classe + 1) * w)')} AS fin, count(*) AS n FROM h GROUP BY colonne, s, classe",
)
def _(spark, folder):
    return explore.histogram(holes(spark, folder), NUMBERS, by="s")


@register(
    "box_stats",
    _SQL_NUMBERS + _SQL_BOUNDS + f" SELECT colonne, {R('any_value(q1)')} AS q1, {R('any_value(q2)')} AS mediane, {R('any_value(q3)')} AS q3, "
    f"{R('least(any_value(q1), min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)))')} AS moustache_basse, {R('greatest(any_value(q3), max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)))')} AS moustache_haute, "
    "count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_extremes FROM long JOIN b USING (colonne) GROUP BY colonne",
)
def _(spark, folder):
    return explore.box_stats(holes(spark, folder), NUMBERS)


@register(
    "row_completeness",
    f"WITH {SQL_HOLES} SELECT l_orderkey, (CASE WHEN q IS NULL THEN 0 ELSE 1 END) + (CASE WHEN p IS NULL THEN 0 ELSE 1 END) + (CASE WHEN t IS NULL THEN 0 ELSE 1 END) "
    "+ (CASE WHEN f IS NULL THEN 0 ELSE 1 END) AS n_remplies FROM holes",
)
def _(spark, folder):
    return explore.row_completeness(holes(spark, folder), ["q", "p", "t", "f"], "l_orderkey")


@register(
    "target_overlap",
    f"SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\", "
    f"(SELECT {R('avg(CASE WHEN (o_orderstatus = chr(70)) = (o_totalprice < 200000) THEN 1.0 ELSE 0.0 END)')} FROM orders) AS part_concordante FROM orders GROUP BY 1",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "y", (F.col("o_orderstatus") == "F").cast("int")
    )
    return explore.target_overlap(orders, "y", "o_totalprice", 200000.0)


# --- missing values ---------------------------------------------------------------------------


@register(
    "missing_overview",
    f"WITH {SQL_HOLES}, c AS (SELECT colonne, n FROM (SELECT count(*) - count(q) AS q, count(*) - count(p) AS p, count(*) - count(t) AS t, count(*) - count(f) AS f, count(*) - count(s) AS s FROM holes) UNPIVOT (n FOR colonne IN (q, p, t, f, s))) "
    f"SELECT colonne, n AS n_manquants, {R('100.0 * n / (SELECT count(*) FROM holes)')} AS \"part_%\", CASE colonne WHEN 'q' THEN 'volume' WHEN 'f' THEN 'retour' END AS theme FROM c WHERE n > 0",
)
def _(spark, folder):
    return missing.missing_overview(
        holes(spark, folder), ["q", "p", "t", "f", "s"], {"q": "volume", "f": "retour"}
    )


_SQL_EXPECTED = " UNION ALL ".join(
    f"SELECT {a + b + c} AS k, {'' if a else '1-'}rq AS x, {'' if b else '1-'}rt AS y, {'' if c else '1-'}rf AS z FROM rates"
    for a in (0, 1)
    for b in (0, 1)
    for c in (0, 1)
)


@register(
    "missing_per_row",
    f"WITH {SQL_HOLES}, rates AS (SELECT 1 - count(q) / count(*) AS rq, 1 - count(t) / count(*) AS rt, 1 - count(f) / count(*) AS rf FROM holes), "
    f"law AS ({_SQL_EXPECTED}), e AS (SELECT k, round_even(sum(x * y * z) * (SELECT count(*) FROM holes), 0) AS n FROM law GROUP BY k), "
    "o AS (SELECT (CASE WHEN q IS NULL THEN 1 ELSE 0 END) + (CASE WHEN t IS NULL THEN 1 ELSE 0 END) + (CASE WHEN f IS NULL THEN 1 ELSE 0 END) AS k, count(*) AS n FROM holes GROUP BY 1) "
    "SELECT CAST(k AS INTEGER) AS nb_colonnes_manquantes, coalesce(o.n, 0) AS n_lignes_observe, CAST(e.n AS BIGINT) AS n_lignes_attendu FROM e LEFT JOIN o USING (k) WHERE coalesce(o.n, 0) > 0 OR e.n > 0",
)
def _(spark, folder):
    return missing.missing_per_row(holes(spark, folder), ["q", "t", "f", "s"])


_SQL_GAP = " UNION ALL ".join(
    f"SELECT '{c}' AS colonne, count(*) FILTER ({c} IS NULL) AS n_manquants, 100.0 * avg(y) FILTER ({c} IS NULL) AS a, 100.0 * avg(y) FILTER ({c} IS NOT NULL) AS b FROM holes"
    for c in ("q", "t", "f")
)


@register(
    "missing_vs_target",
    f"WITH {SQL_HOLES}, g AS ({_SQL_GAP}) SELECT colonne, n_manquants, {R('a')} AS \"taux_si_manquant_%\", {R('b')} AS \"taux_si_present_%\", {R('a - b')} AS ecart_pt FROM g",
)
def _(spark, folder):
    return missing.missing_gaps(holes(spark, folder), ["q", "t", "f", "s"], "y")


@register("missing_vs_target_noise")
def _(spark, folder):
    return missing.missing_vs_target(holes(spark, folder), ["q", "t", "f", "s"], "y")


@register("missing_mechanism")
def _(spark, folder):
    return missing.missing_mechanism(holes(spark, folder), ["q", "t"], ["q", "t", "d", "f", "s"])


@register(
    "nullity_correlation",
    f"WITH {SQL_HOLES} SELECT 'q' AS variable_1, 't' AS variable_2, {R('corr(CASE WHEN q IS NULL THEN 1 ELSE 0 END, CASE WHEN t IS NULL THEN 1 ELSE 0 END)')} AS valeur FROM holes UNION ALL "
    f"SELECT 'q', 'f', {R('corr(CASE WHEN q IS NULL THEN 1 ELSE 0 END, CASE WHEN f IS NULL THEN 1 ELSE 0 END)')} FROM holes UNION ALL "
    f"SELECT 't', 'f', {R('corr(CASE WHEN t IS NULL THEN 1 ELSE 0 END, CASE WHEN f IS NULL THEN 1 ELSE 0 END)')} FROM holes",
)
def _(spark, folder):
    return missing.nullity_correlation(holes(spark, folder), ["q", "t", "f", "s"])


# --- associations -----------------------------------------------------------------------------


def _sql_cells(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, coalesce(CAST({a} AS VARCHAR), '(manquant)') AS a, "
        f"coalesce(CAST({b} AS VARCHAR), '(manquant)') AS b, count(*) AS n FROM holes GROUP BY 3, 4"
        for a, b in pairs
    )


def _sql_v(pairs) -> str:
    return (
        f"cells AS ({_sql_cells(pairs)}), m AS (SELECT *, sum(n) OVER (PARTITION BY variable_1, variable_2, a) AS na, "
        "sum(n) OVER (PARTITION BY variable_1, variable_2, b) AS nb FROM cells), "
        "v AS (SELECT variable_1, variable_2, count(DISTINCT a) AS n_1, count(DISTINCT b) AS n_2, "
        "CASE WHEN least(count(DISTINCT a), count(DISTINCT b)) < 2 THEN 0 ELSE "
        "sqrt(greatest(sum(CAST(n AS DOUBLE) * n / na / nb) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) END AS valeur "
        "FROM m GROUP BY variable_1, variable_2)"
    )


def _sql_groups(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, coalesce(CAST({b} AS VARCHAR), '(manquant)') AS g, "
        f"CAST({a} AS DOUBLE) AS x, avg({a}) OVER () AS m FROM holes"
        for a, b in pairs
    )


def _sql_eta(pairs) -> str:
    return (
        f"rows_ AS ({_sql_groups(pairs)}), per AS (SELECT variable_1, variable_2, g, count(x) AS n, avg(x) AS gm, any_value(m) AS m, "
        "sum((x - m) * (x - m)) AS ss FROM rows_ GROUP BY ALL), "
        "eta AS (SELECT variable_1, variable_2, count(*) AS n_2, CASE WHEN count(*) < 2 OR sum(ss) = 0 THEN 0 ELSE sqrt(sum(n * (gm - m) * (gm - m)) / sum(ss)) END AS valeur, "
        "max(gm) - min(gm) AS etendue FROM per GROUP BY 1, 2)"
    )


def _sql_rho(pairs) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM holes WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    )
    return f"ranks AS ({parts}), rho AS (SELECT variable_1, variable_2, corr(ra, rb) AS valeur FROM ranks GROUP BY 1, 2)"


_NOMINAL_PAIRS = association.upper_pairs(NOMINALS)
_NUMBER_PAIRS = association.upper_pairs(NUMBERS)
_CROSS_PAIRS = [(a, b) for a in NUMBERS for b in NOMINALS]


@register("contingency", f"WITH {SQL_HOLES} SELECT * FROM ({_sql_cells(_NOMINAL_PAIRS)})")
def _(spark, folder):
    return association.contingency(holes(spark, folder), _NOMINAL_PAIRS)


@register(
    "cramers_v",
    f"WITH {SQL_HOLES}, {_sql_v([('g', 'y')])} SELECT variable_1, variable_2, n_1, n_2, {R('valeur')} AS valeur FROM v",
)
def _(spark, folder):
    return association.cramers_v(holes(spark, folder), "g", "y")


@register(
    "cramers_v_matrix",
    f"WITH {SQL_HOLES}, {_sql_v(_NOMINAL_PAIRS)}, b AS (SELECT variable_1, variable_2, valeur FROM v UNION ALL SELECT variable_2, variable_1, valeur FROM v "
    f"UNION ALL SELECT x, x, 1.0 FROM (VALUES ('f'), ('s'), ('g')) t(x)) SELECT variable_1, variable_2, {R('valeur')} AS valeur FROM b",
)
def _(spark, folder):
    return association.square_matrix(association.cramers_v_matrix(holes(spark, folder), NOMINALS))


@register(
    "group_spread",
    f"WITH {SQL_HOLES}, {_sql_eta(_CROSS_PAIRS)} SELECT variable_1, variable_2, {R('etendue')} AS valeur FROM eta",
)
def _(spark, folder):
    return association.group_spread_pairs(holes(spark, folder), _CROSS_PAIRS)


@register(
    "correlation_ratio",
    f"WITH {SQL_HOLES}, {_sql_eta(_CROSS_PAIRS)} SELECT variable_1, variable_2, n_2, {R('valeur')} AS valeur FROM eta",
)
def _(spark, folder):
    return association.correlation_ratio_pairs(holes(spark, folder), _CROSS_PAIRS)


@register(
    "correlation_matrix",
    f"WITH {SQL_HOLES}, {_sql_rho(_NUMBER_PAIRS)} SELECT variable_1, variable_2, {R('valeur')} AS valeur FROM rho",
)
def _(spark, folder):
    return association.correlation_matrix(holes(spark, folder), NUMBERS)


@register(
    "correlation_matrix_pearson",
    f"WITH {SQL_HOLES} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, {R(f'corr({a}, {b})')} AS valeur FROM holes"
        for a, b in _NUMBER_PAIRS
    ),
)
def _(spark, folder):
    return association.correlation_matrix(holes(spark, folder), NUMBERS, "pearson")


@register(
    "correlation_pairs",
    f"WITH {SQL_HOLES}, {_sql_rho(_NUMBER_PAIRS)} SELECT variable_1, variable_2, {R('valeur')} AS valeur FROM rho WHERE abs(valeur) >= 0.002",
)
def _(spark, folder):
    return association.correlation_pairs(holes(spark, folder), NUMBERS, threshold=0.002)


@register(
    "association_matrix",
    f"WITH {SQL_HOLES}, {_sql_rho(_NUMBER_PAIRS)}, {_sql_eta(_CROSS_PAIRS)}, {_sql_v(_NOMINAL_PAIRS)} "
    f"SELECT variable_1, variable_2, 'correlation' AS mesure, {R('coalesce(abs(valeur), 0)')} AS valeur FROM rho UNION ALL "
    f"SELECT variable_1, variable_2, 'eta', {R('valeur')} FROM eta UNION ALL SELECT variable_1, variable_2, 'v_cramer', {R('valeur')} FROM v",
)
def _(spark, folder):
    return association.association_matrix(holes(spark, folder), NUMBERS, NOMINALS)


@register(
    "categorical_association",
    f"WITH {SQL_HOLES}, {_sql_v([('f', 'y'), ('g', 'y')])} SELECT variable_1 AS colonne, n_1 AS n_groupes, {R('valeur')} AS v_cramer FROM v",
)
def _(spark, folder):
    found = association.categorical_association(holes(spark, folder), ["f", "g"], "y")
    return found.select("colonne", "n_groupes", "v_cramer")


@register(
    "association_with",
    f"WITH {SQL_HOLES}, {_sql_v([('f', 's'), ('g', 's')])}, {_sql_eta([('q', 's'), ('p', 's')])} "
    f"SELECT variable_1 AS colonne, 'catégorielle' AS type, 'V de Cramér' AS mesure, {R('valeur')} AS association FROM v UNION ALL "
    f"SELECT variable_1, 'numérique', 'η', {R('valeur')} FROM eta",
)
def _(spark, folder):
    found = association.association_with(holes(spark, folder), ["f", "g", "q", "p"], "s")
    return found.select("colonne", "type", "mesure", "association")


@register("association_with_noise")
def _(spark, folder):
    return association.association_with(holes(spark, folder), ["f", "g", "q", "p"], "s")


@register("categorical_association_noise")
def _(spark, folder):
    return association.categorical_association(holes(spark, folder), ["f", "g"], "y")


@register("cramers_v_noise")
def _(spark, folder):
    return noise.cramers_v_noise(holes(spark, folder), "f", "g")


@register("correlation_ratio_noise")
def _(spark, folder):
    return noise.correlation_ratio_noise(holes(spark, folder), "p", "f")


@register(
    "permutation_summary",
    # One draw per cell of two small domains: as bounded as permutations are.
    "WITH d AS (SELECT l_returnflag AS variable_1, 'x' AS variable_2, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag, l_linenumber, l_discount), "
    "o AS (SELECT variable_1, variable_2, avg(v) AS valeur FROM d GROUP BY ALL) "
    f"SELECT o.variable_1, o.variable_2, {R('valeur')} AS valeur, {R('quantile_cont(v, 0.95)')} AS bruit, "
    f"{R('(1 + count(*) FILTER (v >= valeur - 1e-9 * valeur)) / (1 + count(*))')} AS p_permutation FROM d JOIN o USING (variable_1, variable_2) GROUP BY o.variable_1, o.variable_2, valeur",
)
def _(spark, folder):
    cells = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber", "l_discount")
    draws = cells.agg(F.avg("l_extendedprice").alias("valeur")).select(
        F.col("l_returnflag").alias("variable_1"), F.lit("x").alias("variable_2"), "valeur"
    )
    observed = draws.groupBy("variable_1", "variable_2").agg(F.avg("valeur").alias("valeur"))
    return noise.permutation_summary(draws, observed)


@register(
    "global_rank",
    _SQL_NUMBERS + f", f AS (SELECT colonne, v, count(*) AS n FROM long GROUP BY ALL) SELECT colonne, {R('v')} AS valeur, n, "
    f"{R('sum(n) OVER (PARTITION BY colonne ORDER BY v) - n + (n + 1) / 2')} AS rang FROM f",
)
def _(spark, folder):
    return average_ranks(number_frequencies(holes(spark, folder), NUMBERS), ["colonne"])


@register(
    "exact_quantiles",
    _SQL_NUMBERS + f" SELECT colonne, {R('quantile_cont(v, 0.01)')} AS q01, {R('quantile_cont(v, 0.5)')} AS q50, {R('quantile_cont(v, 0.999)')} AS q999 FROM long GROUP BY colonne",
)
def _(spark, folder):
    found = quantiles(long_numbers(holes(spark, folder), NUMBERS), [0.01, 0.5, 0.999])
    q = F.col("quantiles")
    return found.select("colonne", q[0].alias("q01"), q[1].alias("q50"), q[2].alias("q999"))


@register(
    "noise_law",
    "WITH c AS (SELECT count(DISTINCT l_returnflag) AS r, count(DISTINCT l_linestatus) AS s, count(DISTINCT l_linenumber) AS k, count(*) AS n FROM lineitem) "
    f"SELECT 'l_returnflag' AS variable_1, 'l_linestatus' AS variable_2, 'v_cramer' AS mesure, 500 AS n_tirages, {R('(r - 1) * (s - 1) / (n - 1)')} AS attendu, TRUE AS moyenne_conforme FROM c "
    f"UNION ALL SELECT 'l_linenumber', 'l_returnflag', 'v_cramer', 500, {R('(k - 1) * (r - 1) / (n - 1)')}, TRUE FROM c "
    f"UNION ALL SELECT 'l_extendedprice', 'l_returnflag', 'eta', 500, {R('(r - 1) / (n - 1)')}, TRUE FROM c",
)
def _(spark, folder):
    """The mean of 500 draws against its closed form: (r - 1)(c - 1)/(n - 1) for Cramér, (g - 1)/(n - 1) for η²."""
    items = table(spark, folder, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string"))
    size = items.agg(
        *[F.count_distinct(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")],
        F.count(F.lit(1)).alias("n"),
    ).first()
    rows, lines, marks, numbers = size["n"], size["l_returnflag"], size["l_linestatus"], size["l_linenumber"]
    wanted = {
        ("v_cramer", "l_returnflag", "l_linestatus"): ((lines - 1) * (marks - 1) / (rows - 1), min(lines, marks) - 1),
        ("v_cramer", "l_linenumber", "l_returnflag"): ((numbers - 1) * (lines - 1) / (rows - 1), min(lines, numbers) - 1),
        ("eta", "l_extendedprice", "l_returnflag"): ((lines - 1) / (rows - 1), 1),
    }
    parts = []
    for (kind, a, b), (mean, scale) in wanted.items():
        draws = noise.permutation_draws(items, [(a, b)], 500, 3, "v" if kind == "v_cramer" else "eta")
        square = F.col("valeur") * F.col("valeur") * scale
        parts.append(
            draws.groupBy("variable_1", "variable_2").agg(
                F.lit(kind).alias("mesure"),
                F.count(F.lit(1)).cast("int").alias("n_tirages"),
                F.lit(float(mean)).alias("attendu"),
                (F.abs(F.avg(square) - mean) < 5 * F.stddev(square) / 500**0.5).alias("moyenne_conforme"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

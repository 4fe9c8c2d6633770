"""Registered queries: metrics, drift, contract, scoring, models, windowed alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import contract as C
from lodestat.operators import drift, isotonic, linear, metrics, modeling, protocol, scoring
from lodestat.plans.registry import (
    SQL_HOLES,
    SQL_SCORED,
    SQL_SIDES,
    R,
    holes,
    register,
    scored,
    scratch,
    sides,
    table,
)
from lodestat.session import materialized
from lodestat.sources import files, layers
from lodestat.streaming import alerts
from lodestat.streaming.scoring import score_stream

# Distinct scores with what lies at or above each.
_SQL_STEPS = (
    f"WITH {SQL_SCORED}, c AS (SELECT p AS score, CAST(sum(y) AS BIGINT) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY 1), "
    "s AS (SELECT *, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg, sum(pos) OVER (ORDER BY score DESC) AS tp, "
    "sum(neg) OVER (ORDER BY score DESC) AS fp, sum(neg) OVER (ORDER BY score) - neg AS below FROM c)"
)
_SQL_AUC = "sum(CAST(pos AS DOUBLE) * (below + neg / 2)) / any_value(CAST(n_pos AS DOUBLE) * n_neg)"
_SQL_AP = "sum(pos / n_pos * (tp / (tp + fp)))"


@register("roc_auc", _SQL_STEPS + f" SELECT {R(_SQL_AUC)} AS roc_auc FROM s")
def _(spark, folder):
    return metrics.roc_auc(scored(spark, folder), "y", "p")


@register("average_precision", _SQL_STEPS + f" SELECT {R(_SQL_AP)} AS pr_auc FROM s")
def _(spark, folder):
    return metrics.average_precision(scored(spark, folder), "y", "p")


@register("brier", f"WITH {SQL_SCORED} SELECT {R('avg((p - y) * (p - y))')} AS brier FROM scored")
def _(spark, folder):
    return metrics.brier(scored(spark, folder), "y", "p")


@register(
    "classification_metrics",
    _SQL_STEPS + f" SELECT {R(_SQL_AUC)} AS roc_auc, {R(_SQL_AP)} AS pr_auc, {R('(SELECT avg((p - y) * (p - y)) FROM scored)')} AS brier FROM s",
)
def _(spark, folder):
    return metrics.classification_metrics(scored(spark, folder), "y", "p")


@register(
    "regression_metrics",
    f"SELECT l_returnflag, {R('avg(abs(l_quantity * 1000 - l_extendedprice))')} AS mae, {R('sqrt(avg(pow(l_quantity * 1000 - l_extendedprice, 2)))')} AS rmse, "
    f"{R('1 - avg(pow(l_quantity * 1000 - l_extendedprice, 2)) / var_pop(l_extendedprice)')} AS r2 FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return metrics.regression_metrics(items, "l_extendedprice", "guess", ["l_returnflag"])


@register(
    "roc_curve",
    _SQL_STEPS + f" SELECT {R('score')} AS seuil, {R('fp / n_neg')} AS fpr, {R('tp / n_pos')} AS tpr FROM s UNION ALL SELECT NULL, 0.0, 0.0",
)
def _(spark, folder):
    # The infinite threshold of the origin is shown as NULL: comparisons of files have no infinity.
    curve = metrics.roc_curve(scored(spark, folder), "y", "p")
    return curve.withColumn("seuil", F.when(F.col("seuil") < float("inf"), F.col("seuil")))


@register(
    "pr_curve",
    _SQL_STEPS + f" SELECT {R('score')} AS seuil, {R('tp / n_pos')} AS rappel, {R('tp / (tp + fp)')} AS precision, {R('n_pos / (n_pos + n_neg)')} AS prevalence FROM s",
)
def _(spark, folder):
    return metrics.pr_curve(scored(spark, folder), "y", "p")


_SQL_EDGES = " + ".join(
    f"(CASE WHEN (SELECT quantile_cont(p, {i / 10}) FROM scored) < p THEN 1 ELSE 0 END)"
    for i in range(1, 10)
)


@register(
    "calibration_curve",
    f"WITH {SQL_SCORED} SELECT CAST({_SQL_EDGES} AS INTEGER) AS classe, count(*) AS n, {R('avg(p)')} AS moyenne_predite, {R('avg(y)')} AS frequence_observee FROM scored GROUP BY 1",
)
def _(spark, folder):
    return metrics.calibration_curve(scored(spark, folder), "y", "p")


_SQL_CONFUSION = (
    "count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, "
    "count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp"
)


@register("confusion_counts", f"WITH {SQL_SCORED} SELECT {_SQL_CONFUSION} FROM scored")
def _(spark, folder):
    return metrics.confusion_counts(scored(spark, folder), "y", "p", 0.5)


@register(
    "threshold_table",
    f"WITH {SQL_SCORED}, t AS (SELECT CAST(i AS DOUBLE) / 20 AS seuil FROM range(1, 20) r(i)), "
    "c AS (SELECT seuil, count(*) FILTER (p >= seuil) AS n_alertes, count(*) FILTER (p >= seuil AND y = 1) AS tp, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM t, scored GROUP BY seuil), "
    "r AS (SELECT *, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS rappel, CASE WHEN n_alertes > 0 THEN tp / n_alertes ELSE 0 END AS precision FROM c) "
    f"SELECT {R('seuil')} AS seuil, {R('rappel')} AS rappel, {R('precision')} AS precision, {R('CASE WHEN 4 * precision + rappel > 0 THEN 5 * precision * rappel / (4 * precision + rappel) ELSE 0 END')} AS f2, "
    f"n_alertes, tp, pos - tp AS \"n_FN\", {R('n_alertes / n')} AS pct_promo FROM r",
)
def _(spark, folder):
    return metrics.threshold_table(scored(spark, folder), "y", "p")


@register(
    "pick_threshold",
    _SQL_STEPS + f" SELECT 'rappel' AS politique, {R('coalesce(max(score) FILTER (tp / n_pos >= 0.8), min(score))')} AS seuil FROM s UNION ALL "
    f"SELECT 'capacite_n', {R('max(score) FILTER (tp + fp >= 100)')} FROM s UNION ALL "
    f"SELECT 'capacite_pct', {R('max(score) FILTER (tp + fp >= round_even(0.1 * (n_pos + n_neg), 0))')} FROM s",
)
def _(spark, folder):
    rows = scored(spark, folder)
    policies = {
        "rappel": {"recall_target": 0.8},
        "capacite_n": {"capacity_n": 100},
        "capacite_pct": {"capacity_pct": 0.1},
    }
    parts = [
        metrics.pick_threshold(rows, "y", "p", **policy).select(
            F.lit(name).alias("politique"), "seuil"
        )
        for name, policy in policies.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "capacity_threshold",
    f"WITH {SQL_SCORED} SELECT {R('(SELECT p FROM scored ORDER BY p DESC LIMIT 1 OFFSET 49)')} AS seuil",
)
def _(spark, folder):
    return metrics.capacity_threshold(scored(spark, folder), "p", 50)


_SQL_POINT = (
    "pt AS (SELECT tp / (tp + fn) AS r, tp / (tp + fp) AS q FROM (SELECT " + _SQL_CONFUSION + " FROM scored))"
)


@register(
    "point_metrics",
    f"WITH {SQL_SCORED}, {_SQL_POINT} SELECT {R('r')} AS rappel, {R('q')} AS precision, {R('2 * q * r / (q + r)')} AS f1, {R('5 * q * r / (4 * q + r)')} AS f2 FROM pt",
)
def _(spark, folder):
    return metrics.point_metrics(scored(spark, folder), "y", "p", 0.5)


@register(
    "alert_volumes",
    f"WITH {SQL_SCORED}, {_SQL_POINT} SELECT {R('250.0')} AS n_attendus, {R('r * 250')} AS n_detectes, {R('250 - r * 250')} AS n_manques, {R('r * 250 / q')} AS n_signales FROM pt",
)
def _(spark, folder):
    points = metrics.point_metrics(scored(spark, folder), "y", "p", 0.5)
    return metrics.alert_volumes(points, 0.25, 1000)


@register(
    "fairness_audit",
    f"WITH {SQL_SCORED}, g AS (SELECT 'ensemble' AS attribut, CAST(NULL AS VARCHAR) AS groupe, y, p FROM scored UNION ALL "
    "SELECT 'o_orderpriority', o_orderpriority, y, p FROM scored UNION ALL SELECT 'jour', CAST(isodow(o_orderdate) AS VARCHAR), y, p FROM scored) "
    f"SELECT attribut, groupe, count(*) AS n, count(*) FILTER (y = 1) AS positifs, {R('count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0)')} AS rappel, "
    f"{R('count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (p >= 0.5), 0)')} AS precision FROM g GROUP BY ALL",
)
def _(spark, folder):
    rows = scored(spark, folder).withColumn(
        "jour", (F.weekday("o_orderdate") + 1).cast("string")
    )
    return metrics.fairness_audit(rows, "y", "p", 0.5, ["o_orderpriority", "jour"])


@register(
    "rare_subgroups",
    f"WITH {SQL_SCORED}, g AS (SELECT CAST(o_custkey % 7 * (o_custkey % 3) AS VARCHAR) AS groupe, y, p FROM scored) "
    "SELECT 'profil' AS attribut, groupe, count(*) AS n FROM g GROUP BY groupe HAVING count(*) / (SELECT count(*) FROM g) < 0.05",
)
def _(spark, folder):
    rows = scored(spark, folder).withColumn(
        "profil", (F.col("o_custkey") % 7 * (F.col("o_custkey") % 3)).cast("string")
    )
    audit = metrics.fairness_audit(rows, "y", "p", 0.5, ["profil"])
    return metrics.rare_subgroups(audit).select("attribut", "groupe", "n")


# --- drift ------------------------------------------------------------------------------------

_DRIFT_NUMBERS = ["o_totalprice", "o_custkey"]
_SQL_PSI_TERM = "(a - e) * ln(a / e)"


def _sql_psi_number(column: str) -> str:
    edges = " + ".join(
        f"(CASE WHEN (SELECT quantile_cont({column}, {i / 10}) FROM ref) <= {column} THEN 1 ELSE 0 END)"
        for i in range(1, 10)
    )
    return (
        f"SELECT '{column}' AS colonne, sum({_SQL_PSI_TERM}) AS psi FROM (SELECT greatest(coalesce(r.n, 0) / (SELECT count(*) FROM ref), 1e-6) AS e, "
        f"greatest(coalesce(c.n, 0) / (SELECT count(*) FROM cur), 1e-6) AS a FROM (SELECT {edges} AS k, count(*) AS n FROM ref GROUP BY 1) r "
        f"FULL JOIN (SELECT {edges} AS k, count(*) AS n FROM cur GROUP BY 1) c USING (k))"
    )


def _sql_psi_category(column: str) -> str:
    return (
        f"SELECT '{column}' AS colonne, sum({_SQL_PSI_TERM}) AS psi FROM (SELECT coalesce(r.n / (SELECT count(*) FROM ref), 1e-6) AS e, "
        f"coalesce(c.n / (SELECT count(*) FROM cur), 1e-6) AS a FROM (SELECT {column} AS k, count(*) AS n FROM ref GROUP BY 1) r "
        f"FULL JOIN (SELECT {column} AS k, count(*) AS n FROM cur GROUP BY 1) c USING (k))"
    )


def _sql_ks(column: str) -> str:
    return (
        f"SELECT '{column}' AS colonne, max(abs(fr - fc)) AS ks FROM (SELECT sum(r) OVER (ORDER BY v) / (SELECT count(*) FROM ref) AS fr, "
        f"sum(c) OVER (ORDER BY v) / (SELECT count(*) FROM cur) AS fc FROM (SELECT v, sum(r) AS r, sum(c) AS c FROM "
        f"(SELECT {column} AS v, 1 AS r, 0 AS c FROM ref UNION ALL SELECT {column}, 0, 1 FROM cur) GROUP BY v))"
    )


def _sql_shift(column: str) -> str:
    return (
        f"SELECT '{column}' AS colonne, ((SELECT avg({column}) FROM cur) - avg({column})) / stddev_pop({column}) AS shift FROM ref"
    )


_SQL_PSI_NUMBERS = " UNION ALL ".join(map(_sql_psi_number, _DRIFT_NUMBERS))
_SQL_KS = " UNION ALL ".join(map(_sql_ks, _DRIFT_NUMBERS))
_SQL_SHIFT = " UNION ALL ".join(map(_sql_shift, _DRIFT_NUMBERS))
_SQL_VERDICT = "CASE WHEN psi >= 0.25 THEN 'alerte' WHEN psi >= 0.1 THEN 'à surveiller' ELSE 'stable' END"


@register(
    "psi_numeric",
    f"WITH {SQL_SIDES}, x AS ({_SQL_PSI_NUMBERS}) SELECT colonne, {R('psi')} AS psi FROM x",
)
def _(spark, folder):
    return drift.psi_numeric(*sides(spark, folder), _DRIFT_NUMBERS)


@register(
    "psi_categorical",
    f"WITH {SQL_SIDES}, x AS ({_sql_psi_category('o_orderpriority')} UNION ALL {_sql_psi_category('o_orderstatus')}) SELECT colonne, {R('psi')} AS psi FROM x",
)
def _(spark, folder):
    return drift.psi_categorical(*sides(spark, folder), ["o_orderpriority", "o_orderstatus"])


@register(
    "ks_two_sample",
    f"WITH {SQL_SIDES}, x AS ({_SQL_KS}) SELECT colonne, {R('ks')} AS ks_statistic FROM x",
)
def _(spark, folder):
    return drift.ks_two_sample(*sides(spark, folder), _DRIFT_NUMBERS).drop("ks_pvalue")


@register(
    "mean_shift",
    f"WITH {SQL_SIDES}, x AS ({_SQL_SHIFT}) SELECT colonne, {R('shift')} AS shift_std FROM x",
)
def _(spark, folder):
    return drift.mean_shift(*sides(spark, folder), _DRIFT_NUMBERS)


_SQL_DRIFT = (
    f"WITH {SQL_SIDES}, x AS ({_SQL_PSI_NUMBERS}), k AS ({_SQL_KS}), m AS ({_SQL_SHIFT}), d AS ("
    "SELECT x.colonne AS variable, psi, ks, shift FROM x JOIN k USING (colonne) JOIN m USING (colonne) UNION ALL "
    f"SELECT colonne, psi, NULL, NULL FROM ({_sql_psi_category('o_orderpriority')}))"
)


@register(
    "assess_drift",
    _SQL_DRIFT + f" SELECT variable, {R('psi')} AS psi, {R('ks')} AS ks_statistic, {R('shift')} AS shift_std, {_SQL_VERDICT} AS verdict FROM d",
)
def _(spark, folder):
    reference, current = sides(spark, folder)
    found = drift.assess_drift(reference, current, _DRIFT_NUMBERS, ["o_orderpriority"])
    return drift.campaign_drift_table(found).drop("ks_pvalue")


@register(
    "campaign_verdict",
    _SQL_DRIFT + f" SELECT TRUE AS mesurable, CAST(NULL AS VARCHAR) AS motif, {R('max(psi)')} AS psi_max, (SELECT {_SQL_VERDICT} FROM (SELECT max(psi) AS psi FROM d)) AS verdict FROM d",
)
def _(spark, folder):
    reference, current = sides(spark, folder)
    found = drift.assess_drift(reference, current, _DRIFT_NUMBERS, ["o_orderpriority"])
    return drift.campaign_verdict(found, current)


@register(
    "deidentified_reference",
    "SELECT 'o_orderpriority' AS colonne, o_orderpriority AS valeur, count(*) AS n FROM orders GROUP BY ALL UNION ALL "
    "SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY ALL",
)
def _(spark, folder):
    from lodestat.operators.frequencies import value_frequencies

    columns = ["o_orderpriority", "o_orderstatus", "o_custkey"]
    shuffled = drift.deidentified_reference(
        table(spark, folder, "orders"), columns, "o_orderkey", 7
    )
    return value_frequencies(shuffled, columns)


# --- contract and scoring ---------------------------------------------------------------------

CONTRACT = C.Contract(
    fields=(
        C.Field("o_custkey", "int", True, 10, 1400),
        C.Field("o_totalprice", "float", True, 1000, 450000),
        C.Field("o_orderpriority", "text", True, categories=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
        C.Field("rendus", "int", True, 0),
        C.Field("total", "int", True, 1),
        C.Field("avis", "float", False, 1, 5),
    ),
    at_most=(("rendus", "total"),),
    references=("o_orderkey",),
)
_CAMPAIGN = """
  o_orderkey, o_custkey, o_totalprice, o_orderpriority,
  o_orderkey % 7 AS rendus, o_orderkey % 9 AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 END AS avis
"""
# Reasons of refusal in the order of the contract.
_SQL_FIELDS = {
    "o_custkey": [("o_custkey < 10", "doit être ≥ 10"), ("o_custkey > 1400", "doit être ≤ 1400")],
    "o_totalprice": [("o_totalprice < 1000", "doit être ≥ 1000"), ("o_totalprice > 450000", "doit être ≤ 450000")],
    "o_orderpriority": [("o_orderpriority = '4-NOT SPECIFIED'", "doit être parmi : 1-URGENT, 2-HIGH, 3-MEDIUM, 5-LOW")],
    "total": [("total < 1", "doit être ≥ 1")],
    "avis": [("avis < 1", "doit être ≥ 1"), ("avis > 5", "doit être ≤ 5")],
}
_SQL_REASONS = (
    "concat_ws(' | ', "
    + ", ".join(
        "CASE " + " ".join(f"WHEN {test} THEN '{name} : {text}'" for test, text in rules) + " END"
        for name, rules in _SQL_FIELDS.items()
    )
    + ")"
)
_SQL_JUDGED = (
    f"WITH campaign AS (SELECT {_CAMPAIGN} FROM orders), f AS (SELECT *, {_SQL_REASONS} AS m FROM campaign), "
    "judged AS (SELECT * EXCLUDE (m), CASE WHEN m <> '' THEN m WHEN rendus > total THEN '_modele : rendus > total' ELSE '' END AS motifs FROM f)"
)


def campaign(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("_orders_campaign")
    return spark.sql(f"SELECT {_CAMPAIGN} FROM _orders_campaign")


def _rate(valid: DataFrame) -> DataFrame:
    return valid.withColumns(
        {
            "_p": F.col("o_custkey").cast("double") / 1500,
            "_note": F.col("o_totalprice") / 15000 - 2,
        }
    )


def _cohort(spark, folder):
    return scoring.score_cohort(
        campaign(spark, folder), CONTRACT, _rate, threshold=0.6, origin="appel"
    )


_SQL_SCORES = (
    _SQL_JUDGED + ", s AS (SELECT CAST(o_orderkey AS VARCHAR) AS reference, CAST(o_custkey AS DOUBLE) / 1500 AS p, "
    "greatest(least(o_totalprice / 15000 - 2, 20), 0) AS note FROM judged WHERE motifs = '')"
)


@register("validate_rows", _SQL_JUDGED + " SELECT o_orderkey, motifs FROM judged")
def _(spark, folder):
    judged = C.validate_rows(campaign(spark, folder), CONTRACT)
    reasons = F.transform("erreurs", lambda e: F.concat(e["champ"], F.lit(" : "), e["message"]))
    return judged.select("o_orderkey", F.array_join(reasons, " | ").alias("motifs"))


@register(
    "schema_report",
    "SELECT colonne, 'absente' AS statut, CAST(NULL AS BIGINT) AS n_remplies FROM (VALUES ('rendus'), ('total'), ('avis')) t(colonne) "
    "UNION ALL SELECT 'o_orderstatus', 'inconnue', count(o_orderstatus) FROM orders UNION ALL SELECT 'o_orderdate', 'inconnue', count(o_orderdate) FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    counts = orders.agg(*[F.count(c).alias(c) for c in orders.columns]).unpivot([], orders.columns, "colonne", "n_remplies")
    return C.schema_report(orders, CONTRACT).join(counts, "colonne", "left")


@register(
    "refusals_by_field",
    _SQL_JUDGED + ", x AS (SELECT split_part(unnest(string_split(motifs, ' | ')), ' : ', 1) AS champ FROM judged WHERE motifs <> '') "
    "SELECT champ, count(x.champ) AS n FROM (SELECT unnest(['o_custkey','o_totalprice','o_orderpriority','rendus','total','avis','_modele']) AS champ) "
    "LEFT JOIN x USING (champ) GROUP BY champ HAVING champ <> '_modele' OR count(x.champ) > 0",
)
def _(spark, folder):
    judged = C.validate_rows(campaign(spark, folder), CONTRACT)
    return C.refusals_by_field(judged, CONTRACT)


@register(
    "score_batch",
    _SQL_SCORES + f" SELECT reference, {R('p')} AS probability, {R('note')} AS moyenne_finale, p >= 0.6 AS signaled, {R('0.6')} AS seuil_applique, 'appel' AS provenance_seuil FROM s",
)
def _(spark, folder):
    done, _refused, _summary = _cohort(spark, folder)
    return done.select(
        "reference", "probability", "moyenne_finale", "signaled", "seuil_applique", "provenance_seuil"
    )


@register(
    "score_cohort",
    _SQL_JUDGED + " SELECT CAST(o_orderkey AS VARCHAR) AS reference, CASE WHEN motifs = '' THEN 'score' ELSE 'refuse' END AS statut FROM judged",
)
def _(spark, folder):
    done, bad, _summary = _cohort(spark, folder)
    return scoring.scored_union_refused(done, bad).select("reference", "statut")


@register(
    "cohort_summary",
    _SQL_SCORES + ", j AS (SELECT count(*) AS r FROM judged) SELECT r AS recus, count(*) AS scores, r - count(*) AS refuses, "
    f"{R('avg(CASE WHEN p >= 0.6 THEN 1.0 ELSE 0.0 END)')} AS part_signalee FROM s, j GROUP BY r",
)
def _(spark, folder):
    return _cohort(spark, folder)[2]


@register(
    "campaign_view",
    _SQL_SCORES + " SELECT reference FROM s WHERE contains(reference, '12') AND p >= 0.6",
)
def _(spark, folder):
    return scoring.campaign_view(_cohort(spark, folder)[0], "12", True).select("reference")


@register(
    "page_view",
    _SQL_SCORES + f" SELECT reference, {R('p')} AS probability FROM s ORDER BY p DESC NULLS LAST, reference LIMIT 25 OFFSET 50",
)
def _(spark, folder):
    done = _cohort(spark, folder)[0].select("reference", "probability")
    return scoring.page_view(done, [("probability", True), ("reference", False)], 2, 25)


@register(
    "write_scores",
    _SQL_SCORES + " SELECT reference, round_even(p, 4) + 0.0 AS probability, round_even(note, 2) + 0.0 AS moyenne_finale, p >= 0.6 AS signaled FROM s",
)
def _(spark, folder):
    path = scratch(spark)
    layers.write_scores(_cohort(spark, folder)[0], path)
    return spark.read.parquet(path)


@register(
    "export_campaign",
    _SQL_SCORES + " SELECT CAST(o_orderkey AS VARCHAR) AS reference, CASE WHEN motifs = '' THEN 'score' ELSE 'refuse' END AS statut, "
    "replace(printf('%.4f', round_even(s.p, 4) + 0.0), '.', ',') AS probability, replace(printf('%.2f', round_even(s.note, 2) + 0.0), '.', ',') AS moyenne_finale, "
    "CASE WHEN motifs = '' THEN CASE WHEN CAST(o_custkey AS DOUBLE) / 1500 >= 0.6 THEN 'oui' ELSE 'non' END END AS signale, nullif(motifs, '') AS motifs FROM judged LEFT JOIN s ON s.reference = CAST(o_orderkey AS VARCHAR)",
)
def _(spark, folder):
    path = scratch(spark)
    done, bad, _summary = _cohort(spark, folder)
    layers.export_campaign(scoring.scored_union_refused(done, bad), path)
    return files.read_text_table(spark, path, ";")


# A linear model written out: source variable → (coefficient, SQL of the encoded column).
_LINEAR = {
    "quantite": [(0.8, "(l_quantity - 25) / 14")],
    "remise": [(-0.5, "(l_discount - 0.05) / 0.03")],
    "taxe": [(0.3, "(l_tax - 0.04) / 0.025")],
    "ligne": [(0.2, "(l_linenumber - 4) / 2.0")],
    "retour": [
        (0.7, "CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END"),
        (-0.4, "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END"),
    ],
    "statut": [(0.1, "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END")],
    # A prime scale keeps the values away from ties of the sixth decimal.
    "prix": [(-0.25, "(l_extendedprice - 53000) / 28657")],
}
_THEMES = {"quantite": "volume", "ligne": "volume", "remise": "prix", "taxe": "prix", "prix": "prix"}
_SQL_TERM = {
    name: " + ".join(f"CAST({c} AS DOUBLE) * CAST({z} AS DOUBLE)" for c, z in pairs)
    for name, pairs in _LINEAR.items()
}
_SQL_THEME = {}
for _name in _LINEAR:
    _SQL_THEME.setdefault(_THEMES.get(_name, "autres"), []).append(f"({_SQL_TERM[_name]})")
_SQL_LOGIT = "CAST(-0.2 AS DOUBLE) + " + " + ".join(f"({t})" for t in _SQL_TERM.values())


def _terms():
    terms = {}
    for name, pairs in _LINEAR.items():
        column = None
        for c, z in pairs:
            part = F.lit(c) * F.expr(f"cast({z} as double)")
            column = part if column is None else column + part
        terms[name] = column
    return terms


def _explained(spark, folder):
    return scoring.contributions(table(spark, folder, "lineitem"), _terms(), -0.2, _THEMES)


@register(
    "contributions",
    f"SELECT l_orderkey, l_partkey, {R(_SQL_LOGIT)} AS logit, {R(f'1 / (1 + exp(-({_SQL_LOGIT})))')} AS probability, "
    + ", ".join(f"{R(t)} AS v_{n}" for n, t in _SQL_TERM.items())
    + ", "
    + ", ".join(f"{R(' + '.join(ts))} AS t_{n}" for n, ts in _SQL_THEME.items())
    + " FROM lineitem",
)
def _(spark, folder):
    rows = _explained(spark, folder)
    by_variable = F.map_from_entries("par_variable")
    by_theme = F.map_from_entries("par_theme")
    return rows.select(
        "l_orderkey",
        "l_partkey",
        "logit",
        "probability",
        *[by_variable[n].alias(f"v_{n}") for n in _LINEAR],
        *[by_theme[n].alias(f"t_{n}") for n in _SQL_THEME],
    )


@register(
    "top_contributions",
    "WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, list_sort(["
    + ", ".join(f"{{'k': -abs({t}), 'nom': '{n}'}}" for n, t in _SQL_TERM.items())
    + "]) AS l FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_transform(l[1:6], lambda x: x.nom), ',') AS variables FROM c",
)
def _(spark, folder):
    top = scoring.top_contributions(
        table(spark, folder, "lineitem"), _terms(), -0.2, _THEMES
    )
    return top.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.array_join("par_variable.nom", ",").alias("variables"),
    )


@register(
    "global_importance",
    "WITH z AS (SELECT "
    + ", ".join(
        f"CAST({z} AS DOUBLE) AS z{i}_{j}"
        for i, pairs in enumerate(_LINEAR.values())
        for j, (_c, z) in enumerate(pairs)
    )
    + " FROM lineitem), m AS (SELECT *, "
    + ", ".join(
        f"avg(z{i}_{j}) OVER () AS m{i}_{j}"
        for i, pairs in enumerate(_LINEAR.values())
        for j in range(len(pairs))
    )
    + " FROM z) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS variable, "
        + R(" + ".join(f"avg(abs({c} * (z{i}_{j} - m{i}_{j})))" for j, (c, _z) in enumerate(pairs)))
        + " AS importance FROM m"
        for i, (n, pairs) in enumerate(_LINEAR.items())
    ),
)
def _(spark, folder):
    encoded = {
        name: [(c, F.expr(f"cast({z} as double)")) for c, z in pairs]
        for name, pairs in _LINEAR.items()
    }
    return scoring.global_importance(table(spark, folder, "lineitem"), encoded)


# --- protocol and models ----------------------------------------------------------------------


@register(
    "stratified_split",
    "SELECT o_orderpriority, count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n_train, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n_test FROM orders GROUP BY 1",
)
def _(spark, folder):
    marked = protocol.stratified_split(
        table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"], 0.2, 42
    )
    return marked.groupBy("o_orderpriority").agg(
        F.count_if(~F.col("est_test")).alias("n_train"), F.count_if("est_test").alias("n_test")
    )


@register(
    "assign_folds",
    "WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, CAST(i AS INTEGER) AS fold, "
    "CAST(floor(n * (i + 1) / 5) - floor(n * i / 5) AS BIGINT) AS n FROM c, range(0, 5) r(i)",
)
def _(spark, folder):
    folded = protocol.assign_folds(
        table(spark, folder, "orders"), ["o_orderkey"], 5, 42, "o_orderstatus"
    )
    return folded.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@register(
    "resolve_categories",
    "SELECT 'lang' AS colonne, lang AS categorie, lang NOT IN ('fr', 'en') AS inedite FROM (SELECT DISTINCT lang FROM documents)",
)
def _(spark, folder):
    documents = table(spark, folder, "documents")
    categories, extras = modeling.resolve_categories(documents, {"lang": ["fr", "en"]})
    return spark.createDataFrame(
        [("lang", c, c in extras.get("lang", [])) for c in categories["lang"]],
        "colonne string, categorie string, inedite boolean",
    )


_FOLDS = 5


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with folds: the small table models are checked on."""
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    rows = joined.select(
        "doc_id",
        "lang",
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", " ", ""))).alias("espaces"),
        "quality",
        "toxic",
    )
    return materialized(protocol.assign_folds(rows, ["doc_id"], _FOLDS, 1, "quality"))


_ROLES = {"numeric": ("n_chars", "espaces"), "nominal": {"lang": ["de", "en", "es", "fr"]}}


def _logreg(c: float = 1.0) -> modeling.Family:
    return modeling.Family("logreg", modeling.logistic(c), True, True, **_ROLES, penalty=c)


_SQL_RIDGE = (
    f"WITH {SQL_HOLES}, f AS (SELECT k, l_orderkey % 5 AS fold, q, d, p / 1000 AS p FROM holes, range(5) AS r(k)), "
    "m AS (SELECT k, quantile_cont(q, 0.5) AS mq, quantile_cont(d, 0.5) AS md FROM f WHERE fold <> k GROUP BY k), "
    "z AS (SELECT k, fold, coalesce(q, mq) AS q, coalesce(d, md) AS d, p FROM f JOIN m USING (k)), "
    "s AS (SELECT k, avg(q) AS aq, stddev_pop(q) AS sq, avg(d) AS ad, stddev_pop(d) AS sd FROM z WHERE fold <> k GROUP BY k), "
    "y AS (SELECT k, fold, (q - aq) / sq AS a, (d - ad) / sd AS b, p FROM z JOIN s USING (k)), "
    "g AS (SELECT k, avg(a) AS ma, avg(b) AS mb, avg(p) AS mp, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, "
    "count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, p) AS ap, count(*) * covar_pop(b, p) AS bp "
    "FROM y WHERE fold <> k AND p IS NOT NULL GROUP BY k), "
    "c AS (SELECT *, (ap * bb - bp * ab) / (aa * bb - ab * ab) AS ca, (bp * aa - ap * ab) / (aa * bb - ab * ab) AS cb FROM g), "
    "o AS (SELECT k, p, mp + ca * (a - ma) + cb * (b - mb) AS v FROM y JOIN c USING (k) WHERE fold = k) "
    f"SELECT CAST(k AS INTEGER) AS fold, {R('avg(abs(v - p))')} AS mae, {R('sqrt(avg((v - p) * (v - p)))')} AS rmse, "
    f"{R('1 - avg((v - p) * (v - p)) / var_pop(p)')} AS r2 FROM o GROUP BY k"
)


@register("ridge_fold_scores", _SQL_RIDGE)
def _(spark, folder):
    """Out-of-fold errors of ridge models of all folds, from one pass of moments."""
    rows = holes(spark, folder).withColumns(
        {"fold": (F.col("l_orderkey") % 5).cast("int"), "p": F.col("p") / 1000}
    )
    family = modeling.Family("ridge", modeling.ridge(), True, False, ("q", "d"), penalty=1.0)
    found = linear.out_of_fold_many(rows, family, "p", linear.by_fold("ridge", 5), ["fold"], target_name="cible")
    return metrics.regression_metrics(found.where("cible IS NOT NULL"), "cible", "p", ["fold"])


@register(
    "isotonic_fit",
    f"WITH {SQL_SCORED}, d AS (SELECT o_orderpriority AS g, p AS s, count(*) AS w, sum(y) AS t FROM scored GROUP BY ALL), "
    "c AS (SELECT g, s, w, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(t) OVER o AS ct FROM d WINDOW o AS (PARTITION BY g ORDER BY s)), "
    "b AS (SELECT g, i, cw - w AS cw, ct - (SELECT t FROM d WHERE d.g = c.g AND d.s = c.s) AS ct FROM c), "
    "low AS (SELECT x.g, x.i, b.i AS j, min((e.ct - b.ct) / (e.cw - b.cw)) AS v FROM c AS x JOIN b ON b.g = x.g AND b.i <= x.i "
    "JOIN c AS e ON e.g = x.g AND e.i >= x.i GROUP BY ALL) "
    f"SELECT c.g AS o_orderpriority, {R('c.s')} AS p, {R('max(v)')} AS prediction FROM low JOIN c USING (g, i) GROUP BY c.g, c.s",
)
def _(spark, folder):
    """The rising fit of the label on the score in each group, at every score."""
    rows = scored(spark, folder)
    blocks = isotonic.isotonic_blocks(rows, "p", "y", ["o_orderpriority"], bucket_rows=40)
    found = isotonic.isotonic_predict(rows.select("o_orderpriority", "p").distinct(), "p", blocks, ["o_orderpriority"])
    return found


@register(
    "fit_preprocessor",
    f"WITH {SQL_HOLES}, c AS (SELECT l_orderkey, l_linenumber, q, p, CASE g WHEN 'AF' THEN 0.0 WHEN 'NF' THEN 1.0 WHEN 'NO' THEN 2.0 WHEN 'RF' THEN 3.0 END AS g, f FROM holes), "
    "m AS (SELECT quantile_cont(q, 0.5) AS q, quantile_cont(p, 0.5) AS p, quantile_cont(g, 0.5) AS g FROM c), "
    "v AS (SELECT l_orderkey, l_linenumber, coalesce(c.q, m.q) AS q, coalesce(c.p, m.p) AS p, coalesce(c.g, m.g) AS g, f FROM c, m), "
    "s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp, avg(g) AS mg, stddev_pop(g) AS sg FROM v) "
    f"SELECT l_orderkey, l_linenumber, {R('(q - mq) / sq')} AS q, {R('(p - mp) / sp')} AS p, {R('(g - mg) / sg')} AS g, "
    + ", ".join(f"CASE WHEN f = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_{c}" for c in "ANR")
    + " FROM v, s",
)
def _(spark, folder):
    rows = holes(spark, folder)
    prep = modeling.Preprocessor(["q", "p"], {"g": ["AF", "NF", "NO", "RF"]}, {"f": ["A", "N", "R"]}, True).fit(rows)
    names = ["q", "p", "g", "f_A", "f_N", "f_R"]
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, (_, c) in zip(names, prep.outputs(rows))])


@register("fit_classifier")
def _(spark, folder):
    rows = _documents(spark, folder)
    parts = [
        family.fit(rows, "quality").predict(rows).select(F.lit(name).alias("famille"), "quality", "p")
        for name, family in modeling.build_classifiers(_ROLES).items()
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return metrics.classification_metrics(both, "quality", "p", ["famille"])


@register("fit_regressor")
def _(spark, folder):
    rows = table(spark, folder, "lineitem")
    roles = {"numeric": ("l_quantity", "l_discount"), "nominal": {"l_returnflag": ["A", "N", "R"]}}
    parts = [
        family.fit(rows, "l_extendedprice").predict(rows).select(
            F.lit(name).alias("famille"), "l_extendedprice", "p"
        )
        for name, family in modeling.build_regressors(roles).items()
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return metrics.regression_metrics(both, "l_extendedprice", "p", ["famille"])


@register(
    "out_of_fold",
    "WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality), "
    f"f AS (SELECT unnest(range({_FOLDS})) AS fold) "
    f"SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(n * (fold + 1) // {_FOLDS} - n * fold // {_FOLDS}) AS BIGINT) AS n, "
    f"CAST(sum(n * (fold + 1) // {_FOLDS} - n * fold // {_FOLDS}) AS BIGINT) AS n_documents, "
    f"CAST(sum(n * (fold + 1) // {_FOLDS} - n * fold // {_FOLDS}) AS BIGINT) AS n_dans_bornes, TRUE AS mieux_que_hasard FROM c, f GROUP BY fold",
)
def _(spark, folder):
    scores = modeling.out_of_fold(_documents(spark, folder), _logreg(), "quality", _FOLDS)
    better = metrics.classification_metrics(scores, "quality", "p", ["fold"]).select("fold", (F.col("roc_auc") > 0.5).alias("mieux_que_hasard"))
    return (
        scores.groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("doc_id").alias("n_documents"),
            F.count_if(F.col("p").between(0, 1)).alias("n_dans_bornes"),
        )
        .join(better, "fold")
    )


@register("fold_scores")
def _(spark, folder):
    scores = modeling.out_of_fold(_documents(spark, folder), _logreg(), "quality", _FOLDS)
    return modeling.fold_scores(scores, "quality")


@register("train_vs_oof")
def _(spark, folder):
    return modeling.train_vs_oof(_documents(spark, folder), _logreg(), "quality", _FOLDS)


@register("ablate")
def _(spark, folder):
    blocks = {"langue": ["lang"], "longueur": ["n_chars"], "espaces": ["espaces"]}
    return modeling.ablate(_documents(spark, folder), _logreg(), "quality", blocks, _FOLDS)


@register("grid_search")
def _(spark, folder):
    return modeling.search(
        _documents(spark, folder),
        lambda params: _logreg(params["C"]),
        modeling.grid({"C": [0.001, 0.01, 0.1, 0.3, 1.0, 3.0, 10.0]}),
        "quality",
        n_splits=_FOLDS,
    )


_FOREST_SPACE = {
    "trees": lambda rng: rng.randrange(200, 501, 100),
    "depth": lambda rng: rng.randint(3, 20),
    "leaf": lambda rng: rng.randint(1, 20),
    "subset": lambda rng: rng.choice(["sqrt", "log2", "all"]),
}


@register("random_search")
def _(spark, folder):
    drawn = modeling.random_candidates(_FOREST_SPACE, 20, 7)
    return modeling.search(
        _documents(spark, folder),
        lambda params: modeling.Family("random_forest", modeling.forest(**params), False, True, **_ROLES),
        drawn,
        "quality",
        n_splits=_FOLDS,
    )


@register(
    "class_weighting",
    f"SELECT toxic, count(*) AS n, {R('(SELECT count(*) FROM labels) / (2.0 * count(*))')} AS poids FROM labels GROUP BY toxic",
)
def _(spark, folder):
    weighted = modeling.with_class_weight(table(spark, folder, "labels"), "toxic")
    return weighted.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.max("poids").alias("poids")
    )


@register(
    "search_kept",
    "SELECT 'C' AS nom, CAST(3 AS BIGINT) AS essais, CAST(1 AS BIGINT) AS calculs, TRUE AS pareils, CAST(count(*) AS BIGINT) AS lignes "
    "FROM documents JOIN labels USING (doc_id)",
)
def _(spark, folder):
    """A search asked for twice over the same rows: the second time its kept table is read and nothing is fitted."""
    rows, store, calls = _documents(spark, folder), scratch(spark), []

    def compute():
        calls.append(1)
        return modeling.search(rows, lambda params: _logreg(params["C"]), modeling.grid({"C": [0.1, 1.0, 10.0]}), "quality", n_splits=_FOLDS)

    first, second = (modeling.cached_search(store, "C", rows, compute) for _ in range(2))
    same = not first.exceptAll(second).count() and not second.exceptAll(first).count()
    facts = [("C", second.count(), len(calls), same, rows.count())]
    return spark.createDataFrame(facts, "nom string, essais bigint, calculs bigint, pareils boolean, lignes bigint")


@register("class_weighting_metrics")
def _(spark, folder):
    return modeling.compare_weighting(_documents(spark, folder), _logreg(), "quality", _FOLDS)


@register("isotonic_recalibration")
def _(spark, folder):
    return modeling.isotonic_recalibration(_documents(spark, folder), _logreg(), "quality", _FOLDS, 5)


_SQL_PANEL = (
    f"WITH {SQL_SCORED}, c AS (SELECT o_orderpriority AS configuration, avg(abs(p - y)) AS mesure, CAST(count(*) AS DOUBLE) AS cout FROM scored GROUP BY 1)"
)


def _configurations(spark, folder):
    return scored(spark, folder).groupBy(F.col("o_orderpriority").alias("configuration")).agg(
        F.avg(F.abs(F.col("p") - F.col("y"))).alias("mesure"),
        F.count(F.lit(1)).cast("double").alias("cout"),
    )


@register(
    "metrics_panel",
    _SQL_PANEL + f" SELECT configuration, {R('mesure')} AS mesure, {R('cout')} AS cout, {R('mesure + CASE WHEN configuration < chr(51) THEN 0.01 ELSE 0 END')} AS stockee, "
    "CASE WHEN configuration = '5-LOW' THEN 'retenue' WHEN mesure = (SELECT min(mesure) FROM c) THEN 'meilleure' ELSE 'écartée' END AS statut, configuration >= '3' AS conforme FROM c",
)
def _(spark, folder):
    found = _configurations(spark, folder)
    stored = F.col("mesure") + F.when(F.col("configuration") < "3", 0.01).otherwise(0.0)
    return modeling.metrics_panel(found.withColumn("stockee", stored), ["5-LOW"])


_SQL_CONFIGURATIONS = (
    f"WITH {SQL_SCORED}, s AS (SELECT c AS configuration, CAST(o_orderkey % 5 AS INTEGER) AS fold, y, "
    "CASE c WHEN 'a' THEN p WHEN 'b' THEN p * p ELSE 1 - p / 2 END AS p FROM scored, (VALUES ('a'), ('b'), ('c')) AS t(c)), "
    "k AS (SELECT configuration, fold, FALSE AS tout, y, p FROM s UNION ALL SELECT configuration, -2, TRUE, y, p FROM s), "
    "r AS (SELECT *, rank() OVER g + (count(*) OVER (PARTITION BY configuration, fold, p) - 1) / 2.0 AS rang "
    "FROM k WINDOW g AS (PARTITION BY configuration, fold ORDER BY p)), "
    "m AS (SELECT configuration, fold, tout, avg((p - y) * (p - y)) AS brier, "
    "(sum(rang) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) "
    "/ (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY ALL), "
    "c AS (SELECT configuration, count(*) FILTER (NOT tout) AS n_plis, avg(auc) FILTER (NOT tout) AS moyenne_roc_auc, "
    "stddev_pop(auc) FILTER (NOT tout) AS ecart_roc_auc, avg(brier) FILTER (NOT tout) AS moyenne_brier, "
    "stddev_pop(brier) FILTER (NOT tout) AS ecart_brier, max(auc) FILTER (tout) AS roc_auc, max(brier) FILTER (tout) AS brier FROM m GROUP BY 1) "
    f"SELECT configuration, n_plis, {R('moyenne_roc_auc')} AS moyenne_roc_auc, {R('ecart_roc_auc')} AS ecart_roc_auc, "
    f"{R('moyenne_brier')} AS moyenne_brier, {R('ecart_brier')} AS ecart_brier, {R('roc_auc')} AS roc_auc, {R('brier')} AS brier, "
    "CASE WHEN configuration = 'c' THEN NULL ELSE configuration = 'a' END AS conforme, "
    "CASE WHEN configuration = 'b' THEN 'retenue' WHEN brier = (SELECT min(brier) FROM c) THEN 'meilleure' ELSE 'écartée' END AS statut FROM c"
)


@register("score_panel", _SQL_CONFIGURATIONS)
def _(spark, folder):
    """Configurations by their written scores, against the value kept when they were written; one of these is wrong,
    one is missing."""
    p = {"a": F.col("p"), "b": F.col("p") * F.col("p"), "c": 1 - F.col("p") / 2}
    names = F.explode(F.array(*map(F.lit, p))).alias("configuration")
    rows = scored(spark, folder).select("y", "p", (F.col("o_orderkey") % 5).cast("int").alias("fold"), names)
    value = F.when(F.col("configuration") == "a", p["a"]).when(F.col("configuration") == "b", p["b"]).otherwise(p["c"])
    path = scratch(spark)
    rows.withColumn("p", value).write.parquet(path)
    scores = spark.read.parquet(path)
    kept = metrics.brier(scores.where("configuration <> 'c'"), "y", "p", ["configuration"]).withColumn(
        "stockee", F.col("brier") + F.when(F.col("configuration") == "b", 0.01).otherwise(0.0)
    )
    found = modeling.score_panel(scores, "y", kept, "brier", ["b"])
    return found.drop("stockee", *[c for c in found.columns if "pr_auc" in c])


@register(
    "frugal_choice",
    _SQL_PANEL + " SELECT arg_min(configuration, (cout, mesure)) AS configuration FROM c WHERE mesure <= (SELECT min(mesure) FROM c) + 0.03",
)
def _(spark, folder):
    return modeling.frugal_choice(_configurations(spark, folder))


@register("retrain")
def _(spark, folder):
    from lodestat.plans.runs import Spec, retrain

    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("cle"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" km")).alias("distance"),
        F.concat((F.col("o_orderkey") % 13).cast("string"), F.lit(",5")).alias("rendus"),
        F.col("o_orderpriority").alias("priorite"),
        (F.col("o_custkey") % 3 == 0).cast("int").cast("string").alias("abandon"),
        (F.col("o_custkey") % 20).cast("string").alias("moyenne"),
    )
    spec = Spec(
        "1.0", "abandon", "moyenne", ("cle",), ("distance", "rendus", "abandon", "moyenne"),
        nominal={"priorite": ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")},
        ratios={"ratio": ("rendus", "distance")},
    )
    run = retrain(raw, spec)
    facts = {"seuil": run.threshold, "lignes": float(run.rows), **run.holdout}
    return spark.createDataFrame(
        [(k, float(v)) for k, v in facts.items()], "mesure string, valeur double"
    )


# --- windowed alerts --------------------------------------------------------------------------

_SQL_BIN = "time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01 00:00:00')"
_SQL_ERRORS = (
    f"w AS (SELECT {_SQL_BIN.format(w='10 minutes')} AS b, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)"
)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("debut", "fin")}
    )


def _errors(events: DataFrame) -> DataFrame:
    return alerts.error_rate_window(events, "ts", F.col("event_type") == "error", 0.1)


_SQL_ERROR_RATE = (
    f"WITH {_SQL_ERRORS} SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS debut, strftime(b + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') AS fin, n, e AS n_erreurs, "
    f"{R('e / n')} AS taux, e / n > 0.1 AS alerte FROM w"
)


@register("error_rate_window", _SQL_ERROR_RATE)
def _(spark, folder):
    return _stamped(_errors(table(spark, folder, "events")))


@register("error_rate_stream", _SQL_ERROR_RATE)
def _(spark, folder):
    """The same rule on a stream of the events file; the last update of each window is kept."""
    schema = table(spark, folder, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    out, state = scratch(spark), scratch(spark)

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/lot={number}")

    query = (
        _errors(events)
        .writeStream.outputMode("update")
        .foreachBatch(land)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    landed = spark.read.parquet(out)
    last = landed.groupBy("debut", "fin").agg(
        F.max_by(F.struct("n", "n_erreurs", "taux", "alerte"), "lot").alias("_l")
    )
    return _stamped(last.select("debut", "fin", "_l.*"))


_SQL_SLIDES = (
    f"s AS (SELECT {_SQL_BIN.format(w='5 minutes')} - INTERVAL '5 minutes' * i AS b, event_type, value FROM events, range(0, 3) r(i))"
)


@register(
    "latency_quantile_window",
    f"WITH {_SQL_SLIDES} SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS debut, strftime(b + INTERVAL '15 minutes', '%Y-%m-%d %H:%M:%S') AS fin, event_type, count(*) AS n, "
    f"{R('quantile_disc(value, 0.5)')} AS p50, {R('quantile_disc(value, 0.95)')} AS p95, {R('quantile_disc(value, 0.99)')} AS p99, quantile_disc(value, 0.95) > 30 AS alerte FROM s GROUP BY b, event_type",
)
def _(spark, folder):
    found = alerts.latency_quantile_window(
        table(spark, folder, "events"), "ts", "value", "event_type"
    )
    return _stamped(found)


@register(
    "refusal_increase_window",
    f"WITH r AS (SELECT ts, unnest(list_filter([CASE WHEN value > 50 THEN 'value' END, CASE WHEN user_id % 10 = 0 THEN 'user_id' END], lambda x: x IS NOT NULL)) AS colonne FROM events) "
    f"SELECT strftime({_SQL_BIN.format(w='24 hours')}, '%Y-%m-%d %H:%M:%S') AS debut, strftime({_SQL_BIN.format(w='24 hours')} + INTERVAL '24 hours', '%Y-%m-%d %H:%M:%S') AS fin, colonne, count(*) AS n FROM r GROUP BY ALL",
)
def _(spark, folder):
    judged = C.validate_rows(
        table(spark, folder, "events").withColumn(
            "user_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
        ),
        C.Contract((C.Field("value", "float", True, None, 50), C.Field("user_id", "int"))),
        forbid_unknown=False,
    )
    return _stamped(alerts.refusal_increase_window(C.refused(judged), "ts"))


@register(
    "traffic_by_status",
    f"SELECT strftime({_SQL_BIN.format(w='5 minutes')}, '%Y-%m-%d %H:%M:%S') AS debut, strftime({_SQL_BIN.format(w='5 minutes')} + INTERVAL '5 minutes', '%Y-%m-%d %H:%M:%S') AS fin, "
    f"event_type, CAST(user_id % 3 AS VARCHAR) AS statut, count(*) AS n, {R('count(*) / 300')} AS par_seconde FROM events GROUP BY ALL",
)
def _(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "statut", (F.col("user_id") % 3).cast("string")
    )
    return _stamped(alerts.traffic_by_status(events, "ts", "event_type", "statut"))


@register(
    "sustained_alert",
    f"WITH {_SQL_ERRORS}, a AS (SELECT b, b - INTERVAL '10 minutes' * row_number() OVER (ORDER BY b) AS run FROM w WHERE e / n > 0.1), "
    "r AS (SELECT min(b) AS debut, max(b) + INTERVAL '10 minutes' AS fin, count(*) AS k FROM a GROUP BY run) "
    "SELECT strftime(debut, '%Y-%m-%d %H:%M:%S') AS debut, strftime(fin, '%Y-%m-%d %H:%M:%S') AS fin, k AS n_fenetres FROM r WHERE fin >= debut + INTERVAL '30 minutes'",
)
def _(spark, folder):
    return _stamped(alerts.sustained_alert(_errors(table(spark, folder, "events")), "30 minutes"))


@register(
    "score_stream",
    _SQL_JUDGED + " SELECT CASE WHEN motifs = '' THEN 'score' ELSE 'refuse' END AS statut, count(*) AS n FROM judged GROUP BY 1",
)
def _(spark, folder):
    """Orders as a stream of micro-batches, judged and scored as they come."""
    schema = table(spark, folder, "orders").schema
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "orders.parquet")
        .parquet(folder)
        .selectExpr(*[part.strip() for part in _CAMPAIGN_COLUMNS])
    )
    out, state = scratch(spark), scratch(spark)
    score_stream(
        rows, CONTRACT, _rate, out, state, threshold=0.6, origin="appel"
    ).awaitTermination()
    parts = [
        spark.read.parquet(f"{out}/{name}").select(F.lit(status).alias("statut"))
        for name, status in (("scores", "score"), ("refus", "refuse"))
    ]
    return parts[0].unionByName(parts[1]).groupBy("statut").agg(F.count(F.lit(1)).alias("n"))


_CAMPAIGN_COLUMNS = (
    "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
    "o_orderkey % 7 AS rendus", "o_orderkey % 9 AS total",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 END AS avis",
)

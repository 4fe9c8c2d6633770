"""Contract, models, sources, streams, and whole runs on a small hand-typed cohort."""

import codecs
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import modeling
from lodestat.operators.contract import Contract, Field, refused, validate_rows
from lodestat.operators.scoring import (
    check_policy,
    contributions,
    resolve_threshold,
    scored_union_refused,
    top_contributions,
)
from lodestat.plans import runs
from lodestat.plans.runs import Spec, batch_drift, load_run, predict, retrain, save_run
from lodestat.sources import files, layers
from lodestat.streaming import alerts

CONTRACT = Contract(
    (
        Field("presence", "float", True, 0, 100),
        Field("total", "int", True, 1),
        Field("rendus", "int", True, 0),
        Field("filiere", "text", True, categories=("gestion", "droit")),
        Field("mention", "text", False, categories=("passable", "assez bien", "bien", "tres bien")),
    ),
    (("rendus", "total"),),
    ("student_id",),
)
SPEC = Spec(
    "1.0", "abandon", "moyenne", ("student_id",),
    ("presence", "total", "rendus", "abandon", "moyenne"),
    ordinal={"mention": ("passable", "assez bien", "bien", "tres bien")},
    nominal={"filiere": ("gestion", "droit")},
    vocabulary={"mention": {"passable": ("p", "passable"), "assez bien": ("ab",), "tres bien": ("tb",)}},
    ratios={"taux": ("rendus", "total")}, trees=3, n_splits=3, c=1.0,
)


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        h = rng.random()
        presence = f"{60 + 30 * h:.1f}"
        rows.append(
            (
                f"E{i:04d}",
                presence + "%" if i % 3 else presence.replace(".", ","),
                "12",
                str(int(12 * h)),
                rng.choice(["Gestion", "DROIT ", " droit"]),
                rng.choice(["p", "passable", "AB", "tb", ""]),
                str(int(h + rng.gauss(0, 0.1) < 0.35)),
                f"{20 * h:.1f}",
            )
        )
    rows += rows[:10]
    names = ["student_id", "presence", "total", "rendus", "filiere", "mention", "abandon", "moyenne"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def run(raw):
    return retrain(raw, SPEC)


def test_retrain(run):
    assert run.rows == 240  # ten duplicates removed
    assert run.holdout["roc_auc"] > 0.85 and run.holdout["mae"] < 3
    assert 0 < run.threshold < 1


def test_predict_refuses_rows_alone(spark, raw, run):
    batch = (
        raw.limit(40)
        .drop("abandon", "moyenne")
        .withColumn("rendus", F.when(F.col("student_id") == "E0003", "15").otherwise(F.col("rendus")))
        .withColumn("presence", F.when(F.col("student_id") == "E0004", "135 %").otherwise(F.col("presence")))
    )
    scored, bad, summary = predict(batch, SPEC, CONTRACT, run, True)
    row = summary.first()
    assert (row["recus"], row["scores"], row["refuses"]) == (40, 38, 2)
    reasons = {r["reference"]: r["erreurs"][0]["champ"] for r in bad.collect()}
    assert reasons == {"E0003": "_modele", "E0004": "presence"}
    both = scored_union_refused(scored, bad)
    assert both.count() == 40
    assert scored.where("moyenne_finale < 0 OR moyenne_finale > 20").count() == 0


def test_saved_run_predicts_alike(spark, raw, run, tmp_path):
    root = save_run(run, str(tmp_path), "1.0")
    again = load_run(spark, root)
    assert (again.threshold, again.units, again.fingerprint, again.rows) == (run.threshold, run.units, run.fingerprint, run.rows)
    assert again.classifier.preprocessor == run.classifier.preprocessor
    batch = raw.drop("abandon", "moyenne")
    columns = ["reference", "probability", "moyenne_finale", "signaled"]
    one, two = (sorted(map(tuple, predict(batch, SPEC, CONTRACT, r, True)[0].select(columns).collect())) for r in (run, again))
    assert one == two and len(one) == 250
    drift = batch_drift(predict(batch, SPEC, CONTRACT, again)[0], again).collect()
    assert {r["variable"] for r in drift} >= {"presence", "filiere"}


def test_capacity_flags_at_most_so_many(raw, run):
    batch = raw.drop("abandon", "moyenne")
    scored, _, _ = predict(batch, SPEC, CONTRACT, run, True, capacity=25)
    rows = scored.select("probability", "signaled", "provenance_seuil").collect()
    flagged = [r["probability"] for r in rows if r["signaled"]]
    assert 15 <= len(flagged) <= 25 and {r["provenance_seuil"] for r in rows} == {"capacite"}
    assert min(flagged) > max(r["probability"] for r in rows if not r["signaled"])
    with pytest.raises(ValueError):
        predict(batch, SPEC, CONTRACT, run, False, capacity=25)


def test_units_come_from_training(raw, run):
    """A row reads alike alone and beside others."""
    batch = raw.drop("abandon", "moyenne").where("student_id IN ('E0001', 'E0002')")
    whole = {r["reference"]: r["probability"] for r in predict(batch, SPEC, CONTRACT, run)[0].collect()}
    for key in ("E0001", "E0002"):
        (alone,) = predict(batch.where(F.col("student_id") == key).limit(1), SPEC, CONTRACT, run)[0].collect()
        assert alone["probability"] == whole[key]


def test_contributions_add_up_to_the_model(spark, raw, run):
    from lodestat.plans.runs import curate

    gold = curate(raw, SPEC)
    terms, intercept = run.classifier.terms(gold)
    explained = contributions(gold, terms, intercept, {"presence": "assiduité"})
    both = explained.join(run.classifier.predict(gold, "p").select("student_id", "p"), "student_id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("probability")))).first()[0] < 1e-9
    total = F.aggregate("par_theme", F.lit(intercept), lambda a, e: a + e["contribution"])
    assert both.agg(F.max(F.abs(total - F.col("logit")))).first()[0] < 1e-9
    top = top_contributions(gold, terms, intercept, top=2).first()["par_variable"]
    assert len(top) == 2 and abs(top[0]["contribution"]) >= abs(top[1]["contribution"])


def test_contract_messages(spark):
    rows = [(1, "a", None), (30, "z", None), (2, "a", "x"), (None, "a", None), (3, "b", None)]
    df = spark.createDataFrame(rows, "n int, c string, intrus string")
    contract = Contract((Field("n", "int", True, 1, 9), Field("c", "text", True, categories=("a", "b"))))
    got = [[e["champ"] for e in r["erreurs"]] for r in validate_rows(df, contract).collect()]
    assert got == [[], ["n", "c"], ["intrus"], ["n"], []]
    assert refused(validate_rows(df, contract)).count() == 3


def test_policies():
    assert resolve_threshold(0.3, 0.4, 0.5) == (0.3, "appel")
    assert resolve_threshold(None, None, 0.5) == (0.5, "fiche")
    for bad in ((0.3, 5, True), (0.3, None, False), (None, 0, True)):
        with pytest.raises(ValueError):
            check_policy(*bad)


def test_ridge_and_logistic_solve_their_penalised_problems(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 2))
    y = x @ [3.0, -2.0] + rng.normal(0, 1, 300) + 50
    d = (x @ [1.0, 0.5] + rng.normal(0, 1, 300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, d)], "a double, b double, y double, d int")
    z = (x - x.mean(0)) / x.std(0)
    fitted = modeling.Family("ridge", modeling.ridge(25.0), True, False, ("a", "b")).fit(df, "y")
    expected = np.linalg.solve(z.T @ z + 25 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(fitted.model.coefficients.toArray(), expected, atol=1e-6)
    fitted = modeling.Family("logreg", modeling.logistic(0.1), True, True, ("a", "b")).fit(df, "d")
    w, b = np.zeros(2), 0.0
    for _ in range(50):  # Newton on ½‖w‖² + C Σ loss
        p = 1 / (1 + np.exp(-(z @ w + b)))
        full = np.c_[z, np.ones(300)]
        gradient = 0.1 * full.T @ (p - d) + np.r_[w, 0]
        hessian = 0.1 * (full * (p * (1 - p))[:, None]).T @ full + np.diag([1, 1, 0])
        step = np.linalg.solve(hessian, gradient)
        w, b = w - step[:2], b - step[2]
    assert np.allclose(fitted.model.coefficients.toArray(), w, atol=1e-4)
    assert fitted.model.intercept == pytest.approx(b, abs=1e-4)


def test_categories_keep_their_place(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    assert modeling.resolve_categories(df, {"c": ["a", "b"]}) == ({"c": ["a", "b", "z"]}, {"c": ["z"]})
    assert modeling.resolve_categories(df, {"c": ["a", "b"]}, extend=False)[0] == {"c": ["a", "b"]}


def test_a_column_too_varied_is_left_out_alone(spark, raw, monkeypatch, tmp_path):
    df = spark.createDataFrame([("b", f"x{k}") for k in range(6)] + [("z", "x0")], "c string, d string")
    monkeypatch.setattr(modeling, "MAX_NEW_CATEGORIES", 3)
    assert modeling.resolve_categories(df, {"c": ["a", "b"], "d": []}) == ({"c": ["a", "b", "z"]}, {"c": ["z"]})
    assert modeling.resolve_categories(df, {"d": []}) == ({}, {})

    letters = F.translate("student_id", "E0123456789", "eabcdefghij")
    free = raw.withColumn("presence", F.concat(F.lit("12 "), letters))
    monkeypatch.setattr(runs, "MAX_UNITS", 100)
    units = runs.known_units(free, SPEC)
    assert "presence" not in units and units["total"] == []
    small = replace(SPEC, trees=1, n_splits=2)
    trained = runs.retrain(free, small)
    assert trained.refused == {"presence": "more than 100 units"}
    assert "presence" not in trained.classifier.preprocessor.numeric and "taux" in trained.classifier.preprocessor.numeric
    again = load_run(spark, save_run(trained, str(tmp_path), "1"))
    assert again.refused == trained.refused
    plain = raw.drop("abandon", "moyenne").withColumn("presence", F.lit("75"))  # still a field of the contract, read as a plain number
    scored, _, summary = predict(plain, small, CONTRACT, again)
    assert scored.count() > 0 and summary.count() == 1
    with pytest.raises(ValueError, match="free text"):
        runs.retrain(free, replace(small, target_secondary="presence"))
    kept = runs.curate(free, SPEC)
    assert "presence" not in kept.columns and "total" in kept.columns


def test_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id;nom;v\n1;Élise;2,5 km\n2;;NA\n2;;NA\n".encode("cp1252"))
    (folder / "b.csv").write_bytes("id,nom,v\n3,Zoé,7\n".encode("utf-8-sig"))
    (folder / "c.csv").write_bytes("id|nom|v\n4|Ana|8\n".encode("utf-16"))
    found = {r["path"][-5:]: (r["encoding"], r["has_bom"], r["delimiter"]) for r in files.sniff_files(spark, str(folder)).collect()}
    assert found == {"a.csv": ("cp1252", False, ";"), "b.csv": ("utf-8-sig", True, ","), "c.csv": ("utf-16", True, "|")}
    (folder / "d.csv").write_bytes(codecs.BOM_UTF8 + "id;a,b,c\n1;x,y,z\r\n2;x,y,z".encode() * 3)
    (folder / "e.csv").write_bytes(b"")
    (folder / "f.csv").write_bytes(codecs.BOM_UTF8)
    (folder / "g.csv").write_bytes(b"a\tb\n\x81\t\xe9\n" * 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for characters in (8192, 4096):
            found = {r["path"][-5:]: (r["encoding"], r["has_bom"], r["delimiter"], r["size"]) for r in files.sniff_files(spark, str(folder), characters).collect()}
            for name, got in found.items():
                payload = (folder / name).read_bytes()
                encoding, marked = files.encoding_of(payload)
                sample = payload.decode(encoding)[:characters]
                assert got == (encoding, marked, files.delimiter_of(sample), len(payload)), name
            assert sorted(found) == [f"{k}.csv" for k in "abcdfg"]  # an empty file has no row
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in "defg":
        (folder / f"{name}.csv").unlink()
    rows = files.read_folder(spark, str(folder))
    assert {r["nom"] for r in rows.collect()} == {"Élise", None, "Zoé", "Ana"}
    assert rows.where("v = 'NA'").count() == 2
    facts = files.table_facts(rows).first()
    assert (facts["n_lignes"], facts["n_lignes_en_double"]) == (5, 1)


def test_archive_keeps_older_runs(spark, tmp_path):
    for stamp, version in (("20260101T000000", "1.0"), ("20260102T000000", "1.1")):
        record = layers.run_record(spark, {"version": version, "rows": 3})
        layers.archive_run(record, str(tmp_path), stamp, version)
    assert layers.history(spark, str(tmp_path)).count() == 2
    assert spark.read.parquet(f"{tmp_path}/current").first()["run"] == "20260102T000000_v1.1"


def test_sustained_alert_stream_equals_batch(spark, tmp_path):
    starts = [0, 10, 20, 30, 50, 60, 70, 90, 100]
    flags = [1, 1, 1, 0, 1, 1, 1, 1, 1]
    rows = [("x", f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", bool(f)) for m, f in zip(starts, flags)]
    windows = spark.createDataFrame(rows, "cle string, t string, alerte boolean").select(
        "cle", F.col("t").cast("timestamp").alias("debut"),
        (F.col("t").cast("timestamp") + F.expr("INTERVAL 10 MINUTES")).alias("fin"), "alerte",
    )
    batch = alerts.sustained_alert(windows, "30 minutes", ["cle"])
    windows.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(windows.schema).parquet(str(tmp_path / "w"))
    query = (
        alerts.sustained_alert_stream(stream, "cle", 1800).writeStream.format("memory")
        .queryName("held").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {str(r["debut"]) for r in batch.collect()} == {str(r["debut"]) for r in spark.table("held").collect()}
    assert batch.count() == 2

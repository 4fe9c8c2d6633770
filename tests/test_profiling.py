import pytest
from pyspark.sql import functions as F

from lodestat.operators import prepare, profiling


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


@pytest.mark.parametrize(
    "values, kind",
    [
        (["12.0 km", "2,2", "18.8"], "decimal"),
        (["12 km", "2", "18"], "entier"),
        (["Oui", "N", "non", "0", "1"], "booleen"),
        (["L1"] * 5, "constant"),
        (["", None, "  "], "vide"),
        ([f"ETU-{i:04d}" for i in range(40)], "identifiant"),
        (["2024-09-01", "02/09/2024", "03 Sep 2024"], "date"),
        (["a", "b", "c"] * 20, "categoriel"),
        (["un mot", "deux mots, oui", "trois"], "texte"),
    ],
)
def test_semantic_types(spark, values, kind):
    assert profiling.infer_semantic_types(column(spark, values)).first()["type_semantique"] == kind


def test_non_conformity_and_remarks(spark):
    row = profiling.profile_columns(column(spark, ["1.0", "2.0", "3,0", "4.0 km"])).first()
    assert row["non_conforme_%"] == 50.0
    assert row["remarques"] == "unité(s) collée(s) : « km » ; virgule décimale"
    assert (row["min"], row["max"]) == ("1.0", "4.0")


def test_spelling_conformity_uses_the_majority(spark):
    row = profiling.profile_columns(
        column(spark, ["Gestion", "Gestion", " GESTION ", "Droit", "Droit", "Droit"] * 10)
    ).first()
    assert round(row["non_conforme_%"], 2) == 16.67
    assert (row["n_distinct"], row["n_distinct_normalise"]) == (3, 2)


def test_date_formats_most_useful_first(spark):
    values = ["2024-09-0%d" % i for i in range(1, 6)] + ["13/09/2024", "14/09/2024", "15/09/2024", "04 Sep 2024"]
    found = profiling.detect_date_formats(column(spark, values), ["x"]).orderBy("rang").collect()
    assert [r["format"] for r in found] == ["%Y-%m-%d", "%d/%m/%Y", "%d %b %Y"]


def test_breakdowns_list_every_column(spark):
    many = column(spark, [f"m{i}" + "-" * i for i in range(30)])
    assert profiling.modality_breakdown(many).where("n_modalites = 30").count() == 30
    assert profiling.pattern_breakdown(many).where("n_motifs = 30").count() == 30
    few = profiling.modality_breakdown(column(spark, ["Oui", "oui", "Oui", "Non"])).collect()
    assert sorted((r["modalite"], r["n"], r["ecriture"], r["n_ecriture"]) for r in few) == [
        ("non", 1, "Non", 1),
        ("oui", 3, "Oui", 2),
        ("oui", 3, "oui", 1),
    ]


def test_patterns_are_counted_whole(spark):
    ends = column(spark, ["a1" * 60 + "x", "a1" * 60 + "-", "a1" * 60 + "-"])
    shapes = profiling.pattern_breakdown(ends).collect()
    assert sorted(s["n"] for s in shapes) == [1, 2] and len({s["motif"] for s in shapes}) == 1


def test_twins_appear_only_once_unified(spark):
    raw = spark.createDataFrame(
        [("Gen", "1,0"), ("general", "1.0"), ("GENERAL ", "2")], "bac string, v string"
    )
    types, words = {"v": "decimal", "bac": "categoriel"}, {"bac": {"general": ("gen", "general")}}
    facts = prepare.transform_facts(raw, types, words).first()
    assert (facts["n_lignes_source"], facts["n_doublons_retires"]) == (3, 1)
    once = prepare.transform(raw, types, words)
    again = prepare.recode(once, words)[0]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_conform_row_by_row_equals_whole(spark):
    raw = column(spark, ["12.0 km", "2,2", "n/a", " 7 "])
    whole = {r["x"] for r in prepare.conform(raw, {"x": "decimal"}, units={"x": ["km"]}).collect()}
    single = {
        prepare.conform(column(spark, [v]), {"x": "decimal"}, units={"x": ["km"]}).first()["x"]
        for v in ["12.0 km", "2,2", "n/a", " 7 "]
    }
    assert whole == single == {12.0, 2.2, None, 7.0}


def test_large_vocabulary_table(spark):
    table = spark.createDataFrame([("f", "femme"), ("h", "homme")], "variante string, canonique string")
    got = prepare.recode_by_table(column(spark, ["f", "h", "autre"]), "x", table)
    assert sorted(r["x"] for r in got.collect()) == ["autre", "femme", "homme"]


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    a = prepare.table_fingerprint(df).first()
    assert a == prepare.table_fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a != prepare.table_fingerprint(df.where("id <> 3")).first()

import random
import zlib

import numpy as np
import pytest

from lodestat.llm import catalog_models, flat, quality, toxicity
from tests.llm.data import SCHEMA, awkward, table

FOLDER = "/root/testdata/sf0.1"


def _area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y.sum()
    return (rank[y].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize(
    "query, label, folds, fold, least, right",
    [(catalog_models.op5, "toxic", 5, 0, 0.92, 0.95), (catalog_models.op8, "quality", 3, 1, 0.99, 0.98)],
)
def test_held_out_accuracy(spark, query, label, folds, fold, least, right):
    found = query(spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(rows) == 10_000
    assert all(h == (zlib.crc32(str(k).encode()) % folds == fold) for k, h in zip(rows.doc_id, rows.held_out))
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    held = rows[rows.held_out & rows[label].notna()]
    assert _area((held[label] == 1).to_numpy(), held.score.to_numpy()) > least
    assert ((held[label] == 1) == (held.predicted == 1)).mean() > right


def test_one_class_and_nothing_to_learn():
    shape = np.random.default_rng(1).random((5, 16))
    for good, kept in [(np.ones(5, bool), True), (np.zeros(5, bool), False), (np.zeros(0, bool), True)]:
        model = quality.train(shape[: len(good)], good)
        assert ((model.score(shape) >= 0.5) == kept).all()
    words = [np.array([1, 2]), np.array([3])]
    assert toxicity.train([], words, 0.1).constant < 0
    assert toxicity.train(words, words, 0.0).constant < 0 < toxicity.train(words, words, 1.0).constant


def test_quantile_cut_is_the_best():
    draw = np.random.default_rng(2)
    for _ in range(50):
        raw, good = draw.integers(0, 8, 12).astype(float), draw.random(12) < 0.6
        cut = quality.quantile_cut(raw, good)
        errors = ((raw >= cut) != good).sum()
        assert errors == min(((raw >= c) != good).sum() for c in np.arange(-1, 9, 0.5))


def test_risk_is_held_at_zero():
    """Unlabelled texts that are toxic are found although no one says so."""
    draw = random.Random(3)
    def text(bad):
        words = {draw.randrange(100, 5000) for _ in range(30)}
        return np.array(sorted(words | ({draw.randrange(5)} if bad else set())))
    positive = [text(True) for _ in range(200)]
    unlabelled = [text(k % 5 == 0) for k in range(1000)]
    model = toxicity.train(positive, unlabelled, 0.2)
    row = np.repeat(np.arange(1000), [len(u) for u in unlabelled])
    raw = model.raw(row, np.concatenate(unlabelled), 1000)
    assert ((raw >= 0) == (np.arange(1000) % 5 == 0)).mean() > 0.98


def test_awkward_rows(spark):
    docs = table(spark, awkward(5))
    labels = spark.createDataFrame([(9, 1, 0), (20, 0, 1), (None, 1, 1), (21, None, None), (22, 1, 0)], "doc_id bigint, quality int, toxic int")
    good, bad = quality.learn(docs, labels), toxicity.learn(docs, labels)
    for found in (quality.scored(docs, good), toxicity.scored(docs, bad)):
        assert found.count() == docs.count()
        assert found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = quality.accepted(docs, good)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = quality.scored(docs, good).where("score >= 0.5").count()
    assert kept.count() == want
    none = docs.where("false")
    assert quality.accepted(none, quality.learn(none, labels)).count() == 0
    assert toxicity.scored(none, toxicity.learn(none, labels.where("false"))).count() == 0
    assert spark.createDataFrame([], SCHEMA).columns == docs.columns


def test_one_text_a_key_is_learned_from(spark, monkeypatch):
    """A key that many rows share adds one row to the sample, whatever the order of the rows."""
    rows = [(k, f"plain words number {k} of a text") for k in range(40)]
    hot = [(7, f"copy {k} under one key") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    seen = []
    keep = quality.train
    monkeypatch.setattr(quality, "train", lambda values, good: seen.append((len(values), int(good.sum()))) or keep(values, good))
    models = [quality.learn(table(spark, rows + hot, parts), labels) for parts in (1, 5)]
    assert seen == [(40, 20)] * 2
    shape = np.random.default_rng(4).random((6, len(quality.features.SHAPE)))
    assert (models[0].score(shape) == models[1].score(shape)).all()
    sizes = []
    learn = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: sizes.append((len(p), len(u))) or learn(p, u, prior))
    toxicity.learn(table(spark, rows + hot), labels)
    toxicity.learn(table(spark, rows + hot), labels, positives=3, unlabelled=5)
    assert sizes == [(14, 40), (3, 5)]


def test_pieces_cover_all_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 3_000_000, None, "", "b" * 10] * 2)], names=["text"])
    sizes = [(rows.num_rows, len(data), offsets.tolist()) for rows, data, offsets in flat.pieces(iter([batch, batch.slice(1, 3)]))]
    assert sum(n for n, _, _ in sizes) == 11 and sum(n for _, n, _ in sizes) == 6_000_030

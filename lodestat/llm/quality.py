"""Quality by Bradley-Terry pairwise ranking.

The chance that text i is better than text j is the logistic of s(i) - s(j), and s is linear in features of how
the texts are written. Preference pairs, a good and a bad labelled text, give the weights by logistic loss on
feature differences. A quantile of the scores then separates what is kept from what goes.

The training sample is bounded by ``SAMPLE``, the labelled rows of the least key hashes, and the pairs by
``PAIRS`` per step; scoring covers every text in whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import features, flat
from lodestat.llm.stored import stored, whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

SAMPLE = 20_000
STEPS, PAIRS, RATE, SHRINK = 600, 2_048, 0.05, 1e-3


@dataclass
class Model:
    """Centre and spread of the features, weights of them and their squares, and where the cut lies."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, shape: np.ndarray) -> np.ndarray:
        z = np.clip((shape - self.centre) / self.spread, -10, 10)
        return np.hstack([z, z**2]) @ self.weights

    def score(self, shape: np.ndarray) -> np.ndarray:
        """In (0, 1); a half at the cut."""
        return 1 / (1 + np.exp(-np.clip((self.raw(shape) - self.cut) / self.scale, -500, 500)))


def quantile_cut(raw: np.ndarray, good: np.ndarray) -> float:
    """The score quantile that separates good from bad with the fewest errors; the lowest of equal ones.

    The cut lies half-way between two neighbouring scores.
    """
    order = np.argsort(raw, kind="stable")
    raw, good = raw[order], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum((~good)[::-1])[::-1], [0]])
    padded = np.concatenate([[raw[0] - 1], raw, [raw[-1] + 1]])
    real = padded[1:] > padded[:-1]  # a cut cannot fall between equal scores
    best = int(np.argmin(np.where(real, errors, len(raw) + 1)))
    return float((padded[best] + padded[best + 1]) / 2)


def train(shape: np.ndarray, good: np.ndarray) -> Model:
    """Fits a model on features and labels; with one class only, every text gets that class."""
    width = shape.shape[1]
    if not len(good) or good.all() or not good.any():
        better = not len(good) or bool(good.all())
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), -1.0 if better else 1.0, 1.0)
    model = Model(shape.mean(0), shape.std(0) + 1e-9, np.zeros(2 * width), 0.0, 1.0)
    z = np.clip((shape - model.centre) / model.spread, -10, 10)
    both = np.hstack([z, z**2])
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    draw = np.random.default_rng(11)
    w, first, second = model.weights, np.zeros(2 * width), np.zeros(2 * width)
    for step in range(1, STEPS + 1):
        apart = both[draw.choice(up, PAIRS)] - both[draw.choice(down, PAIRS)]
        wrong = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        gradient = -(apart * wrong[:, None]).mean(0) + SHRINK * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    raw = model.raw(shape)
    model.cut = quantile_cut(raw, good)
    model.scale = max(float(raw.std()), 1e-9)
    return model


def _shapes(rows: DataFrame, *more: str) -> DataFrame:
    """The named columns and the features of every row."""

    def work(batches):
        for part, data, offsets in flat.pieces(batches):
            numbers = features.shape(data, offsets)
            ends = pa.array(np.arange(0, numbers.size + 1, numbers.shape[1], dtype=np.int32))
            kept = [part.column(part.schema.get_field_index(c)) for c in more]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.ListArray.from_arrays(ends, pa.array(numbers.ravel()))], names=[*more, "shape"]
            )

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in more)
    return rows.select(*more, "text").mapInArrow(work, f"{kinds}shape array<double>")


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, quality) and the texts of ``documents``.

    A key labelled twice counts as good if one label says so; rows of NULL key or label teach nothing. Of several
    texts under one key the one of least features is learned from, so ``sample`` bounds rows as well as keys.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good")
    )
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text"))
    shapes = _shapes(texts.join(F.broadcast(chosen), "doc_id"), "doc_id", "good")
    each = shapes.groupBy("doc_id").agg(F.max("good").alias("good"), F.min("shape").alias("shape"))
    found = each.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # at most ``sample`` rows
    numbers = found.column("shape").combine_chunks()
    values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features.SHAPE))
    return train(values, found.column("good").to_numpy() == 1)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document, in (0, 1), at least a half where it is kept.

    An empty or NULL text has the score of no words; repeated rows and rows without ``doc_id`` are scored alike.
    """
    rows = documents.select("doc_id", whole_text().alias("text"))

    def work(batches):
        for part, data, offsets in flat.pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(model.score(features.shape(data, offsets)))], names=["doc_id", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, score double")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    names = [f"_{k}" for k in range(len(documents.columns))]
    renamed = documents.toDF(*names).withColumn("_text", whole_text(names[documents.columns.index("text")]))

    def work(batches):
        for part, data, offsets in flat.pieces(batches, "_text"):
            keep = pa.array(model.score(features.shape(data, offsets)) >= 0.5)
            yield part.select(names).filter(keep)

    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    return renamed.mapInArrow(work, schema).toDF(*documents.columns)

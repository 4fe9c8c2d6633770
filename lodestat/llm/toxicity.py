"""Toxicity by non-negative learning from positive and unlabelled texts.

Confirmed toxic texts are the positives; texts whose label is not looked at are the unlabelled ones. With the
class prior p the risk of a score f is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second
term estimates the risk on clean texts and, being an estimate that can fall below zero when f overfits, is held
at zero or above; where it is below, the step goes back up along it. The loss is the logistic one.

The training sample is bounded by ``POSITIVES`` and ``UNLABELLED``, the rows of the least key hashes; scoring
covers every text in whole.
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

POSITIVES, UNLABELLED = 4_000, 8_000
BITS = 20
FEATURES = 1_024
STEPS, RATE, SHRINK = 300, 0.1, 1e-4
LEAST_Z = 4.0


@dataclass
class Model:
    """Weights of word slots (``slots`` sorted) and a constant."""

    slots: np.ndarray
    weights: np.ndarray
    constant: float

    def raw(self, row: np.ndarray, slot: np.ndarray, texts: int) -> np.ndarray:
        total = np.full(texts, self.constant)
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[at] == slot
            total += np.bincount(row[hit], weights=self.weights[at[hit]], minlength=texts)
        return total

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, slot = features.vocabulary_rows(data, offsets, BITS)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, slot, len(offsets) - 1), -500, 500)))


def _chosen(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Slots whose share among positives stands out from that among the unlabelled, the clearest first."""
    n, m = len(positive), len(unlabelled)
    p = np.bincount(np.concatenate(positive), minlength=1 << BITS) if n else np.zeros(1 << BITS)
    u = np.bincount(np.concatenate(unlabelled), minlength=1 << BITS) if m else np.zeros(1 << BITS)
    pooled = (p + u) / max(n + m, 1)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / max(n, 1) + 1 / max(m, 1)))
    z = np.where(p >= 3, np.abs(p / max(n, 1) - u / max(m, 1)) / spread, 0)
    order = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(order[z[order] >= LEAST_Z])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fits a model on the word slots of positive and unlabelled texts.

    Without positives, or with a prior of 0, every score is the smallest; with a prior of 1 the largest.
    """
    prior = min(max(prior, 0.0), 1.0)
    none = np.zeros(0, dtype=np.int64)
    if not positive or not unlabelled or prior in (0.0, 1.0):
        return Model(none, np.zeros(0), 5.0 if positive and prior == 1.0 else -5.0)
    slots = _chosen(positive, unlabelled)
    k = len(slots)

    def matrix(texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), k + 1), dtype=np.float32)
        out[:, k] = 1
        for i, text in enumerate(texts):
            at = np.minimum(np.searchsorted(slots, text), max(k - 1, 0))
            if k:
                out[i, at[slots[at] == text]] = 1
        return out

    p, u = matrix(positive), matrix(unlabelled)
    w = np.zeros(k + 1)
    w[k] = -1.0
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        on_p, on_u = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        a, b = 1 / (1 + np.exp(-on_p)), 1 / (1 + np.exp(-on_u))
        clean_risk = np.log1p(np.exp(on_u)).mean() - prior * np.log1p(np.exp(on_p)).mean()
        missed = -prior * (p * (1 - a)[:, None]).mean(0)
        alarms = (u * b[:, None]).mean(0) - prior * (p * a[:, None]).mean(0)
        gradient = -alarms if clean_risk < 0 else missed + alarms
        gradient = gradient + SHRINK * np.append(w[:k], 0.0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(slots, w[:k].astype(np.float64), float(w[k]) - _cut(p @ w, u @ w, prior))


def _cut(on_p: np.ndarray, on_u: np.ndarray, prior: float) -> float:
    """The score from which a text counts as toxic: where the same risk, in counted errors, is least.

    The cut lies half-way between two scores of the sample; of equal cuts the highest is taken.
    """
    scores = np.unique(np.concatenate([on_p, on_u]))
    cuts = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    missed = np.searchsorted(np.sort(on_p), cuts) / len(on_p)
    alarms = 1 - np.searchsorted(np.sort(on_u), cuts) / len(on_u)
    risk = prior * missed + np.maximum(alarms - prior * (1 - missed), 0)
    return float(cuts[len(cuts) - 1 - np.argmin(risk[::-1])])


def _slots_of(rows: DataFrame) -> list[np.ndarray]:
    """The word slots of the texts of a bounded sample, one text a key: of several the one of least slots."""

    def work(batches):
        for part, data, offsets in flat.pieces(batches):
            row, slot = features.vocabulary_rows(data, offsets, BITS)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), slots], names=["doc_id", "slots"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    each = rows.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, slots array<int>")
    each = each.groupBy("doc_id").agg(F.min("slots").alias("slots"))
    found = each.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().column("slots")
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in found]


def _sample(keys: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The texts of the least key hashes, ``most`` keys at most, which bounds what is broadcast.

    Hashes over twice the share that is needed are left out before keys are made distinct.
    """
    about = keys.agg(F.approx_count_distinct("doc_id")).head()[0]
    if about > 2 * most:
        keys = keys.where(F.xxhash64("doc_id") <= F.lit(2**64 * 2 * most // about - 2**63).cast("bigint"))
    chosen = keys.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts.join(F.broadcast(stored(chosen)), "doc_id")


def learn(
    documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> Model:
    """A model of ``labels`` (doc_id, toxic) and the texts of ``documents``.

    Labelled rows with toxic = 1 are the positives, and their share among labelled rows is the class prior.
    Rows of NULL key or label teach nothing.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).head()[0]
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text"))
    toxic = texts.select("doc_id").join(known.where("toxic = 1"), "doc_id", "left_semi")
    seen = _slots_of(_sample(toxic, texts, positives))
    rest = _slots_of(_sample(texts.select("doc_id"), texts, unlabelled))
    return train(seen, rest, prior or 0.0)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document, in (0, 1); an empty or NULL text has the score of no words."""
    rows = documents.select("doc_id", whole_text().alias("text"))

    def work(batches):
        for part, data, offsets in flat.pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(model.score(data, offsets))], names=["doc_id", "score"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, score double")

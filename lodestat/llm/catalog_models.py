"""Queries of the learned scores and of the encoder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lodestat.llm import bpe, fingerprints, quality, toxicity
from lodestat.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def key_fold(folds: int):
    """The fold of a row by the checksum of its key as text; a row without key is in no fold."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _result(scores, held):
    return scores.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op2_byte_bpe")
def op2(spark, folder):
    """All documents encoded by the public ranks, and decoded again."""
    return bpe.round_trip(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    )


@query("op5_toxicity")
def op5(spark, folder):
    """Toxicity of all documents, learned outside fold 0 of 5; texts of that fold are not in the sample."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = key_fold(5) == 0
    model = toxicity.learn(documents.where(~held), labels.where(~held).select("doc_id", "toxic"))
    return _result(toxicity.scored(documents, model), held)


@query("op8_quality_classifier")
def op8(spark, folder):
    """Quality of all documents, learned outside fold 1 of 3."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = key_fold(3) == 1
    model = quality.learn(documents, labels.where(~held).select("doc_id", "quality"))
    return _result(quality.scored(documents, model), held)


@query("op7_document_fingerprints")
def op7(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprints(table(spark, folder, "documents"))

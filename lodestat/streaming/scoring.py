"""Scoring of a stream: each micro-batch is a campaign of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestat.operators.contract import Contract
from lodestat.operators.scoring import cohort_summary, score_cohort, scored_union_refused


def score_stream(
    rows: DataFrame,
    contract: Contract,
    score: Callable,
    out: str,
    checkpoint: str,
    drift: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """Scores, refusals and (if asked) drift of each micro-batch under ``out``.

    Each batch owns its folder and overwrites it, so a batch replayed after a failure leaves one
    copy.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            scored, refused, _ = score_cohort(batch, contract, score, **options)
            scored.write.mode("overwrite").parquet(f"{out}/scores/lot={number}")
            refused.write.mode("overwrite").parquet(f"{out}/refus/lot={number}")
            # The written scores are read back: the models run once per batch.
            read = batch.sparkSession.read
            scored = read.schema(scored.schema).parquet(f"{out}/scores/lot={number}")
            refused = read.schema(refused.schema).parquet(f"{out}/refus/lot={number}")
            summary = cohort_summary(scored_union_refused(scored, refused))
            summary.write.mode("overwrite").parquet(f"{out}/synthese/lot={number}")
            if drift is not None:
                drift(scored).write.mode("overwrite").parquet(f"{out}/derive/lot={number}")
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

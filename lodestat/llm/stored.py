"""Tables written between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.session import materialized

#: Settings of the jobs that write tables: shuffle files go with their job, and Python gets texts in small batches.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The shuffle files of the job are released as soon as its table is whole, so an operator of several
    steps needs the disk of its largest step and not of all of them.
    """
    spark = df.sparkSession
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return materialized(df)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def doc_key(column: str = "doc_id"):
    """``doc_id`` as a join key: NULL becomes the smallest number, so it joins and sorts first."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(-(2**63)).cast("bigint"))


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

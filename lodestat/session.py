"""Session helpers shared by every operator."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_GROUPS = 100_000


def new_session(app: str = "lodestat", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _on_this_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session that runs on this machine alone may fall back on a scratch folder: on a
    cluster a machine-local folder would be lost with the executor that wrote it.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _on_this_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder, and read back.

    For an intermediate result that several branches of a plan read: it is computed once, its
    lineage is cut, a lost executor costs a re-read, and filters and columns are pushed to it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(table: DataFrame, groups: int, limit: int = FEW_GROUPS) -> DataFrame:
    """``table`` (one small row per group) hinted for broadcast when the groups were counted few.

    Beyond the limit there is no hint, and the planner decides on measured sizes.
    """
    return F.broadcast(table) if groups <= limit else table


def ship_by_value(module: str) -> None:
    """Sends the functions of a module's whole package to the tasks themselves: executors need no install.

    The package and not the module alone, as what a function uses from other modules would be sent by name.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module.partition(".")[0]])

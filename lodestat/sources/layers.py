"""Written tables: layers, scores, exports, archived runs."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators.scoring import export_table, score_table
from lodestat.session import materialized, ship_by_value
from lodestat.sources import store

ship_by_value(__name__)

RANGE = 4 << 20


def received_ranges(spark: SparkSession, source: str, size: int = RANGE) -> DataFrame:
    """(fichier, bloc, rang, lignes, octets, sha256, contenu): the files of ``source`` as bytes, in ranges.

    Large files are split between tasks. A range holds whole stretches up to a line end and some ``size`` bytes, more
    where a line is longer; the contents of a file in order of (bloc, rang) are its bytes, marks at its head and any
    encoding included. Compressed files, which cannot be split, are one range. Spark passes over
    empty files, which have none.
    """
    listed = spark.read.format("binaryFile").load(source).select(F.col("_metadata.file_path").alias("fichier"), "length")
    packed = F.lower("fichier").rlike(r"\.(gz|bz2|zst|zstd|lz4|snappy|deflate)$")
    # Between line ends Spark's reader hands on bytes as they are; only a mark at the head and the last end are lost.
    lines = spark.read.text(source, lineSep="\n").select(
        F.col("_metadata.file_path").alias("fichier"),
        F.col("_metadata.file_block_start").alias("bloc"),
        F.col("value").cast("binary").alias("contenu"),
    ).where(~packed)

    def gather(batches):
        place, part, held, count = None, 0, [], 0

        def whole():
            data = b"".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([place[0]]), pa.array([place[1]], type=pa.int64()), pa.array([part], type=pa.int32()),
                 pa.array([len(held)], type=pa.int64()), pa.array([data], type=pa.binary())],
                names=["fichier", "bloc", "rang", "lignes", "contenu"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for file, block, line in zip(*columns):
                if (file, block) != place or count >= size:
                    if held:
                        yield whole()
                    part = part + 1 if (file, block) == place else 0
                    place, held, count = (file, block), [], 0
                held.append(line + b"\n")
                count += len(line) + 1
        if held:
            yield whole()

    schema = "fichier string, bloc bigint, rang int, lignes bigint, contenu binary"
    ranges = materialized(lines.mapInArrow(gather, schema))
    facts = ranges.groupBy("fichier").agg(
        F.sum(F.octet_length("contenu")).alias("_octets"), F.max(F.struct("bloc", "rang")).alias("_fin")
    )
    # Bytes read against bytes there: 3 more there are a mark, 1 fewer a last line without end.
    known = ranges.join(listed.select("fichier", "length"), "fichier").join(facts, "fichier")
    marked = (F.col("length") - F.col("_octets")).isin(2, 3) & (F.col("bloc") == 0) & (F.col("rang") == 0)
    unended = (F.col("length") - F.col("_octets")).isin(-1, 2) & (F.struct("bloc", "rang") == F.col("_fin"))
    ended = F.when(unended, F.expr("substring(contenu, 1, octet_length(contenu) - 1)")).otherwise(F.col("contenu"))
    content = F.when(marked, F.concat(F.expr("X'EFBBBF'"), ended)).otherwise(ended)
    split = known.select("fichier", "bloc", "rang", "lignes", content.alias("contenu"))
    alone = listed.join(facts, "fichier", "left_anti").select("fichier")  # packed, or a mark and nothing else
    whole = (
        spark.read.format("binaryFile").load(source).withColumn("fichier", F.col("_metadata.file_path"))
        .join(alone, "fichier", "left_semi")
        .select("fichier", F.lit(0).cast("bigint").alias("bloc"), F.lit(0).alias("rang"), F.lit(None).cast("bigint").alias("lignes"), F.col("content").alias("contenu"))
    )
    every = split.unionByName(whole)
    return every.select(
        "fichier", "bloc", "rang", "lignes", F.octet_length("contenu").cast("bigint").alias("octets"), F.sha2("contenu", 256).alias("sha256"), "contenu"
    )


def damaged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges whose content no longer has its checksum."""
    return ranges.where(~F.sha2("contenu", 256).eqNullSafe(F.col("sha256")))


def write_layers(
    spark: SparkSession, source: str, silver: DataFrame, gold: DataFrame, root: str
) -> None:
    """Bronze (the bytes received, in ranges with their checksums), silver and gold under ``root``."""
    received_ranges(spark, source).write.mode("overwrite").parquet(f"{root}/bronze")
    silver.write.mode("overwrite").parquet(f"{root}/silver")
    gold.write.mode("overwrite").parquet(f"{root}/gold")


def write_scores(scored: DataFrame, path: str, as_csv: bool = False) -> None:
    table = score_table(scored)
    if as_csv:
        table.write.mode("overwrite").csv(path, header=True)
    else:
        table.write.mode("overwrite").parquet(path)


def export_campaign(both: DataFrame, path: str) -> None:
    """The campaign as text for a spreadsheet: ``;`` between cells, decimal commas."""
    export_table(both).write.mode("overwrite").csv(path, header=True, sep=";", emptyValue="")


def run_record(spark: SparkSession, facts: Mapping[str, object]) -> DataFrame:
    """One flat row that describes a run (version, seed, rows, threshold, metrics…)."""
    names = sorted(facts)
    return spark.createDataFrame(
        [tuple(float(v) if isinstance(v, int | float) else str(v) for v in map(facts.get, names))],
        ", ".join(
            f"`{n}` {'double' if isinstance(facts[n], int | float) else 'string'}" for n in names
        ),
    )


def archive_run(record: DataFrame, root: str, stamp: str, version: str) -> str:
    """Adds the run to the history, then points to it. Older runs stay.

    The record is whole before the pointer, one small new file, is there, so a failure in between leaves the old
    current run. ``current`` is a copy of the pointed record for readers that know no pointers.
    """
    name = f"{stamp}_v{version}"
    record.write.mode("overwrite").parquet(f"{root}/history/run={name}")
    point_to(record.sparkSession, root, name)
    return name


def point_to(spark: SparkSession, root: str, name: str) -> None:
    """Makes an archived run the current one, be it the newest or an earlier one."""
    if not store.exists(spark, f"{root}/history/run={name}/_SUCCESS"):
        raise ValueError(f"run {name} is not whole in the history of {root}")
    pointers = [int(n) for n in store.names(spark, f"{root}/pointers") if n.isdigit()]
    store.write_once(spark, f"{root}/pointers/{max(pointers, default=0) + 1:08d}", name)
    current_run(spark, root).write.mode("overwrite").parquet(f"{root}/current")


def current_name(spark: SparkSession, root: str) -> str | None:
    """The run that the last pointer names; none before the first."""
    pointers = [n for n in store.names(spark, f"{root}/pointers") if n.isdigit()]
    return store.read_text(spark, f"{root}/pointers/{pointers[-1]}") if pointers else None


def current_run(spark: SparkSession, root: str) -> DataFrame:
    """The record of the current run, with its name in ``run``."""
    name = current_name(spark, root)
    if name is None:
        raise ValueError(f"{root} has no current run")
    return spark.read.parquet(f"{root}/history/run={name}").withColumn("run", F.lit(name))


def rollback(spark: SparkSession, root: str, name: str | None = None) -> str:
    """Points back to ``name``, or to the run that was current before this one; its name."""
    if name is None:
        now = current_name(spark, root)
        earlier = [store.read_text(spark, f"{root}/pointers/{n}") for n in store.names(spark, f"{root}/pointers") if n.isdigit()]
        earlier = [n for n in earlier if n != now]
        if not earlier:
            raise ValueError(f"{root} has no run to go back to")
        name = earlier[-1]
    point_to(spark, root, name)
    return name


def history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/history")

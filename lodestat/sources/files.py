"""Delimited files: encoding, delimiter, raw reading, facts about a file."""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.session import ship_by_value

ship_by_value(__name__)

# Fixed values. UTF-32 comes before UTF-16, whose mark is a prefix of its own.
BYTE_ORDER_MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"),
    (codecs.BOM_UTF32_LE, "utf-32"),
    (codecs.BOM_UTF32_BE, "utf-32"),
    (codecs.BOM_UTF16_LE, "utf-16"),
    (codecs.BOM_UTF16_BE, "utf-16"),
)
TRIED_ENCODINGS = ("utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
SNIFFED_CHARACTERS = 8192
_UNDEFINED_IN_CP1252 = "^(?:..)*(?:81|8D|8F|90|9D)"
_FACTS = "path string, encoding string, has_bom boolean, delimiter string, size long"
# Charset names of the JVM for the encodings above.
_JVM_CHARSETS = {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}


def encoding_of(payload: bytes) -> tuple[str, bool]:
    """(encoding, byte order mark present) of a whole file."""
    for mark, name in BYTE_ORDER_MARKS:
        if payload.startswith(mark):
            return name, True
    for name in TRIED_ENCODINGS:
        try:
            payload.decode(name)
            return name, False
        except UnicodeDecodeError:
            pass
    return TRIED_ENCODINGS[-1], False


def delimiter_of(sample: str) -> str:
    """Delimiter of a text sample, or the candidate its header holds most."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        lines = sample.splitlines()
        return max(DELIMITERS, key=(lines[0] if lines else "").count)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, value): the lines of files as bytes, cut at line feeds only, split by split."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("binary").alias("value"),
    )


def _heads(lines: DataFrame, characters: int) -> DataFrame:
    """(file, head): the first bytes of each file, enough for so many characters.

    A character has four bytes at most, so lines are taken until those before hold four bytes for each; a task
    keeps at most twice that of a file.
    """
    order = Window.partitionBy("file").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = (
        lines.where("start = 0")
        .withColumn("value", F.expr(f"substring(value, 1, {4 * characters})"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("held", F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0)))
        .where(F.col("held") < 4 * characters)
    )
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))
    return first.groupBy("file").agg(F.transform(listed, lambda x: x["value"]).alias("head"))


def _describe(characters: int):
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for path, size, lines, written, broken, undefined in zip(
                files["path"], files["length"], files["head"], files["written"], files["broken"], files["undefined"]
            ):
                head = b"\n".join(bytes(x) for x in lines) if lines is not None else b""
                # The text reader takes away the mark of UTF-8: a file then has three bytes more
                # than its lines and line feeds.
                marked = size - written >= 2
                name = next((n for mark, n in BYTE_ORDER_MARKS[1:] if head.startswith(mark)), None)
                if name is None:
                    name = "utf-8-sig" if marked else "utf-8" if not broken else "cp1252" if not undefined else "latin-1"
                sample = head.decode(name, errors="replace")[:characters]
                rows.append((path, name, name not in TRIED_ENCODINGS, delimiter_of(sample), size))
            yield pd.DataFrame(rows, columns=["path", "encoding", "has_bom", "delimiter", "size"])

    return describe


def sniff_files(spark: SparkSession, path: str, characters: int = SNIFFED_CHARACTERS) -> DataFrame:
    """(path, encoding, has_bom, delimiter, size), one row per file of a folder or pattern.

    One rule whatever the size: the encoding is that of the whole file, whose lines are tested split by split;
    the delimiter is read off the first ``characters``. Only the head of a file comes to one task. Spark
    passes over empty files, which give no row.
    """
    listed = spark.read.format("binaryFile").load(path).select(
        "path", "length", F.col("_metadata.file_path").alias("file")
    )
    lines = _lines(spark, path)
    facts = lines.groupBy("file").agg(
        (F.sum(F.octet_length("value")) + F.count(F.lit(1))).alias("written"),
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"),
        F.bool_or(F.hex("value").rlike(_UNDEFINED_IN_CP1252)).alias("undefined"),
    )
    whole = listed.join(facts, "file", "left").join(_heads(lines, characters), "file", "left")
    return whole.select(
        "path",
        "length",
        "head",
        F.coalesce("written", F.lit(0)).alias("written"),
        F.coalesce("broken", F.lit(False)).alias("broken"),
        F.coalesce("undefined", F.lit(False)).alias("undefined"),
    ).mapInPandas(_describe(characters), _FACTS)


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    encoding: str = "utf-8",
    multi_line: bool = False,
) -> DataFrame:
    """Every cell as text, no literal turned into an absence; an empty cell is NULL.

    Without ``multi_line`` large files are split between tasks; set it only for files whose
    quoted cells hold line breaks. The wide encodings are always read whole.
    """
    charset = _JVM_CHARSETS.get(encoding, encoding)
    if encoding == "cp1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(
        path, header=True, sep=delimiter, encoding=charset, inferSchema=False,
        multiLine=multi_line or encoding.startswith(("utf-16", "utf-32")),
        quote='"', escape='"', nullValue="", emptyValue="",
    )


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """All files of a folder as one text table, read in groups of like encoding and delimiter."""
    groups = (
        sniff_files(spark, path)
        .groupBy("encoding", "delimiter")
        .agg(F.collect_list("path").alias("paths"))
        .collect()
    )
    parts = [
        read_text_table(spark, sorted(g["paths"]), g["delimiter"], g["encoding"], **options)
        for g in groups
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def table_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, rows that repeat another one entirely."""
    per_row = df.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return per_row.agg(
        F.coalesce(F.sum("_k"), F.lit(0)).alias("n_lignes"),
        F.lit(len(df.columns)).alias("n_colonnes"),
        F.coalesce(F.sum("_k") - F.count(F.lit(1)), F.lit(0)).alias("n_lignes_en_double"),
    )


def inferred_types(
    spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8"
) -> DataFrame:
    """(colonne, type_reel): the type the reader gives each column on its own."""
    charset = _JVM_CHARSETS.get(encoding, encoding)
    read = spark.read.csv(path, header=True, sep=delimiter, encoding=charset, inferSchema=True)
    return spark.createDataFrame(read.dtypes, "colonne string, type_reel string")

"""Registered queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def R(expression: str) -> str:
    """SQL rounding of a computed double, negative zero made positive."""
    return f"(round(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0)"


def rounded(df: DataFrame) -> DataFrame:
    """Every double rounded: the library itself returns unrounded values."""
    changes = {
        f"{name}": (F.round(F.col(f"`{name}`"), DIGITS) + F.lit(0.0))
        for name, kind in df.dtypes
        if kind == "double"
    }
    return df.withColumns(changes) if changes else df


def register(name: str, sql: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(function(spark, folder))
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------------------------
#  Derived tables, written once for Spark and once in SQL.
# ---------------------------------------------------------------------------------------------

_MESSY = """
  o_orderkey,
  concat('ETU-', lpad(cast(o_orderkey AS {text}), 8, '0')) AS ident,
  CASE WHEN o_orderkey % 60 = 7 THEN '   '
       WHEN o_orderkey % 60 = 8 THEN 'n/a'
       WHEN o_orderkey % 4 = 0 THEN concat(cast(o_custkey % 97 AS {text}), ',5 km')
       WHEN o_orderkey % 4 = 1 THEN concat(cast(o_custkey % 89 AS {text}), '.0km')
       ELSE concat(cast(o_custkey % 53 AS {text}), '.25') END AS distance,
  CASE WHEN o_orderkey % 5 = 0 THEN {dmy}
       WHEN o_orderkey % 5 = 1 THEN {dby}
       ELSE {ymd} END AS jour,
  CASE WHEN o_orderkey % 31 = 3 THEN ''
       WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderkey % 3 = 0 THEN ' Général ' ELSE 'general' END
       WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderkey % 3 = 1 THEN 'LETTRES  Modernes' ELSE 'Lettres modernes' END
       WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Géné' ELSE 'gen' END
       ELSE 'Été' END AS filiere,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Oui' ELSE 'O' END
       WHEN o_orderstatus = 'O' THEN 'non'
       ELSE CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'N' END END AS boursier,
  cast(o_custkey AS {text}) AS entier,
  'L1' AS annee,
  cast(NULL AS {text}) AS vide,
  concat('note ', cast((o_custkey * 7919) % 5000 AS {text}), ', suite. fin.') AS commentaire
"""
MESSY_COLUMNS = [
    "ident", "distance", "jour", "filiere", "boursier", "entier", "annee", "vide", "commentaire",
]


def messy(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a hand-typed text table: units, commas, mixed dates, accents, synonyms, blanks."""
    text = _MESSY.format(
        text="string",
        dmy="date_format(o_orderdate, 'dd/MM/yyyy')",
        dby="date_format(o_orderdate, 'dd MMM yyyy')",
        ymd="date_format(o_orderdate, 'yyyy-MM-dd')",
    )
    table(spark, folder, "orders").createOrReplaceTempView("_orders_text")
    return spark.sql(f"SELECT {text} FROM _orders_text")


SQL_MESSY = "messy AS (SELECT " + _MESSY.format(
    text="VARCHAR",
    dmy="strftime(o_orderdate, '%d/%m/%Y')",
    dby="strftime(o_orderdate, '%d %b %Y')",
    ymd="strftime(o_orderdate, '%Y-%m-%d')",
) + " FROM orders)"


def sql_key(expression: str) -> str:
    """Comparison key in SQL."""
    return (
        f"nullif(regexp_replace(strip_accents(lower(trim({expression}))), '\\s+', ' ', 'g'), '')"
    )


_HOLES = """
  l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS q,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS p,
  l_discount AS d,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax END AS t,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS f,
  l_linestatus AS s,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS g,
  CASE WHEN l_orderkey % 19 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y
"""
SQL_HOLES = f"holes AS (SELECT {_HOLES} FROM lineitem)"


def holes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with holes in their numbers and categories."""
    table(spark, folder, "lineitem").createOrReplaceTempView("_lineitem_holes")
    return spark.sql(f"SELECT {_HOLES} FROM _lineitem_holes")


_SCORED = """
  o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
  cast((o_custkey + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END) % 101 AS DOUBLE) / 101 AS p
"""
SQL_SCORED = f"scored AS (SELECT {_SCORED} FROM orders)"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a binary label and a score that has many ties."""
    table(spark, folder, "orders").createOrReplaceTempView("_orders_scored")
    return spark.sql(f"SELECT {_SCORED} FROM _orders_scored")


SQL_SIDES = """ref AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'),
cur AS (SELECT * REPLACE (o_totalprice * 1.2 AS o_totalprice) FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00')"""


def sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after a date, the later ones dearer."""
    orders = table(spark, folder, "orders")
    early = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    later = orders.where(~early).withColumn("o_totalprice", F.col("o_totalprice") * F.lit(1.2))
    return orders.where(early), later

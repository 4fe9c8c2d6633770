"""Row contract: each row judged alone, refused with its reasons or accepted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "erreurs"
_WHOLE_ROW = "_modele"
_NO_ERROR = "array<struct<champ:string,message:string>>"


@dataclass(frozen=True)
class Field:
    """One declared field: ``kind`` is ``int``, ``float`` or ``text``."""

    name: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    categories: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    """Fields, rules ``small ≤ large`` across fields, and the columns that carry a reference."""

    fields: tuple[Field, ...]
    at_most: tuple[tuple[str, str], ...] = ()
    references: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def schema_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(colonne, statut): columns the contract does not know, and fields the table lacks."""
    known = set(contract.names) | set(contract.references)
    rows = [(c, "inconnue") for c in df.columns if c not in known]
    rows += [(n, "absente") for n in contract.names if n not in df.columns]
    return df.sparkSession.createDataFrame(rows, "colonne string, statut string")


def _problem(name: str, message: str) -> Column:
    return F.struct(F.lit(name).alias("champ"), F.lit(message).alias("message"))


def _field_errors(spec: Field, df: DataFrame) -> list[Column]:
    """At most one error per field: absence, then type, then range or category."""
    if spec.name not in df.columns:
        return [_problem(spec.name, "champ requis")] if spec.required else []
    cell = F.col(f"`{spec.name}`")
    kind = dict(df.dtypes)[spec.name]
    checks: list[tuple[Column, str]] = []
    if spec.required:
        checks.append((cell.isNull(), "champ requis"))
    if spec.kind in ("int", "float"):
        number = cell.try_cast("double") if kind == "string" else cell.cast("double")
        checks.append((cell.isNotNull() & (number.isNull() | F.isnan(number)), "nombre attendu"))
        if spec.kind == "int":
            checks.append((number != F.floor(number), "entier attendu"))
        if spec.low is not None:
            checks.append((number < spec.low, f"doit être ≥ {spec.low:g}"))
        if spec.high is not None:
            checks.append((number > spec.high, f"doit être ≤ {spec.high:g}"))
    elif spec.categories:
        listed = ", ".join(spec.categories)
        checks.append((~cell.isin(*spec.categories), f"doit être parmi : {listed}"))
    error = F.lit(None)
    for bad, message in reversed(checks):
        error = F.when(bad, _problem(spec.name, message)).otherwise(error)
    return [error]


def validate_rows(df: DataFrame, contract: Contract, forbid_unknown: bool = True) -> DataFrame:
    """``df`` with ``erreurs``: the reasons of refusal of each row, empty when accepted.

    One projection, no shuffle. Rules across fields speak only when every field passes. A cell
    filled in a column the contract does not know refuses its row.
    """
    found: list[Column] = []
    for spec in contract.fields:
        found += _field_errors(spec, df)
    if forbid_unknown:
        known = set(contract.names) | set(contract.references)
        for name in df.columns:
            if name not in known:
                found.append(F.when(F.col(f"`{name}`").isNotNull(), _problem(name, "champ inconnu")))
    by_field = F.filter(F.array(*found), lambda e: e.isNotNull()).cast(_NO_ERROR)
    crossed = [
        F.when(
            F.col(f"`{a}`").try_cast("double") > F.col(f"`{b}`").try_cast("double"),
            _problem(_WHOLE_ROW, f"{a} > {b}"),
        )
        for a, b in contract.at_most
        if a in df.columns and b in df.columns
    ]
    if not crossed:
        return df.withColumn(ERRORS, by_field)
    across = F.filter(F.array(*crossed), lambda e: e.isNotNull()).cast(_NO_ERROR)
    return df.withColumn(ERRORS, by_field).withColumn(
        ERRORS, F.when(F.size(ERRORS) == 0, across).otherwise(F.col(ERRORS))
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.size(ERRORS) == 0).drop(ERRORS)


def refused(judged: DataFrame) -> DataFrame:
    return judged.where(F.size(ERRORS) > 0)


def refusals_by_field(judged: DataFrame, contract: Contract) -> DataFrame:
    """(champ, n): refusals per offending field, fields never at fault included with 0."""
    counted = judged.select(F.explode(f"{ERRORS}.champ").alias("champ")).groupBy("champ").agg(
        F.count(F.lit(1)).alias("n")
    )
    every = judged.sparkSession.createDataFrame([(n,) for n in contract.names], "champ string")
    # At most one row per field and rule on both sides.
    return every.join(F.broadcast(counted), "champ", "full_outer").select(
        "champ", F.coalesce("n", F.lit(0)).alias("n")
    )


def reference_of(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first identifier column that the table has, as text."""
    for name in candidates:
        if name in df.columns:
            return F.col(f"`{name}`").cast("string")
    return F.lit(None).cast("string")

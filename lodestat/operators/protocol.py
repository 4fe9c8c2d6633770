"""Seeded, stratified splits and folds of exact size, without ranking every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.ranks import attach, hash_cuts, seeded_hash
from lodestat.session import FEW_GROUPS

_CLASS, _HASH, _CUTS = "_classe", "_hash", "_coupes"


def _with_cuts(df: DataFrame, key: Sequence[str], stratify: str | None, seed: int, sizes) -> DataFrame:
    """Rows with their hash and the cuts of their class (one small row per class)."""
    hashed = df.withColumn(_HASH, seeded_hash(seed, *key))
    if stratify is None:
        cuts = hash_cuts(hashed, [], _HASH, sizes).withColumnRenamed("coupes", _CUTS)
        return attach(hashed, cuts, [], [_CUTS])
    group = F.coalesce(F.concat(F.lit("="), F.col(stratify).cast("string")), F.lit(""))  # NULL is a class of its own
    classed = hashed.withColumn(_CLASS, group)
    cuts = hash_cuts(classed, [_CLASS], _HASH, sizes).withColumnRenamed("coupes", _CUTS)
    classes = df.agg(F.approx_count_distinct(group)).first()[0]
    return attach(classed, cuts, [_CLASS], [_CUTS], classes <= FEW_GROUPS)


def stratified_split(
    df: DataFrame,
    target: str | None,
    key: Sequence[str],
    test_size: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """``df`` with ``est_test``: in each class, exactly round(n · test_size) rows.

    ``key`` identifies rows; the split depends on the key and the seed only, so it survives any
    change of partitioning and can be extended to new columns.
    """
    size = [F.bround(F.col("n_total") * test_size, 0)]
    cut = F.col(_CUTS)[0]
    marked = _with_cuts(df, key, target, seed, size)
    return marked.withColumn("est_test", F.coalesce(F.col(_HASH) <= cut, F.lit(False))).drop(
        _CLASS, _HASH, _CUTS
    )


def assign_folds(
    df: DataFrame,
    key: Sequence[str],
    n_splits: int = 5,
    seed: int = 0,
    target: str | None = None,
) -> DataFrame:
    """``df`` with ``fold`` in 0…n_splits−1, of equal size within each class (± 1).

    Give ``target`` for a stratified assignment, none for a plain one.
    """
    sizes = [F.floor(F.col("n_total") * i / n_splits) for i in range(1, n_splits)]
    past = F.size(F.filter(_CUTS, lambda c: c < F.col(_HASH)))
    marked = _with_cuts(df, key, target, seed + 1, sizes)
    return marked.withColumn("fold", F.coalesce(past, F.lit(0)).cast("int")).drop(
        _CLASS, _HASH, _CUTS
    )

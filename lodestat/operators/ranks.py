"""Order statistics without a global window.

A window over the whole table would send it to one task. Three ways around it, by need:

* ``running_totals`` / ``average_ranks``: the distinct values of each key are cut into buckets,
  sums run within a bucket only, and the total of the lower buckets (a few hundred numbers per
  key) is added.
* ``quantiles``: a sketch brackets each wanted quantile, rows outside the brackets are only
  counted, and just the few values inside them are summed up in buckets. Exact.
* ``hash_cuts``: seeded hashes are uniform, so their leading bits are balanced buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.session import materialized

_BLOCK = 16
SLOTS = _BLOCK * _BLOCK  # bounds the splitters broadcast per key, and how finely a key is cut
ACCURACY = 10_000  # of the sketch behind quantiles
_HASH_BITS = 14  # leading hash bits that make a bucket
_BUCKET, _SPLITTERS, _COARSE = "_bucket", "_splitters", "_coarse"


def _splitters(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """At most ``SLOTS`` sorted splitters per key: from each hash slot one value, by hash.

    They depend on the set of values alone, not on how rows are spread or in which order partial
    results merge, so every branch of a plan and every retried task sees the same ones. They are
    drawn among distinct values: a value that fills a third of the rows weighs one.
    """
    hashed = F.xxhash64(F.col(value), F.lit("slot"))
    chosen = df.groupBy(*keys, F.pmod(hashed, F.lit(SLOTS)).alias("_slot")).agg(
        F.min_by(value, F.xxhash64(F.col(value), F.lit("pick"))).alias("_pick")
    )
    return chosen.groupBy(*keys).agg(F.sort_array(F.collect_list("_pick")).alias(_SPLITTERS))


def attach(
    df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], few: bool = True
) -> DataFrame:
    """Columns of a table with one row per key. Without keys its single row is a scalar sub-query."""
    if not keys:
        row = table.agg(F.first(F.struct(*columns))).scalar()
        return df.withColumns({c: row.getField(c) for c in columns})
    hinted = F.broadcast(table) if few else table
    return df.join(hinted, list(keys), "left")


def _bucketed(df: DataFrame, keys: Sequence[str], value: str, few: bool) -> DataFrame:
    """Adds the number of splitters at or below the value: whole blocks first, then the rest."""

    def reached(position: Column) -> Column:
        below = F.get(F.col(_SPLITTERS), position) <= F.col(value)
        return F.coalesce(below.cast("int"), F.lit(0))

    coarse = reduce(add, [reached(F.lit(_BLOCK * j - 1)) for j in range(1, _BLOCK + 1)])
    fine = reduce(add, [reached(F.col(_COARSE) * _BLOCK + j) for j in range(_BLOCK)])
    return (
        attach(df, _splitters(df, keys, value), keys, [_SPLITTERS], few)
        .withColumn(_COARSE, coarse)
        .withColumn(_BUCKET, F.col(_COARSE) * _BLOCK + fine)
        .drop(_SPLITTERS, _COARSE)
    )


def _offsets(bucketed: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per key and bucket, the sums of all lower buckets and of the bucket itself."""
    sums = bucketed.groupBy(*keys, _BUCKET).agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"_in_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.col(f"_in_{m}") for m in measures],
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], few: bool = True
) -> DataFrame:
    """Adds ``avant_<measure>``: the sum of the measure over strictly smaller values of the key.

    ``df`` holds one row per key and distinct value. Missing values must be filtered out before.
    The splitters and offsets, at most ``SLOTS + 1`` numbers per key, are broadcast; say
    ``few=False`` when keys are not few, and they are joined as the planner sees fit.
    """
    bucketed = _bucketed(df, keys, value, few)
    offsets = _offsets(bucketed, keys, measures).drop(*[f"_in_{m}" for m in measures])
    within = (
        Window.partitionBy(*keys, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.join(F.broadcast(offsets) if few else offsets, [*keys, _BUCKET])
        .withColumns(
            {
                f"avant_{m}": F.coalesce(F.sum(m).over(within), F.lit(0)) + F.col(f"_off_{m}")
                for m in measures
            }
        )
        .drop(_BUCKET, *[f"_off_{m}" for m in measures])
    )


def average_ranks(freq: DataFrame, keys: Sequence[str], value: str = "valeur") -> DataFrame:
    """Adds ``rang``: the average rank (ties shared) of each distinct value within its key."""
    return (
        running_totals(freq, keys, value, ["n"])
        .withColumn("rang", F.col("avant_n") + (F.col("n") + 1) / 2)
        .drop("avant_n")
    )


def quantiles(
    rows: DataFrame,
    probabilities: Sequence[float],
    keys: Sequence[str] = ("colonne",),
    value: str = "valeur",
    accuracy: int = ACCURACY,
    few: bool = True,
) -> DataFrame:
    """Exact linear-interpolated quantiles: (keys, quantiles array, in the order asked).

    Equal to ``percentile`` without holding every distinct value of a column in one aggregation
    state. The sketch only says where to look; were it ever to miss, the query fails rather than
    answer wrongly. Say ``few=False`` when keys are not few: nothing is broadcast then.
    """
    probs = [float(p) for p in probabilities]
    lines = rows.select(*keys, value, F.lit(1).alias("_w"))
    # A bracket must also cover the neighbouring ranks, which in a small table are wide apart:
    # there a wider margin serves, and below a hundred rows the whole range.
    margins = (4.0 / accuracy, max(0.02, 4.0 / accuracy))

    def shifted(p: float, margin: float) -> float:
        return min(max(p + margin, 0.0), 1.0)

    asked = sorted({shifted(p, s * m) for p in probs for m in margins for s in (-1, 1)})
    sketch = F.percentile_approx(
        F.col(value), F.array(*[F.lit(p) for p in asked]), F.lit(accuracy)
    )
    found = lines.groupBy(*keys).agg(
        sketch.alias("_marks"),
        F.min(value).alias("_least"),
        F.max(value).alias("_most"),
        F.count(F.lit(1)).alias("_rows"),
    )

    def mark(p: float, sign: int) -> Column:
        """End of the bracket of ``p`` on one side."""
        whole = F.col("_least") if sign < 0 else F.col("_most")
        end = whole
        for margin in reversed(margins):
            q = shifted(p, sign * margin)
            inner = F.col("_marks")[asked.index(q)] if 0 < q < 1 else whole
            end = F.when(F.col("_rows") * margin >= 2, inner).otherwise(end)
        return end

    wanted = sorted(set(probs))
    lows = [f"_lo{i}" for i in range(len(wanted))]
    highs = [f"_hi{i}" for i in range(len(wanted))]
    brackets = found.select(
        *keys,
        *[mark(p, -1).alias(c) for p, c in zip(wanted, lows)],
        *[mark(p, 1).alias(c) for p, c in zip(wanted, highs)],
        "_rows",
    )
    v = F.col(value)
    inside = reduce(lambda a, b: a | b, [v.between(F.col(a), F.col(b)) for a, b in zip(lows, highs)])
    # A row between two brackets only counts: it is filed just after the bracket below it.
    gap = F.lit(None)
    for high in highs:
        gap = F.when(v > F.col(high), F.col(high)).otherwise(gap)
    # Values inside a bracket are a small share of the rows but still grow with them: they are written once
    # and summed up in buckets, so no task holds all of a key.
    counted = materialized(
        attach(lines, brackets, keys, [*lows, *highs, "_rows"], few)
        .select(*keys, "_w", "_rows", inside.alias("_exact"), F.when(inside, v).otherwise(gap).alias("_v"))
        .groupBy(*keys, F.struct("_v", (~F.col("_exact")).alias("_after")).alias("_place"))
        .agg(F.sum("_w").alias("_w"), F.max("_rows").alias("_rows"))
    )
    ranked = running_totals(counted, keys, "_place", ["_w"], few).select(
        *keys,
        "_w",
        F.col("_place._v").alias("_v"),
        (~F.col("_place._after")).alias("_exact"),
        (F.col("avant__w") + F.col("_w")).alias("_upto"),
        (F.col("_rows") - 1).alias("_last"),
    )

    def at(position: Column) -> Column:
        hit = (position >= F.col("_upto") - F.col("_w")) & (position < F.col("_upto"))
        checked = F.when(F.col("_exact"), F.col("_v")).otherwise(
            F.raise_error(F.lit("quantile outside its bracket: raise the accuracy")).cast("double")
        )
        return F.max(F.when(hit, checked))

    columns, result = [], []
    for i, p in enumerate(probs):
        exact = F.lit(p) * F.col("_last")
        columns += [at(F.floor(exact)).alias(f"_a{i}"), at(F.ceil(exact)).alias(f"_b{i}")]
        share = F.lit(p) * F.col("_last") - F.floor(F.lit(p) * F.col("_last"))
        result.append(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * share)
    return (
        ranked.groupBy(*keys)
        .agg(*columns, F.max("_last").alias("_last"))
        .select(*keys, F.array(*result).alias("quantiles"))
    )


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """Uniform 64-bit order key: the place of a row in a shuffle that depends on the seed only."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def hash_cuts(
    rows: DataFrame, keys: Sequence[str], hashed: str, sizes: Sequence[Column]
) -> DataFrame:
    """Per key, the hash below or at which lie exactly ``sizes[i]`` rows, as array ``coupes``.

    ``sizes`` are expressions of ``n_total``, the rows of the key; a size of 0 gives NULL. Rows are
    counted per leading bits of the hash, then only the buckets that hold a cut are sorted.
    """
    bucket = F.shiftright(F.col(hashed), 64 - _HASH_BITS)
    lines = rows.select(*keys, hashed, F.lit(1).alias("_w"), bucket.alias(_BUCKET))
    whole = Window.partitionBy(*keys)
    wanted = (
        _offsets(lines, keys, ["_w"])
        .withColumn("n_total", F.sum("_in__w").over(whole))
        .select("*", F.posexplode(F.array(*[s.cast("long") for s in sizes])).alias("_i", "_size"))
        .where(
            (F.col("_size") > F.col("_off__w"))
            & (F.col("_size") <= F.col("_off__w") + F.col("_in__w"))
        )
        .select(*keys, _BUCKET, "_i", "_size", "_off__w")
    )
    order = Window.partitionBy(*keys, _BUCKET).orderBy(hashed)
    found = (
        lines.join(F.broadcast(wanted.select(*keys, _BUCKET).distinct()), [*keys, _BUCKET], "left_semi")
        .withColumn("_place", F.row_number().over(order))
        .join(F.broadcast(wanted), [*keys, _BUCKET])
        .where(F.col("_place") == F.col("_size") - F.col("_off__w"))
    )
    by_cut = F.map_from_entries(F.collect_list(F.struct("_i", hashed)))
    return (
        found.groupBy(*keys)
        .agg(by_cut.alias("_at"))
        .select(*keys, F.array(*[F.col("_at")[i] for i in range(len(sizes))]).alias("coupes"))
    )


def hash_positions(rows: DataFrame, keys: Sequence[str], hashed: str, tie: str) -> DataFrame:
    """Adds ``position``: the 0-based place of each row of the key in hash order."""
    lines = rows.withColumn(_BUCKET, F.shiftright(F.col(hashed), 64 - _HASH_BITS)).withColumn(
        "_w", F.lit(1)
    )
    offsets = _offsets(lines, keys, ["_w"]).drop("_in__w")
    order = Window.partitionBy(*keys, _BUCKET).orderBy(hashed, tie)
    return (
        lines.join(F.broadcast(offsets), [*keys, _BUCKET])
        .withColumn("position", F.row_number().over(order) - 1 + F.col("_off__w"))
        .drop(_BUCKET, "_w", "_off__w")
    )

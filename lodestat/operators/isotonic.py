"""Isotonic regression of labels on scores: pool adjacent violators, bucket by bucket.

Rows are first added up by distinct score. Buckets of successive scores then pool their own violators, which leaves a
rising stack of blocks in each. Stacks are merged in order: in turns, each bucket with the next one and with the one
before, until no block of any bucket is to be pooled with a neighbour's. The order of pooling does not matter, so the
rising sequence that is left is the least-squares fit. A task sees two buckets at once and never all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.session import FEW_GROUPS, materialized, ship_by_value

ship_by_value(__name__)

BUCKET_ROWS = 100_000
_BUCKET, _LOT, _SINCE = "_seau", "_lot", "_avant"


def pooled(first: np.ndarray, last: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[list]:
    """Blocks [first, last, weight, total] in order of score, adjacent ones pooled until their means rise."""
    stack: list[list] = []
    for block in zip(first.tolist(), last.tolist(), weight.tolist(), total.tolist()):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, end, w, t = stack.pop()
            stack[-1][1], stack[-1][2], stack[-1][3] = end, stack[-1][2] + w, stack[-1][3] + t
    return stack


def _pool(blocks: DataFrame, keys: Sequence[str], lot) -> DataFrame:
    """The blocks of each lot of buckets, pooled; a block stays in the bucket of its first score."""
    kinds = dict(blocks.dtypes)
    names = [*keys, _BUCKET, "debut", "fin", "poids", "total", _SINCE]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("debut")
        stack = pooled(*[part[c].to_numpy() for c in ("debut", "fin", "poids", "total")])
        out = pd.DataFrame(stack, columns=["debut", "fin", "poids", "total"])
        place = np.searchsorted(part["debut"].to_numpy(), out["debut"].to_numpy())
        out[_BUCKET] = part[_BUCKET].to_numpy()[place]
        out[_SINCE] = len(part) - len(stack)
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[names]

    return blocks.withColumn(_LOT, lot).groupBy(*keys, _LOT).applyInPandas(work, schema)


def _renumbered(blocks: DataFrame) -> DataFrame:
    """The buckets that still have blocks, numbered without gaps: neighbours must stand side by side."""
    left = sorted(r[0] for r in blocks.select(_BUCKET).distinct().collect())
    number = blocks.sparkSession.createDataFrame(list(zip(left, range(len(left)))), f"{_BUCKET} int, _n int")
    return (
        blocks.join(F.broadcast(number), _BUCKET)
        .withColumn(_BUCKET, F.col("_n"))
        .withColumn(_SINCE, F.lit(0).cast("bigint"))
        .select(blocks.columns)
    )


def isotonic_blocks(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), weight: str | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(keys, debut, fin, poids, valeur): the steps of the rising fit, over scores from ``debut`` to ``fin``.

    Rows without score, label or weight, and of weight 0, are left out; equal scores share their mean. A row with a
    NULL key is its own group of that key.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*keys, F.col(score).cast("double").alias("debut"), F.col(label).cast("double").alias("_y"), w.alias("_w"))
    rows = rows.where(F.col("debut").isNotNull() & ~F.isnan("debut") & F.col("_y").isNotNull() & (F.col("_w") > 0))
    sums = materialized(rows.groupBy(*keys, "debut").agg(F.sum("_w").alias("poids"), F.sum(F.col("_w") * F.col("_y")).alias("total")))
    parts = max(1, -(-sums.count() // bucket_rows))
    placed = sums.repartitionByRange(parts, *[F.col(k) for k in keys], "debut").withColumn(_BUCKET, F.spark_partition_id())
    blocks = placed.select(*keys, _BUCKET, "debut", F.col("debut").alias("fin"), "poids", "total", F.lit(0).cast("bigint").alias(_SINCE))
    # The bucket of a score must not depend on how the sums were read, so it is written before it is used.
    blocks = materialized(_pool(materialized(blocks), keys, F.col(_BUCKET)))
    still, turn = (2 if parts > 1 else 0), 0
    while still:  # ends after an odd and an even turn without change
        blocks = materialized(_pool(_renumbered(blocks), keys, F.floor((F.col(_BUCKET) + turn % 2) / 2)))
        turn += 1
        still = still - 1 if not blocks.where(F.col(_SINCE) > 0).limit(1).count() else 2
    return blocks.select(*keys, "debut", "fin", "poids", (F.col("total") / F.col("poids")).alias("valeur"))


def isotonic_predict(df: DataFrame, score: str, blocks: DataFrame, keys: Sequence[str] = (), name: str = "prediction") -> DataFrame:
    """``df`` with the fitted value of its score: that of the block it falls in, a straight line between two blocks,
    the first or last value outside. NULL without a score or without blocks of its keys.

    Up to ``FEW_GROUPS`` blocks travel to the rows as one sorted array per key. More of them are joined by stretches
    of scores, each cut at a bounded number of quantiles, so a row meets the blocks of its stretch only.
    """
    steps = blocks.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.explode(F.array(F.struct(F.col("debut").alias("s"), F.col("valeur").alias("v")), F.struct(F.col("fin").alias("s"), F.col("valeur").alias("v")))).alias("_p"),
    ).distinct()
    mine = [f"_k{i}" for i in range(len(keys))]
    x = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine)]

    def between(low, high):
        slope = (x - low["s"]) / (high["s"] - low["s"])
        line = F.when(high["s"] == low["s"], low["v"]).otherwise(low["v"] + (high["v"] - low["v"]) * slope)
        return F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(line)

    if blocks.count() <= FEW_GROUPS:
        arrays = steps.groupBy(*mine).agg(F.sort_array(F.collect_list("_p")).alias("_steps"))
        joined = df.join(F.broadcast(arrays), same, "left") if keys else df.crossJoin(F.broadcast(arrays))  # one row
        low = F.get(F.filter("_steps", lambda p: p["s"] <= x), F.size(F.filter("_steps", lambda p: p["s"] <= x)) - 1)
        high = F.get(F.filter("_steps", lambda p: p["s"] >= x), F.lit(0))
        value = F.when(x.isNotNull(), between(low, high))
        return joined.withColumn(name, value).select(*df.columns, name)
    cuts = steps.select(F.col("_p.s").alias("s")).approxQuantile("s", [i / 1000 for i in range(1, 1000)], 0.0005)
    stretch = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.lit(0) + F.col("_s")))
    ordered = Window.partitionBy(*mine).orderBy("_p.s", "_p.v")
    spans = steps.select(*mine, F.col("_p").alias("low"), F.lead("_p").over(ordered).alias("high"), F.lag("_p").over(ordered).alias("_b"))
    first = spans.where("_b IS NULL").select(*mine, F.lit(None).cast(steps.schema["_p"].dataType).alias("low"), F.col("low").alias("high"))
    spans = first.unionByName(spans.drop("_b"))
    at = lambda side, default: F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(side))), F.lit(default))
    low_at = F.when(F.col("low").isNull(), 0).otherwise(at("low.s", 0))
    high_at = F.when(F.col("high").isNull(), len(set(cuts))).otherwise(at("high.s", 0))
    spans = spans.withColumn("_at", F.explode(F.sequence(low_at, high_at)))
    rows = df.withColumn("_s", x).withColumn("_at", stretch)
    inside = (F.col("low").isNull() | (F.col("low.s") <= F.col("_s"))) & (F.col("high").isNull() | (F.col("_s") < F.col("high.s")))
    joined = rows.join(spans.withColumnRenamed("_at", "_at2"), [F.col("_at") == F.col("_at2"), *same, inside], "left")
    return joined.withColumn(name, F.when(F.col("_s").isNotNull(), between(F.col("low"), F.col("high")))).select(*df.columns, name)

"""Permutation noise of association measures, without shuffling the rows.

Permuting one column destroys its link with another and leaves both margins intact, so a draw is
a random table with fixed margins. Tables are drawn from the margins alone: the value counts of
one side, cut into buckets that tasks draw in parallel, and the group sizes of the other side.
The share of each group that falls in each bucket is itself drawn first, down a binary tree whose
forks all tasks of a pair draw alike (seeded), so the buckets together make one exact permutation.
The cost depends on the distinct values, not on the rows.

A side of too many groups is cut into buckets too. A task then draws one block of the table, a bucket of
values by a bucket of groups: the totals of the blocks come down the same tree, and the share of each value
and of each group that falls in the block down trees of their own. Given these shares blocks are independent.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import as_modality
from lodestat.operators.frequencies import present
from lodestat.session import materialized, ship_by_value

ship_by_value(__name__)

VALUES_PER_TASK = 20_000
GROUPS_AT_ONCE = 200_000  # group sizes travel with the tasks, 1.6 MB at most; more groups are drawn by blocks
BLOCK_SIDE = 50_000  # values, and groups, of a block
ROWS_AT_ONCE = 5_000_000  # drawn in one array; more rows are split first
_LOTS = 8  # permutations are spread over this many tasks per bucket
_NUMPY_RANGE = 1_000_000_000  # population that numpy's generator accepts
_PAIR = ["variable_1", "variable_2"]
_DRAWN = "paire int, tirage int, tas int, q double, s array<double>, c array<double>"


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log(x!) in extended precision: the differences taken below stay exact to 1e-6 at 10¹² rows."""
    z = x.astype(np.longdouble) + 1
    shift = np.zeros_like(z)
    for _ in range(8):  # Stirling's series wants a large argument
        low = z < 16
        shift = np.where(low, shift + np.log(np.where(low, z, 1)), shift)
        z = np.where(low, z + 1, z)
    for _ in range(8):
        low = z < 16
        shift = np.where(low, shift + np.log(np.where(low, z, 1)), shift)
        z = np.where(low, z + 1, z)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + np.longdouble(0.918938533204672741780329736406) + series - shift


def _ratio_of_uniforms(rng: np.random.Generator, good, bad, drawn) -> np.ndarray:
    """Hypergeometric numbers for populations of any size, by ratio of uniforms (Stadlober 1990)."""
    good, bad, drawn = (np.asarray(v, dtype="int64") for v in np.broadcast_arrays(good, bad, drawn))
    total = good + bad
    low, high = np.minimum(good, bad), np.maximum(good, bad)
    few = np.minimum(drawn, total - drawn)
    out = np.zeros(good.shape, dtype="int64")
    share = low / np.maximum(total, 1)
    mean = few * share
    deviation = np.sqrt((total - few) * mean * (1 - share) / np.maximum(total - 1, 1) + 0.5)
    width = 1.7155277699214135 * deviation + 0.8989161620588988
    mode = np.floor((few + 1.0) * (low + 1.0) / (total + 2.0)).astype("int64")
    peak = _log_factorial(mode) + _log_factorial(low - mode) + _log_factorial(few - mode) + _log_factorial(high - few + mode)
    end = np.minimum(np.minimum(few, low) + 1.0, np.floor(mean + 0.5 + 16 * deviation))
    open_ = np.flatnonzero((few > 0) & (low > 0))
    while len(open_):
        x, y = 1 - rng.random(len(open_)), rng.random(len(open_))
        w = mean[open_] + 0.5 + width[open_] * (y - 0.5) / x
        inside = (w >= 0) & (w < end[open_])
        at, x, z = open_[inside], x[inside], np.floor(w[inside]).astype("int64")
        height = peak[at] - (
            _log_factorial(z) + _log_factorial(low[at] - z) + _log_factorial(few[at] - z) + _log_factorial(high[at] - few[at] + z)
        )
        taken = 2 * np.log(x) <= height
        out[at[taken]] = z[taken]
        done = np.zeros(len(good), dtype=bool)
        done[at[taken]] = True
        open_ = open_[~done[open_]]
    out = np.where(good > bad, few - out, out)
    return np.where(few < drawn, good - out, out)


def _hypergeometric(rng: np.random.Generator, good, bad, drawn) -> np.ndarray:
    """Hypergeometric numbers of one exact law; numpy draws them up to 10⁹ rows, its own method beyond."""
    if int(np.max(good + bad, initial=0)) < _NUMPY_RANGE:
        return rng.hypergeometric(good, bad, drawn)
    return _ratio_of_uniforms(rng, good, bad, drawn)


def _split(rng: np.random.Generator, available: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """How many of each group fall among ``size`` places, one line per permutation."""
    left = np.full(len(available), size, dtype="int64")
    rest = available.sum(axis=1)
    taken = np.empty_like(available)
    for j in range(available.shape[1] - 1):
        rest = rest - available[:, j]
        taken[:, j] = _hypergeometric(rng, available[:, j], rest, left)
        left = left - taken[:, j]
    taken[:, -1] = left
    return taken


def _share(seeds: list[int], groups: np.ndarray, sizes: np.ndarray, bucket: int, permutations: int) -> np.ndarray:
    """How many rows of each group fall in one bucket, one line per permutation.

    The buckets are the leaves of a binary tree. Each fork splits the groups between its halves with a generator
    of its own, so all tasks agree on every fork and each draws only those above its bucket.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    available = np.tile(groups, (permutations, 1))
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        first = _split(np.random.default_rng([*seeds, low, high]), available, int(before[middle] - before[low]))
        if bucket < middle:
            available, high = first, middle
        else:
            available, low = available - first, middle
    return available


def _block_shares(
    seeds: list[int], counts: np.ndarray, groups: np.ndarray, rows: np.ndarray, columns: np.ndarray,
    i: int, j: int, permutations: int,
) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each value of bucket ``i`` and of each group of bucket ``j`` fall in block (i, j).

    ``counts`` and ``groups`` are those of the two buckets, ``rows`` and ``columns`` the totals of all buckets. All
    tasks draw the totals of the blocks alike; the tasks of one bucket also draw its forks alike.
    """
    before = np.concatenate([[0], np.cumsum(rows)])
    totals = np.tile(columns, (permutations, 1))
    inside = np.tile(groups, (permutations, 1))
    low, high = 0, len(rows)
    while high - low > 1:
        middle = (low + high) // 2
        first = _split(np.random.default_rng([*seeds, 1, low, high]), totals, int(before[middle] - before[low]))
        part = _split(np.random.default_rng([*seeds, 2, low, high, j + 1]), inside, first[:, j])
        if i < middle:
            totals, inside, high = first, part, middle
        else:
            totals, inside, low = totals - first, inside - part, middle
    values = np.tile(counts, (permutations, 1))
    low, high = 0, len(columns)
    while high - low > 1:
        middle = (low + high) // 2
        part = _split(np.random.default_rng([*seeds, 3, low, high, i + 1]), values, totals[:, low:middle].sum(axis=1))
        if j < middle:
            values, high = part, middle
        else:
            values, low = values - part, middle
    return values, inside


def _cells(rng, counts: np.ndarray, groups: np.ndarray, base: int = 0):
    """(value code, group, rows) of the cells of one permuted table, a stretch of values at a time."""
    rows = int(counts.sum())
    if rows == 0:
        return
    if len(counts) == 1:
        seen = np.flatnonzero(groups)
        yield np.full(len(seen), base), seen, groups[seen]
    elif rows <= ROWS_AT_ONCE:
        labels = np.repeat(np.arange(len(groups)), groups)
        rng.shuffle(labels)
        cells, n = np.unique(np.repeat(np.arange(len(counts)), counts) * len(groups) + labels, return_counts=True)
        yield base + cells // len(groups), cells % len(groups), n
    else:
        middle = len(counts) // 2
        first = _split(rng, groups[None, :], int(counts[:middle].sum()))[0]
        yield from _cells(rng, counts[:middle], first, base)
        yield from _cells(rng, counts[middle:], groups - first, base + middle)


class _Sums:
    """What a permuted table leaves of one bucket: all the statistics are sums over its values."""

    def __init__(self, kind: str, counts: np.ndarray, values: np.ndarray, groups: np.ndarray, p: int):
        self.kind, self.counts, self.values, self.groups = kind, counts, values, groups
        self.valid = ~np.isnan(values) if kind != "v" else None
        self.q = np.zeros(p)
        self.s = np.zeros((p, len(groups)))
        self.c = np.zeros((p, len(groups)))

    def add_line(self, i: int, cells: np.ndarray) -> None:
        """Cells of one value, for every permutation."""
        if self.kind == "v":
            self.q += ((cells / self.counts[i]) * (cells / self.groups)).sum(axis=1)
        elif self.valid[i]:
            self.s += cells * self.values[i]
            self.c += cells

    def add_table(self, p: int, codes: np.ndarray, labels: np.ndarray) -> None:
        """Rows of successive values of one permutation: value code, in order, and group label of each."""
        g = len(self.groups)
        if self.kind == "v":
            low, high = int(codes[0]), int(codes[-1]) + 1
            table = np.bincount((codes - low) * g + labels, minlength=(high - low) * g).reshape(-1, g)
            self.q[p] += ((table / self.counts[low:high, None]) * (table / self.groups)).sum()
        else:
            keep = self.valid[codes]
            where, what = labels[keep], self.values[codes[keep]]
            self.s[p] += np.bincount(where, weights=what, minlength=g)
            self.c[p] += np.bincount(where, minlength=g)


def _draw_bucket(rng, sums: _Sums, available: np.ndarray, low: int = 0, high: int | None = None) -> None:
    """Draws the tables of the values [low, high): row by row where that is cheaper and fits in memory.

    A stretch with too many rows for that is halved, the groups being split between the halves first; a
    value on its own takes what is left. Each way draws from the same law.
    """
    permutations, g = available.shape
    high = len(sums.counts) if high is None else high
    counts = sums.counts[low:high]
    rows, lines = int(counts.sum()), high - low
    if lines == 1:
        sums.add_line(low, available)
        return
    by_value = lines * (g - 1) * (15e-6 + permutations * 0.15e-6)
    by_row = permutations * (50e-6 + rows * 25e-9)
    if by_row < by_value and rows <= ROWS_AT_ONCE:
        codes = np.repeat(np.arange(low, high), counts)
        for p in range(permutations):
            labels = np.repeat(np.arange(g), available[p])
            rng.shuffle(labels)
            sums.add_table(p, codes, labels)
        return
    middle = (low + high) // 2
    first = _split(rng, available, int(sums.counts[low:middle].sum()))
    _draw_bucket(rng, sums, first, low, middle)
    _draw_bucket(rng, sums, available - first, middle, high)


def _collect_sizes(freq: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    rows = freq.where(F.col("colonne").isin(names)).orderBy("colonne", "valeur").collect()
    sizes: dict[str, list[int]] = {name: [] for name in names}
    for row in rows:
        sizes[row["colonne"]].append(row["n"])
    return {name: np.array(v, dtype="int64") for name, v in sizes.items()}


def _frequencies(df: DataFrame, names: list[str], numeric: bool) -> DataFrame:
    read = (lambda c: present(df, c).cast("double")) if numeric else (
        lambda c: as_modality(present(df, c))
    )
    wide = df.select(*[read(c).alias(c) for c in names])
    return wide.unpivot([], names, "colonne", "valeur").groupBy("colonne", "valeur").agg(
        F.count(F.lit(1)).alias("n")
    )


def _packed(freq: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(colonne, paquet, n, valeur), one row per bucket in the order of its values, and the totals of the buckets."""
    own = freq.where(F.col("colonne").isin(columns))
    many = {r["colonne"]: math.ceil(r["k"] / BLOCK_SIDE) for r in own.groupBy("colonne").agg(F.count(F.lit(1)).alias("k")).collect()}
    count_of = F.create_map(*[x for c, k in many.items() for x in (F.lit(c), F.lit(k))])
    packed = materialized(
        own.withColumn("paquet", F.pmod(F.xxhash64("valeur"), count_of[F.col("colonne")]).cast("int"))
        .groupBy("colonne", "paquet")
        .agg(F.sum("n").alias("t"), F.sort_array(F.collect_list(F.struct("valeur", "n"))).alias("_p"))
        .select("colonne", "paquet", "t", F.col("_p.n").alias("n"), F.col("_p.valeur").alias("valeur"))
    )
    totals = {c: np.zeros(k, dtype="int64") for c, k in many.items()}
    for r in packed.select("colonne", "paquet", "t").collect():
        totals[r["colonne"]][r["paquet"]] = r["t"]
    return packed, totals


def _drawn_by_blocks(
    left: DataFrame, right: DataFrame, pairs: dict[int, tuple[str, str]], n_permutations: int, seed: int, numeric: bool
) -> DataFrame:
    """What each permuted table leaves of each block of values by groups; ``tas`` is the bucket of the groups."""
    rows, row_totals = _packed(left, sorted({a for a, _ in pairs.values()}))
    columns, column_totals = _packed(right, sorted({b for _, b in pairs.values()}))
    lot_size = math.ceil(n_permutations / _LOTS)
    keys = ["paire", "i", "j", "lot"]

    def spread_over(packed: DataFrame, side: int, own: str, other: str, totals: dict[str, np.ndarray]) -> DataFrame:
        met = [
            F.struct(F.lit(p).alias("paire"), F.lit(len(totals[pair[1 - side]])).alias("k"), F.lit(pair[side]).alias("colonne"))
            for p, pair in pairs.items()
        ]
        return (
            packed.withColumn("_m", F.explode(F.array(*met)))
            .where(F.col("_m.colonne") == F.col("colonne"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_m.k") - 1)))
            .withColumn("lot", F.explode(F.array(*[F.lit(x) for x in range(_LOTS)])))
            .select(F.col("_m.paire").alias("paire"), F.col("paquet").alias(own), other, "lot", "n", "valeur")
        )

    def draw(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        index, i, j, lot = (int(x) for x in key)
        first = lot * lot_size
        permutations = min(lot_size, n_permutations - first)
        if permutations <= 0 or mine.empty or theirs.empty:
            return pd.DataFrame(columns=["paire", "tirage", "tas", "q", "s", "c"])
        a, b = pairs[index]
        counts, groups = (np.asarray(side["n"].iloc[0], dtype="int64") for side in (mine, theirs))
        values = np.asarray(mine["valeur"].iloc[0], dtype="float64") if numeric else None
        seeds = [seed, index, lot]
        inner, outer = _block_shares(seeds, counts, groups, row_totals[a], column_totals[b], i, j, permutations)
        rng = np.random.default_rng([*seeds, 4, i + 1, j + 1])
        q = np.zeros(permutations)
        s, c = (np.zeros((permutations, len(groups) if numeric else 0)) for _ in range(2))
        for p in range(permutations):
            for code, label, n in _cells(rng, inner[p], outer[p]):
                if not numeric:
                    q[p] += ((n / counts[code]) * (n / groups[label])).sum()
                    continue
                valid = ~np.isnan(values[code])
                label, n = label[valid], n[valid]
                s[p] += np.bincount(label, weights=n * values[code[valid]], minlength=len(groups))
                c[p] += np.bincount(label, weights=n, minlength=len(groups))
        return pd.DataFrame(
            {
                "paire": index,
                "tirage": np.arange(first, first + permutations),
                "tas": j,
                "q": q,
                "s": list(s) if numeric else None,
                "c": list(c) if numeric else None,
            }
        )

    mine = spread_over(rows, 0, "i", "j", column_totals)
    theirs = spread_over(columns, 1, "j", "i", row_totals)
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(draw, _DRAWN)


def permutation_draws(
    df: DataFrame, pairs: list[tuple[str, str]], n_permutations: int, seed: int, kind: str
) -> DataFrame:
    """(variable_1, variable_2, tirage, valeur): the measure of each permuted table.

    ``kind``: ``v`` (Cramér), ``eta`` (correlation ratio) or ``spread`` (gap of group means). Only
    group sizes, up to ``GROUPS_AT_ONCE`` of a column, and one total per column and bucket reach the driver.
    """
    numeric = kind != "v"
    firsts, seconds = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    # Written once: sizes, totals, buckets and draws all read these tables, and none the rows again.
    left = materialized(_frequencies(df, firsts, numeric))
    right = materialized(_frequencies(df, seconds, False))
    distinct = {
        r["colonne"]: r["k"]
        for r in right.groupBy("colonne").agg(F.count(F.lit(1)).alias("k")).collect()
    }
    stats = {
        r["colonne"]: r
        for r in left.groupBy("colonne")
        .agg(
            F.count(F.lit(1)).alias("k"),
            *(
                [
                    (F.sum(F.col("n") * F.col("valeur")) / F.sum(F.when(F.col("valeur").isNotNull(), F.col("n")))).alias("mean"),
                    F.sum(F.when(F.col("valeur").isNotNull(), F.col("n"))).alias("filled"),
                ]
                if numeric
                else []
            ),
        )
        .collect()
    }
    if not numeric and any(distinct[b] > stats[a]["k"] for a, b in pairs):
        # V is symmetric: the side with fewer modalities gives the groups.
        flipped = [(b, a) if distinct[b] > stats[a]["k"] else (a, b) for a, b in pairs]
        if any(f != p for f, p in zip(flipped, pairs)):
            drawn = permutation_draws(df, flipped, n_permutations, seed, kind)
            names = F.create_map(
                *[F.lit(x) for (a, b), (c, d) in zip(pairs, flipped) for x in (f"{c}\x00{d}", f"{a}\x00{b}")]
            )[F.concat_ws("\x00", *_PAIR)]
            parts = F.split(names, "\x00")
            return drawn.select(
                parts[0].alias("variable_1"), parts[1].alias("variable_2"), "tirage", "valeur"
            )
    wide = [i for i, (_, b) in enumerate(pairs) if distinct[b] > GROUPS_AT_ONCE]
    narrow = [i for i in range(len(pairs)) if i not in set(wide)]
    sizes = _collect_sizes(right, sorted({pairs[i][1] for i in narrow})) if narrow else {}
    buckets = {c: max(1, math.ceil(stats[c]["k"] / VALUES_PER_TASK)) for c in firsts}
    count_of = F.create_map(*[x for c in firsts for x in (F.lit(c), F.lit(buckets[c]))])
    placed = left.withColumn(
        "paquet", F.pmod(F.xxhash64("valeur"), count_of[F.col("colonne")]).cast("int")
    )
    if numeric:
        centre = {c: stats[c]["mean"] or 0.0 for c in firsts}
        centres = F.create_map(*[x for c in firsts for x in (F.lit(c), F.lit(float(centre[c])))])
        placed = placed.withColumn("valeur", F.col("valeur") - centres[F.col("colonne")])
    totals: dict[str, np.ndarray] = {c: np.zeros(buckets[c], dtype="int64") for c in firsts}
    square: dict[str, float] = dict.fromkeys(firsts, 0.0)
    measured = [F.sum("n").alias("t")]
    if numeric:
        measured.append(F.sum(F.col("n") * F.col("valeur") * F.col("valeur")).alias("ss"))
    for r in placed.groupBy("colonne", "paquet").agg(*measured).collect():
        totals[r["colonne"]][r["paquet"]] = r["t"]
        square[r["colonne"]] += (r["ss"] or 0.0) if numeric else 0.0
    tests = {c: [(i, pairs[i][1]) for i in narrow if pairs[i][0] == c] for c in firsts}
    lot_size = math.ceil(n_permutations / _LOTS)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column, bucket, lot = key
        first = lot * lot_size
        permutations = min(lot_size, n_permutations - first)
        pdf = pdf.sort_values("valeur", na_position="first")
        counts = pdf["n"].to_numpy("int64")
        values = pdf["valeur"].to_numpy("float64") if numeric else np.zeros(len(pdf))
        out = []
        for index, second in tests[column] if permutations > 0 else []:
            groups = sizes[second]
            available = _share([seed, index, lot], groups, totals[column], bucket, permutations)
            sums = _Sums(kind, counts, values, groups, permutations)
            _draw_bucket(np.random.default_rng([seed, index, lot, bucket + 1]), sums, available)
            out.append(
                pd.DataFrame(
                    {
                        "paire": index,
                        "tirage": np.arange(first, first + permutations),
                        "tas": 0,
                        "q": sums.q,
                        "s": list(sums.s) if numeric else None,
                        "c": list(sums.c) if numeric else None,
                    }
                )
            )
        if not out:
            return pd.DataFrame(columns=["paire", "tirage", "tas", "q", "s", "c"])
        return pd.concat(out, ignore_index=True)

    lots = F.explode(F.array(*[F.lit(i) for i in range(_LOTS)]))
    parts = []
    if narrow:
        parts.append(
            placed.where(F.col("colonne").isin([c for c in firsts if tests[c]]))
            .withColumn("lot", lots)
            .groupBy("colonne", "paquet", "lot")
            .applyInPandas(draw, _DRAWN)
        )
    if wide:
        centred = placed.select("colonne", "valeur", "n")
        parts.append(_drawn_by_blocks(centred, right, {i: pairs[i] for i in wide}, n_permutations, seed, numeric))
    drawn = reduce(DataFrame.unionByName, parts)
    name_1 = F.array(*[F.lit(a) for a, _ in pairs])[F.col("paire")]
    name_2 = F.array(*[F.lit(b) for _, b in pairs])[F.col("paire")]
    if kind == "v":
        smaller = F.array(*[F.lit(min(stats[a]["k"], distinct[b])) for a, b in pairs])[F.col("paire")]
        value = F.when(smaller < 2, 0.0).otherwise(
            F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / (smaller - 1))
        )
        per_draw = drawn.groupBy("paire", "tirage").agg(F.sum("q").alias("q"))
    else:
        cells = (
            drawn.select("paire", "tirage", "tas", F.posexplode(F.arrays_zip("s", "c")).alias("g", "_z"))
            .groupBy("paire", "tirage", "tas", "g")
            .agg(F.sum("_z.s").alias("s"), F.sum("_z.c").alias("c"))
        )
        mean = F.when(F.col("c") > 0, F.col("s") / F.col("c"))
        per_draw = cells.groupBy("paire", "tirage").agg(
            F.sum(F.when(F.col("c") > 0, F.col("s") * mean).otherwise(0.0)).alias("between"),
            (F.max(mean) - F.min(mean)).alias("spread"),
        )
        if kind == "eta":
            total = F.array(
                *[F.lit(float(square[a]) if distinct[b] >= 2 else 0.0) for a, b in pairs]
            )[F.col("paire")]
            value = F.when(total > 0, F.sqrt(F.col("between") / total)).otherwise(0.0)
        else:
            value = F.col("spread")
    return per_draw.select(
        name_1.alias("variable_1"), name_2.alias("variable_2"), "tirage", value.alias("valeur")
    )


def permutation_summary(draws: DataFrame, observed: DataFrame, quantile: float = 0.95) -> DataFrame:
    """``observed`` with ``bruit`` (quantile of its draws) and ``p_permutation``.

    p = (1 + draws reaching the observed value) / (1 + draws), never 0. A draw equal to the
    observed value up to rounding counts as reaching it.
    """
    reach = F.col("tire") >= F.col("valeur") - 1e-9 * F.greatest(F.abs("valeur"), F.lit(1.0))
    extra = [c for c in observed.columns if c not in (*_PAIR, "valeur")]
    renamed = draws.select(*_PAIR, F.col("valeur").alias("tire"))
    return (
        renamed.join(F.broadcast(observed), _PAIR)
        .groupBy(*_PAIR, "valeur", *extra)
        .agg(
            F.percentile("tire", F.lit(quantile)).alias("bruit"),
            ((1 + F.count_if(reach)) / (1 + F.count(F.lit(1)))).alias("p_permutation"),
        )
    )


def permutation_test(
    df: DataFrame,
    observed: DataFrame,
    n_permutations: int = 500,
    seed: int = 0,
    kind: str = "v",
    quantile: float = 0.95,
) -> DataFrame:
    """``observed`` pairs with their own noise ceiling and p-value.

    ``observed`` has one row per pair; it is written once, and read for its names and for its values.
    """
    observed = materialized(observed)
    pairs = [(r["variable_1"], r["variable_2"]) for r in observed.select(*_PAIR).collect()]
    pairs.sort()
    draws = permutation_draws(df, pairs, n_permutations, seed, kind)
    return permutation_summary(draws, observed, quantile)


def noise_ceiling(
    df: DataFrame,
    a: str,
    b: str,
    n_permutations: int = 500,
    seed: int = 0,
    quantile: float = 0.95,
    kind: str = "v",
) -> DataFrame:
    """One row: the noise ceiling of the measure of one pair."""
    draws = permutation_draws(df, [(a, b)], n_permutations, seed, kind)
    return draws.groupBy(*_PAIR).agg(F.percentile("valeur", F.lit(quantile)).alias("bruit"))


def cramers_v_noise(df: DataFrame, a: str, b: str, **options) -> DataFrame:
    return noise_ceiling(df, a, b, kind="v", **options)


def correlation_ratio_noise(df: DataFrame, number: str, group: str, **options) -> DataFrame:
    return noise_ceiling(df, number, group, kind="eta", **options)

"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are trained by rounds of assignment and means, in whole numbers. Most assignments are settled without a scan
of the codebook, by norm-of-sum bounds: a vector keeps, for each part and each group of entries, a lower bound of its
distance to the entries of that group, with the round in which the bound was found by exact distances (its stamp).
All codebooks since then are retained, so in a later round the bound is lowered by the true net displacement of the
group's entries between the two rounds; an entry that moved away and came back costs nothing, where the sum of its
drifts would keep growing. When the distance to the present entry is under every lowered bound, the assignment stands;
otherwise the groups whose bounds are too low are scanned again, exactly, and their bounds get a new stamp.

Distances are whole numbers, squared, so ties go to the lower index exactly. Bounds are floats with a margin for
their rounding, and are compared strictly: a tie is always settled by a scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.stored import stored
from lodestat.session import broadcast_if_few, ship_by_value

ship_by_value(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUPS = 8  # groups of successive entries that share a bound
ROWS = 2048  # vectors whose distances are in memory at once
_SAFE = 1 << 26  # components under it have squared distances of parts in 64 bits
_MARGIN = 1e-6  # relative; bounds are kept in 32 bits


def whole_vectors(table: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, units): floor(``scale`` x) of the components of usable vectors.

    Left out are NULL vectors, those with NULL or non-finite components, and those that cannot be cut into ``parts``
    equal parts or whose length is not that of most vectors (of equally frequent lengths, the greatest). Components
    beyond 2**62 in size count as 2**62.
    """
    kind = dict(table.dtypes)["embedding"]
    rows = table.select("vec_id", "label", F.col("embedding").alias("_v")).where(F.col("_v").isNotNull())
    if kind not in ("array<float>", "array<double>"):
        rows = rows.withColumn("_v", F.col("_v").cast("array<double>"))
    good = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(good & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    lengths = rows.groupBy(F.size("_v").alias("length")).agg(F.count(F.lit(1)).alias("k"))
    usual = lengths.orderBy(F.desc("k"), F.desc("length")).limit(1).collect()
    rows = rows.where(F.size("_v") == (usual[0]["length"] if usual else 0))
    most = float(1 << 62)
    units = F.transform("_v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))))
    return rows.select("vec_id", "label", units.cast("array<bigint>").alias("units"))


def first_codebook(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Whole numbers (parts, entries, width): the vectors of the least ``vec_id``, NULL first, equal ids by components.

    Fewer vectors give fewer entries.
    """
    first = vectors.orderBy(F.asc_nulls_first("vec_id"), "units").limit(entries).select("units").collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=object)
    units = np.array([r["units"] for r in first], dtype=object)
    return units.reshape(len(first), parts, -1).transpose(1, 0, 2)


def _squares(units: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of the parts of vectors to entries; whole numbers."""
    step = units[:, None, :] - entries[None, :, :]
    return (step * step).sum(axis=2)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def displacements(history: list[np.ndarray], groups: int) -> np.ndarray:
    """(rounds, parts, groups): the most that an entry of a group is away now from where it was in each round."""
    parts, entries = history[0].shape[:2]
    out = np.zeros((len(history), parts, groups))
    for stamp, then in enumerate(history):
        step = history[-1] - then
        moved = _roots((step * step).sum(axis=2))
        for g, part in enumerate(np.array_split(np.arange(entries), groups)):
            out[stamp, :, g] = moved[:, part].max(axis=1, initial=0.0)
    return out * (1 + _MARGIN)


class Assigner:
    """Assigns parts to the nearest entries of the last codebook, with the bounds of earlier rounds."""

    def __init__(self, history: list[np.ndarray], groups: int = GROUPS) -> None:
        safe = max((int(abs(h).max()) for h in history if h.size), default=0) < _SAFE
        self.kind = np.int64 if safe else object
        self.history = [h.astype(self.kind) for h in history]
        self.books = self.history[-1]
        self.parts, self.entries = self.books.shape[:2]
        self.members = [m for m in np.array_split(np.arange(self.entries), groups)]
        self.groups, self.stamp = groups, len(history) - 1
        self.moved = displacements(self.history, groups)
        self.scanned = 0  # exact distances computed

    def scan(self, units, part: int, group: int, low, stamps, best, code) -> None:
        """Exact distances of ``units`` to a group, for the best entry so far and for the bounds of the group."""
        members = self.members[group]
        if not len(members):
            return
        squares = _squares(units, self.books[part, members])
        self.scanned += squares.size
        at = squares.argmin(axis=1)
        near = squares[np.arange(len(units)), at]
        better = (near < best) | ((near == best) & (members[at] < code))
        best[better], code[better] = near[better], members[at[better]]
        low[:], stamps[:] = _roots(near) * (1 - _MARGIN), self.stamp

    def assign(self, units: np.ndarray, codes, low, stamps):
        """(codes, low, stamps, squared distances) of whole vectors (rows, components); the first round has no codes."""
        rows = len(units)
        units = units.reshape(rows, self.parts, -1)
        if self.kind is np.int64 and rows and max(abs(int(units.max())), abs(int(units.min()))) >= _SAFE:
            self.kind, self.books = object, self.books.astype(object)
        units = units.astype(self.kind)
        fresh = codes is None
        if fresh:
            codes = np.zeros((rows, self.parts), dtype=np.uint8)
            low = np.zeros((rows, self.parts, self.groups), dtype=np.float32)
            stamps = np.zeros((rows, self.parts, self.groups), dtype=np.uint8)
        out = np.zeros((rows, self.parts), dtype=self.kind)
        for p in range(self.parts):
            own = units[:, p]
            code = codes[:, p].astype(np.int64)
            step = own - self.books[p, code]
            best = (step * step).sum(axis=1)
            self.scanned += rows
            reach = _roots(best) * (1 + _MARGIN)
            for g in range(self.groups):
                bound = low[:, p, g].astype(np.float64) - self.moved[stamps[:, p, g], p, g]
                again = np.arange(rows) if fresh else np.flatnonzero(bound <= reach)
                if len(again):
                    part_low, part_stamp = low[again, p, g], stamps[again, p, g]
                    part_best, part_code = best[again], code[again]
                    self.scan(own[again], p, g, part_low, part_stamp, part_best, part_code)
                    low[again, p, g], stamps[again, p, g] = part_low, part_stamp
                    best[again], code[again] = part_best, part_code
            codes[:, p] = code
            out[:, p] = best
        return codes, low, stamps, out


_STATE = "vec_id {id}, label {label}, units array<bigint>, codes binary, low binary, stamps binary, error bigint"


def _rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _total(errors: np.ndarray) -> pa.Array:
    """Sum over parts; NULL where it does not fit into 64 bits."""
    if errors.dtype == np.int64:
        return pa.array(errors.sum(axis=1))
    return pa.array([int(e) if e < 1 << 63 else None for e in errors.sum(axis=1)], type=pa.int64())


def assigned(vectors: DataFrame, history: list[np.ndarray], groups: int = GROUPS) -> DataFrame:
    """``vectors`` with codes, bounds and stamps of the last codebook of ``history``; a table that is written."""
    kinds = dict(vectors.dtypes)
    width = history[0].shape[0] * history[0].shape[2]
    parts = history[0].shape[0]
    shared = vectors.sparkSession.sparkContext.broadcast(history)
    known = "codes" in vectors.columns

    def work(batches):
        assigner = Assigner(shared.value, groups)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                n = batch.num_rows
                state = (None, None, None)
                if known:
                    shapes = ((np.uint8, (n, parts)), (np.float32, (n, parts, groups)), (np.uint8, (n, parts, groups)))
                    state = tuple(
                        np.frombuffer(b"".join(_rows(batch, c).to_pylist()), dtype=d).reshape(s).copy()
                        for c, (d, s) in zip(("codes", "low", "stamps"), shapes)
                    )
                codes, low, stamps, errors = assigner.assign(_matrix(_rows(batch, "units"), width), *state)
                yield pa.RecordBatch.from_arrays(
                    [
                        _rows(batch, "vec_id"), _rows(batch, "label"), _rows(batch, "units"),
                        *[pa.array([x.tobytes() for x in a], type=pa.binary()) for a in (codes, low, stamps)],
                        _total(errors),
                    ],
                    names=["vec_id", "label", "units", "codes", "low", "stamps", "error"],
                )

    return stored(vectors.mapInArrow(work, _STATE.format(id=kinds["vec_id"], label=kinds["label"])))


def moved_codebook(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The means of the parts assigned to each entry, rounded down; entries without parts stay.

    Each task adds up its own parts; one row per part and entry reaches the driver.
    """
    parts, entries, span = books.shape

    def work(batches):
        sums, counts = np.zeros((parts, entries, span), dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            units = _matrix(_rows(batch, "units"), parts * span).reshape(-1, parts, span)
            codes = np.frombuffer(b"".join(_rows(batch, "codes").to_pylist()), dtype=np.uint8).reshape(-1, parts)
            safe = not units.size or max(abs(int(units.max())), abs(int(units.min()))) < 1 << 40
            for p in range(parts):
                part = np.zeros((entries, span), dtype=np.int64 if safe else object)
                np.add.at(part, codes[:, p], units[:, p] if safe else units[:, p].astype(object))
                sums[p] += part
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                    pa.array([[str(x) for x in sums[i, j]] for i, j in zip(p, e)], type=pa.list_(pa.string())),
                ],
                names=["part", "entry", "k", "sums"],
            )

    partial = rows.select("units", "codes").mapInArrow(work, "part int, entry int, k bigint, sums array<string>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(span)]
    moved = books.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("k").alias("k"), *sums).collect():
        moved[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["k"] for i in range(span)]
    return moved


def compress(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, units, codes, low, stamps, error) of all usable vectors, and the codebooks of all rounds.

    At most 256 entries, as a code is one byte. Repeated vectors are coded alike, each on its own row.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    vectors = stored(whole_vectors(table, parts, scale))
    history = [first_codebook(vectors, parts, entries)]
    if not history[0].size:
        empty = "vec_id {id}, label {label}".format(id=dict(vectors.dtypes)["vec_id"], label=dict(vectors.dtypes)["label"])
        schema = empty + ", units array<bigint>, codes binary, low binary, stamps binary, error bigint"
        return table.sparkSession.createDataFrame([], schema), history
    rows = assigned(vectors, history)
    for _ in range(rounds):
        history.append(moved_codebook(rows, history[-1]))
        rows = assigned(rows, history)
    return rows, history


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(table: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all usable vectors.

    ``code`` has two hexadecimal digits per part. ``error`` is the squared distance to the coded vector and
    ``label_error`` its sum over rows of the same label, NULL labels together; both are NULL beyond 64 bits.
    """
    rows, history = compress(table, **options)
    coded = rows.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error"))
    totals = broadcast_if_few(totals, totals.count())
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(history[-1])).alias("codebooks_sha256"))

"""Suffix-array dedup over bytes, with a logarithmic family of indexes.

Documents arrive in batches, in the order of ``doc_id``. The suffixes of a batch that can start a match of
``WINDOW`` bytes are sorted into its suffix array: (lead, rest), by their first eight bytes and then by the
hash of their first ``WINDOW`` bytes, one entry per distinct beginning. The array is merge-scanned against the
levels, the arrays of all earlier batches, for long matches; then it joins the family, where two neighbours of
equal size merge into one of twice the size. After b batches there are at most log2(b) + 1 levels, and each
entry has been rewritten at most log2(b) times.

Suffixes whose anchor occurs once in the corpus, and those inside longer matches that were settled whole (see
``repeats``), cannot add anything and get no entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import flat
from lodestat.llm.repeats import removed_units, settled_runs, window_rows, with_spans
from lodestat.llm.stored import stored
from lodestat.session import ship_by_value

ship_by_value(__name__)

WINDOW = 100
SEED = 32
CELL = 8
BATCHES = 4
_ENTRY = ["lead", "rest"]


class SuffixLevels:
    """Sorted arrays of entries, the largest first; sizes are counted in batches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def scan(self, array: DataFrame) -> DataFrame:
        """``array`` with ``old``: whether a level holds the entry."""
        held = None
        for _, level in self.levels:
            common = array.select(_ENTRY).join(level, _ENTRY, "left_semi")
            held = common if held is None else held.unionByName(common)
        if held is None:
            return array.withColumn("old", F.lit(False))
        marks = held.withColumn("held", F.lit(True))
        return array.join(marks, _ENTRY, "left").withColumn("old", F.coalesce("held", F.lit(False))).drop("held")

    def add(self, scanned: DataFrame) -> None:
        """Takes in the entries of a scanned array that no level holds, and merges equal sizes."""
        self.levels.append((1, scanned.where("NOT old").select(_ENTRY)))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, new), (_, old) = self.levels.pop(), self.levels.pop()
            merged = old.unionByName(new).repartition(*_ENTRY).sortWithinPartitions(*_ENTRY)
            self.levels.append((2 * size, stored(merged)))


def _cuts(documents: DataFrame, batches: int) -> list[int]:
    """At most ``batches`` - 1 numbers that cut the documents into batches of about equal rows."""
    shares = [(k + 1) / batches for k in range(batches - 1)]
    found = documents.select(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 10_000).alias("cuts")).head()[0]
    return sorted(set(found or []))


def repeated_runs(documents: DataFrame, window: int = WINDOW, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """(doc, at, n): runs of byte strings that also start earlier, by ``doc_id`` and then by place."""
    settled = settled_runs(documents, "bytes", window, seed, CELL)
    suffixes = stored(window_rows(documents, settled.where("NOT whole"), "bytes", window))
    family = SuffixLevels()
    found = settled.where("whole").select("doc", "at", "n")
    bounds = [None, *_cuts(documents, batches), None]
    for low, high in zip(bounds, bounds[1:]):
        batch = suffixes
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        array = batch.groupBy(*_ENTRY).agg(F.min(F.struct("doc", "at")).alias("head"), F.count(F.lit(1)).alias("k"))
        scanned = stored(family.scan(array).sortWithinPartitions(*_ENTRY))
        later = batch.join(scanned.where("old OR k > 1"), _ENTRY).where(
            F.col("old") | (F.struct("doc", "at") != F.col("head"))
        )
        found = found.unionByName(later.select("doc", "at", F.lit(1).alias("n")))
        if high is not None:
            family.add(scanned)
    return stored(found)


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, seed: int = SEED, batches: int = BATCHES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document.

    A NULL or empty text has no bytes; a text shorter than ``window`` bytes loses none; the first of equal
    texts is kept whole and the others go; repeated rows of one document are returned alike. Cuts may fall
    inside a character, so what is kept is bytes and not text.
    """

    def rest(batches_):
        for rows, data, offsets in flat.pieces(batches_):
            gone = removed_units(rows, offsets, len(data), window)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begins[inner] = gone[inner]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(rows.schema.get_field_index("doc_id")),
                    pa.array(np.diff(offsets)),
                    pa.array(removed.astype(np.int64)),
                    pa.array(spans.astype(np.int64)),
                    pa.array(kept, type=pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    marked = with_spans(documents, repeated_runs(documents, window, seed, batches), "doc_id")
    kind = dict(documents.dtypes)["doc_id"]
    return marked.mapInArrow(
        rest, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )

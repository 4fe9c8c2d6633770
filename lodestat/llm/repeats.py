"""Repeated windows of a corpus: shared steps of the two operators that remove repeats.

A document is a row of units, bytes or words. Windows that share an anchor form runs (see ``flat``), about one
run per thirty bytes or seven words. A window can only recur where its anchor recurs, so

1. anchors that occur once in the corpus are dropped, with all their windows;
2. among the runs of one anchor, equal contexts are settled at once: all but the first are repeats;
3. what is left, runs whose anchor recurs in different contexts, are the edges of repeats. Long ones are cut into
   cells, by the distance of a window from its anchor, and the cells are settled in the same way by what their
   windows have in common and by what they cover;
4. only the windows of what is still open are compared one by one.

Places are (doc, at): ``at`` holds the place in the text in its upper half and a checksum of the text in its
lower half, so that two texts under one ``doc_id`` stay apart. All joins are between stored tables and plain
shuffles, which adaptive execution splits where one anchor is very common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import flat
from lodestat.llm.stored import stored, whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

_PLACE = 32
_COUNT = 16  # a run of n windows whose anchor is d units after its start: n + d * 2**16


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """(doc, tag, text) and the named columns.

    A row without ``doc_id`` is named by 62 bits of its text, below all ids from -2**62 on.
    """
    nameless = F.shiftrightunsigned(F.xxhash64(whole_text()), 2) + F.lit(-(2**63)).cast("bigint")
    return documents.select(
        F.coalesce(F.col("doc_id").cast("bigint"), nameless).alias("doc"), F.crc32(whole_text()).alias("tag"), whole_text().alias("text"), *more
    )


def units_of(kind: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, first): the units of some texts, and where each text begins among them."""
    if kind == "bytes":
        return flat.byte_units(data), offsets
    start, stop, first = flat.word_spans(data, offsets)
    return flat.word_hashes(data, start, stop, lower=False), first


def _column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def runs(documents: DataFrame, kind: str, window: int, seed: int) -> DataFrame:
    """(doc, at, n, seed, context) of every run of windows."""

    def scan(batches):
        for rows, data, offsets in flat.pieces(batches):
            doc, tag = _column(rows, "doc"), _column(rows, "tag")
            units, first = units_of(kind, data, offsets)
            for text, start, count, place, seeds, context in flat.anchored_runs(units, first, window, seed):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[text]),
                        pa.array(((start - first[text]) << _PLACE) | tag[text]),
                        pa.array((count | (place << _COUNT)).astype(np.int32)),
                        pa.array(seeds.view(np.int64)),
                        pa.array(context.view(np.int64)),
                    ],
                    names=["doc", "at", "n", "seed", "context"],
                )

    return keyed(documents).mapInArrow(scan, "doc bigint, at bigint, n int, seed bigint, context bigint")


def _cells(documents: DataFrame, open_runs: DataFrame, kind: str, window: int, size: int) -> DataFrame:
    """(doc, at, n, seed, context) of the cells of some runs: windows ``size`` * c to ``size`` * (c + 1) - 1 units
    before the anchor. The seed is what all windows of such a cell have in common, whichever of them there are."""

    def cut(batches):
        for rows, data, offsets in flat.pieces(batches):
            row, place, count, lead = _spans(rows)
            if not len(row):
                continue
            doc, tag = _column(rows, "doc"), _column(rows, "tag")
            units, first = units_of(kind, data, offsets)
            prefix = flat.prefix_hashes(units)
            many = lead // size - (lead - count + 1) // size + 1
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            row, place, count, lead = (np.repeat(v, many) for v in (row, place, count, lead))
            cell = lead // size - step
            far = np.minimum(lead, cell * size + size - 1)
            near = np.maximum(lead - count + 1, cell * size)
            anchor = first[row] + place + lead
            start, n = anchor - far, far - near + 1
            common = flat.span_hashes(prefix, anchor - cell * size, anchor - cell * size - size + 1 + window)
            context = flat.span_hashes(prefix, start, start + n - 1 + window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[row]),
                    pa.array(((start - first[row]) << _PLACE) | tag[row]),
                    pa.array((n | (far << _COUNT)).astype(np.int32)),
                    pa.array(flat.mix(common + cell.astype(np.uint64)).view(np.int64)),
                    pa.array(context.view(np.int64)),
                ],
                names=["doc", "at", "n", "seed", "context"],
            )

    spans = _packed_spans(open_runs).hint("shuffle_hash")
    return (
        keyed(documents)
        .join(spans, ["doc", "tag"])
        .mapInArrow(cut, "doc bigint, at bigint, n int, seed bigint, context bigint")
    )


def _settle(found: DataFrame) -> DataFrame:
    """(doc, at, n, whole): runs that are repeats as a whole, and runs that are still open.

    A run whose seed occurs once is neither and drops out, as does the first of those with one context.
    """
    often = stored(found.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("seed"))
    again = stored(found.join(often, "seed"))
    mixed = stored(
        again.groupBy("seed").agg((F.min("context") != F.max("context")).alias("mixed")).where("mixed")
    )
    heads = stored(again.groupBy("seed", "context").agg(F.min(F.struct("doc", "at")).alias("head")))
    known = again.join(heads, ["seed", "context"]).withColumn("whole", F.struct("doc", "at") != F.col("head"))
    open_ = known.where("NOT whole").join(mixed.select("seed"), "seed")
    columns = ["doc", "at", "n", "whole"]
    return stored(known.where("whole").select(columns).unionByName(open_.select(columns)))


def settled_runs(documents: DataFrame, kind: str, window: int, seed: int, cell: int = 0) -> DataFrame:
    """(doc, at, n, whole): runs that are repeats as a whole, and runs whose windows are to be compared."""
    settled = _settle(runs(documents, kind, window, seed))
    if not cell:
        return settled
    cells = stored(_cells(documents, settled.where("NOT whole"), kind, window, cell))
    return settled.where("whole").unionByName(_settle(cells))


def _packed_spans(runs_: DataFrame) -> DataFrame:
    """(doc, tag, spans): per document, its runs as place and count in one number each."""
    tag = F.col("at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    place = F.shiftrightunsigned("at", _PLACE)
    return runs_.groupBy("doc", tag.alias("tag")).agg(
        F.collect_set(F.shiftleft(place, _PLACE).bitwiseOR(F.col("n").cast("bigint"))).alias("spans")
    )


def _spans(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, count, anchor) of the packed spans of some rows."""
    column = rows.column(rows.schema.get_field_index("spans"))
    row = np.repeat(np.arange(rows.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    packed = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place, n = packed >> _PLACE, packed & ((1 << _PLACE) - 1)
    return row, place, n & ((1 << _COUNT) - 1), n >> _COUNT


def window_rows(documents: DataFrame, open_runs: DataFrame, kind: str, window: int) -> DataFrame:
    """(doc, at, lead, rest): every window of the given runs; ``lead`` orders windows by how they begin.

    For bytes ``lead`` is the first eight bytes as a number in their order, for words the hash of the first
    half; ``rest`` is the hash of the whole window.
    """

    def expand(batches):
        for rows, data, offsets in flat.pieces(batches):
            row, place, count, _ = _spans(rows)
            if not len(row):
                continue
            doc, tag = _column(rows, "doc"), _column(rows, "tag")
            units, first = units_of(kind, data, offsets)
            prefix = flat.prefix_hashes(units)
            row = np.repeat(row, count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(place, count) + step
            start = first[row] + place
            if kind == "bytes":
                lead = np.zeros(len(start), dtype=np.uint64)
                for k in range(8):
                    lead = (lead << np.uint64(8)) | data[start + k].astype(np.uint64)
                lead ^= np.uint64(1 << 63)
            else:
                lead = flat.span_hashes(prefix, start, start + window // 2)
            rest = flat.span_hashes(prefix, start, start + window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[row]),
                    pa.array((place << _PLACE) | tag[row]),
                    pa.array(lead.view(np.int64)),
                    pa.array(rest.view(np.int64)),
                ],
                names=["doc", "at", "lead", "rest"],
            )

    spans = _packed_spans(open_runs).hint("shuffle_hash")
    return (
        keyed(documents)
        .join(spans, ["doc", "tag"])
        .mapInArrow(expand, "doc bigint, at bigint, lead bigint, rest bigint")
    )


def with_spans(documents: DataFrame, repeats: DataFrame, *more: str) -> DataFrame:
    """All documents (doc, tag, text, the named columns) with their repeated runs, packed, or NULL."""
    spans = _packed_spans(repeats).hint("shuffle_hash")
    return keyed(documents, *more).join(spans, ["doc", "tag"], "left")


def removed_units(
    rows: pa.RecordBatch, first: np.ndarray, total: int, window: int
) -> np.ndarray:
    """True for every unit of some rows that a repeated window covers."""
    row, place, count, _ = _spans(rows)
    start = first[row] + place
    return flat.covered(total, start, start + count - 1 + window)

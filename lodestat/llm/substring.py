"""Substring dedup by words: seed and extend.

Winnowing picks an anchor, a seed of ``SEED`` words, in every window of ``WINDOW`` words, from the words of the
window alone. Documents are joined on recurring anchors. A match is extended both ways from the anchor: runs with
equal contexts match over their whole context, the others are extended window by window. The union of the
repeated windows of a document are its maximal repeats of at least ``WINDOW`` words.
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

WINDOW = 20
SEED = 8


def repeated_runs(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc, at, n): runs of windows that also start earlier, by ``doc_id`` and then by place."""
    settled = settled_runs(documents, "words", window, seed)
    extended = stored(window_rows(documents, settled.where("NOT whole"), "words", window))
    heads = stored(
        extended.groupBy("lead", "rest")
        .agg(F.min(F.struct("doc", "at")).alias("head"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .drop("k")
    )
    later = extended.join(heads, ["lead", "rest"]).where(F.struct("doc", "at") != F.col("head"))
    return stored(
        settled.where("whole").select("doc", "at", "n").unionByName(later.select("doc", "at", F.lit(1).alias("n")))
    )


def _kept_words(window: int):
    def work(batches):
        for rows, data, offsets in flat.pieces(batches):
            start, stop, first = flat.word_spans(data, offsets)
            gone = removed_units(rows, first, len(start), window)
            texts, removed = [], []
            buffer = data.tobytes()
            dropped = np.concatenate([[0], np.cumsum(gone)])
            for k in range(rows.num_rows):
                a, b = first[k], first[k + 1]
                keep = np.flatnonzero(~gone[a:b]) + a
                texts.append(b" ".join([buffer[i:j] for i, j in zip(start[keep].tolist(), stop[keep].tolist())]))
                removed.append(int(dropped[b] - dropped[a]))
            yield rows, texts, np.diff(first), np.array(removed, dtype=np.int64)

    return work


def remove_repeats(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every document; ``kept`` are its remaining words, one space apart.

    A NULL or empty text has no words; a text of fewer than ``window`` words loses none; the first of equal
    texts is kept whole and the others go; repeated rows of one document are returned alike.
    """
    work = _kept_words(window)

    def rest(batches):
        for rows, texts, words, removed in work(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(rows.schema.get_field_index("doc_id")),
                    pa.array(words.astype(np.int64)),
                    pa.array(removed),
                    pa.array([t.decode() for t in texts], type=pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    marked = with_spans(documents, repeated_runs(documents, window, seed), "doc_id")
    kind = dict(documents.dtypes)["doc_id"]
    return marked.mapInArrow(rest, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def cleaned(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The documents, with the text of those that lost words made of the words they keep.

    A text that loses nothing stays as it is, byte by byte; ``n_chars``, where there is one, follows the text.
    """
    work = _kept_words(window)
    others = [c for c in documents.columns if c != "text"]

    def rewrite(batches):
        for rows, texts, _, removed in work(batches):
            before = rows.column(rows.schema.get_field_index("_text")).to_pylist()
            after = [t.decode() if lost else old for t, lost, old in zip(texts, removed, before)]
            columns = [rows.column(rows.schema.get_field_index(f"_{k}")) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(after, type=pa.string())], names=[*(f"_{k}" for k in range(len(others))), "_text"]
            )

    renamed = documents.select(
        "doc_id",
        "text",
        F.col("text").alias("_text"),
        *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)],
    )
    names = [f"_{k}" for k in range(len(others))]
    marked = with_spans(renamed, repeated_runs(documents, window, seed), "_text", *names)
    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in [*names, "_text"])
    back = {n: c for n, c in zip(names, others)} | {"_text": "text"}
    out = marked.mapInArrow(rewrite, schema).select([F.col(n).alias(c) for n, c in back.items()])
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select([f"`{c}`" for c in documents.columns])

"""Phrase collocation mining with Rabin-Karp fingerprints.

Words are byte spans, and numpy prefix polynomials give a 64-bit fingerprint of every run of one to five words, mixed
with its group (the language). A run is frequent only if its parts are, so runs are counted in three passes over the
texts, each behind a filter of what the one before found frequent: words, pairs of words, runs of three to five. A
pass shuffles fingerprints and counts, added up in each task first, and keeps the frequent fingerprints.

Two runs may share a fingerprint; then its count is the sum and none of them is missed. The last pass looks at every
occurrence of a frequent fingerprint: in each piece of text the fingerprint points to one occurrence, the words of
all others are compared with the words there byte by byte, and only these phrases are written out, once each. Their
counts are then added up by text, so the result is exact whatever the fingerprints do.

The filters are bit tables of at most ``FILTER_BITS`` bits: that bounds what is broadcast. A filter that is too full
lets more rows through and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.flat import flat, mix, prefix_hashes, rolling_hashes, span_hashes
from lodestat.llm.stored import stored, whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

LONGEST = 5
PIECE = 1 << 20  # bytes of text whose arrays are in memory at once, more only where no break comes
FILTER_BITS = 1 << 28
BITS_PER_KEY = 16
_BLOCK = 1 << 15  # bits of a bitmap of Spark's bitmap functions
NO_GROUP = "und"  # fixed value: the group of rows without one
_FORK = 64  # parts in which a group is ranked first


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: separates words, ends a run of words, and the random value of a letter, A-Z as a-z."""
    codes = np.arange(256)
    breaks = np.isin(codes, np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8))
    apart = breaks | (codes == 0x20) | (codes == 0x09)
    values = np.random.default_rng(20261130).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return apart, breaks, values


def pieces(batches: Iterator[pa.RecordBatch], breaks: np.ndarray) -> Iterator[tuple]:
    """(bytes, place of each text's end, group key per text, first text) of stretches of the batches' texts.

    A stretch ends where no run of words goes on: at the end of a text or behind a breaking byte.
    """
    for batch in batches:
        data, offsets = flat(batch.column(0))
        keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        while begin < len(data):
            end = begin + PIECE
            if end < len(data):
                doc = int(np.searchsorted(offsets, end, side="left"))
                stop = end = int(offsets[doc])
                for at in range(begin + PIECE, stop, PIECE):  # the next break in the text that is cut
                    found = np.flatnonzero(breaks[data[at : min(at + PIECE, stop)]])
                    if len(found):
                        end = at + int(found[0]) + 1
                        break
            end = min(end, len(data))
            first = int(np.searchsorted(offsets, begin, side="right")) - 1
            last = int(np.searchsorted(offsets, end, side="left"))
            yield batch, data[begin:end], np.minimum(offsets[first + 1 : last + 1], end) - begin, keys[first:last], first
            begin = end


class Words:
    """The words of a stretch of texts, which of them go on to the next word, and fingerprints of their runs."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, keys: np.ndarray, tables) -> None:
        apart, breaks, values = tables
        n = len(data)
        inside = ~apart[data]
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[ends] = True
        self.start = np.flatnonzero(inside & edge[:n])
        self.stop = np.flatnonzero(inside & edge[1:]) + 1
        self.text = np.searchsorted(ends, self.start, side="right")
        self.hashes = span_hashes(prefix_hashes(values[data]), self.start, self.stop)
        self.data = data
        self.group = keys[self.text].astype(np.uint64) if len(self.start) else np.zeros(0, dtype=np.uint64)
        broken = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(breaks[data], out=broken[1:])
        self.goes_on = (broken[self.start[1:]] == broken[self.stop[:-1]]) & (self.text[1:] == self.text[:-1])
        self.prefix = prefix_hashes(self.hashes)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the ``size`` words from each word on, and whether they are one run."""
        count = max(len(self.start) - size + 1, 0)
        whole = np.ones(count, dtype=bool)
        for k in range(size - 1):
            whole &= self.goes_on[k : k + count]
        return mix(rolling_hashes(self.prefix, size) ^ mix(self.group[:count])), whole


def _passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """True for fingerprints that a filter may hold."""
    size = np.uint64(len(bits) * 8 - 1)
    found = np.ones(len(prints), dtype=bool)
    for shift in (np.uint64(0), np.uint64(32)):
        slot = (prints >> shift) & size
        found &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _filter(spark, prints: DataFrame):
    """A broadcast bit table of the fingerprints, with two bits for each; its bytes are at most FILTER_BITS / 8."""
    rows, size = prints.count(), 1 << 16
    while size < min(BITS_PER_KEY * rows, FILTER_BITS):
        size *= 2
    low, high = F.col("fp"), F.shiftrightunsigned("fp", 32)
    places = F.array(*[half.bitwiseAND(F.lit(size - 1)) + 1 for half in (low, high)])  # they count from 1
    slot = prints.select(F.explode(places).alias("slot"))
    blocks = slot.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in blocks.toArrow().to_pylist():
        at = (row["block"] - 1) * (_BLOCK // 8)
        bits[at : at + _BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)[: size // 8]
    return spark.sparkContext.broadcast(bits)


def _texts(documents: DataFrame, group: str) -> DataFrame:
    """(text, key, group) of every document; a NULL text has no words."""
    name = F.coalesce(F.col(group).cast("string"), F.lit(NO_GROUP))
    return documents.select(whole_text().alias("text"), F.xxhash64(name).alias("key"), name.alias("name"))


def _counted(texts: DataFrame, sizes: Sequence[int], filters, least: int) -> DataFrame:
    """(fp, name, n): fingerprints of runs that ``filters`` lets through and that occur ``least`` times.

    Without filters the runs are single words, and rows with a name and no fingerprint count the words of a group.
    """

    def work(batches):
        tables = _tables()
        held, room = [], 0

        def added_up():
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), pa.nulls(len(prints), pa.string()), pa.array(counts.astype(np.int64))],
                names=["fp", "name", "n"],
            )

        for batch, data, ends, keys, first in pieces(batches, tables[1]):
            words = Words(data, ends, keys, tables)
            if not len(words.start):
                continue
            if filters is None:
                found = [words.runs(1)[0]]
                counts = np.bincount(words.text)
                names = batch.column(2).slice(first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(counts), pa.int64()), names, pa.array(counts.astype(np.int64))], names=["fp", "name", "n"]
                )
            else:
                unit, bits = filters
                prints, whole = words.runs(unit)
                good = whole & _passes(bits.value, prints)
                found = []
                for size in sizes:
                    prints, whole = words.runs(size)
                    for k in range(size - unit + 1):
                        whole &= good[k : k + len(whole)]
                    found.append(prints[whole])
            held += found
            room += sum(map(len, found))
            if room >= 1 << 20:
                yield added_up()
                held, room = [], 0
        if held:
            yield added_up()

    rows = texts.mapInArrow(work, "fp bigint, name string, n bigint")
    total = rows.groupBy("fp", "name").agg(F.sum("n").alias("n"))
    return stored(total.where(F.col("fp").isNull() | (F.col("n") >= least)))


def same_words(words: Words, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether words ``here`` and ``there`` (two arrays of places) are alike byte by byte, A-Z as a-z."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    a, b = words.start[here], words.start[there]
    lengths = words.stop[here] - a
    same = lengths == words.stop[there] - b
    lengths = np.where(same, lengths, 0)
    owner = np.repeat(np.arange(len(here), dtype=np.int32), lengths)
    within = np.arange(len(owner), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
    differ = lower[words.data[a[owner] + within]] != lower[words.data[b[owner] + within]]
    same[owner[differ]] = False
    return same


def exact_words(words: Words) -> np.ndarray:
    """A number for each word, the same for equal words only: hashes first, then the bytes."""
    _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    every = np.arange(len(number))
    unlike = np.flatnonzero(~same_words(words, every, first[number]))
    if len(unlike):  # words that share a hash and are not alike get numbers of their own by text
        raw, known = words.data.tobytes(), {}
        number = number.copy()
        for k in unlike.tolist():
            word = raw[words.start[k] : words.stop[k]].lower()
            number[k] = known.setdefault(word, len(first) + len(known))
    return number


def _materialised(texts: DataFrame, longest: int, bits) -> DataFrame:
    """(name, size, phrase, n) of every phrase whose fingerprint passes, counted by its text."""

    def work(batches):
        tables = _tables()
        for batch, data, ends, keys, first in pieces(batches, tables[1]):
            words = Words(data, ends, keys, tables)
            if not len(words.start):
                continue
            number, raw = exact_words(words), data.tobytes().lower()
            start, stop = words.start.tolist(), words.stop.tolist()
            good = None
            for size in range(1, longest + 1):
                prints, whole = words.runs(size)
                whole &= _passes(bits.value, prints)
                if good is not None:  # both parts one word shorter are frequent
                    whole &= good[: len(whole)] & good[1 : len(whole) + 1]
                good = whole
                place = np.flatnonzero(whole)
                if not len(place):
                    break
                _, pointer, group, count = np.unique(prints[place], return_index=True, return_inverse=True, return_counts=True)
                pointer = place[pointer]  # one occurrence of each fingerprint
                unlike = words.group[place] != words.group[pointer[group]]
                for k in range(size):
                    unlike |= number[place + k] != number[pointer[group] + k]
                if unlike.any():  # other phrases of the same fingerprint stand for themselves
                    np.subtract.at(count, group[unlike], 1)
                    pointer = np.concatenate([pointer, place[unlike]])
                    count = np.concatenate([count, np.ones(int(unlike.sum()), dtype=count.dtype)])
                at = pointer.tolist()
                phrases = [b" ".join([raw[start[p + k] : stop[p + k]] for k in range(size)]).decode() for p in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(pa.array(words.text[pointer] + first)),
                        pa.array(np.full(len(at), size, dtype=np.int32)),
                        pa.array(phrases, type=pa.string()),
                        pa.array(count.astype(np.int64)),
                    ],
                    names=["name", "size", "phrase", "n"],
                )

    rows = texts.mapInArrow(work, "name string, size int, phrase string, n bigint")
    return rows.groupBy("name", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(
    documents: DataFrame, group: str = "lang", least: int = 100, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """(name, size, phrase, n) of all phrases of up to ``longest`` words that occur ``least`` times in a group, and
    (name, words): the number of words of each group.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends; words stand between spaces and tabs, and no
    phrase crosses a cut. A NULL text has no words, a NULL group is ``und``; every row counts, repeated ones too.
    """
    spark, texts = documents.sparkSession, _texts(documents, group)
    single = _counted(texts, [1], None, least)
    words = single.where(F.col("fp").isNull()).select("name", F.col("n").alias("words"))
    levels = [single.where(F.col("fp").isNotNull())]
    for unit, sizes in ((1, [2]), (2, [*range(3, longest + 1)])):
        sizes = [k for k in sizes if k <= longest]
        if sizes:
            levels.append(_counted(texts, sizes, (unit, _filter(spark, levels[-1])), least))
    every = reduce(DataFrame.unionByName, [level.select("fp") for level in levels])
    found = _materialised(texts, longest, _filter(spark, every)).where(F.col("n") >= least)
    return stored(found), words


def cut_scores(cuts: DataFrame) -> DataFrame:
    """``cuts`` (with a, l, r, n) and score: floor(1000 a n / (l r)), exact in numbers of 38 digits."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    return cuts.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * _a * _n) DIV (_l * _r)")
    ).drop(*[f"_{c}" for c in wide])


def scored_candidates(phrases: DataFrame, words: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two words and more by their lowest-scoring cut.

    Of cuts with equal scores the one behind the fewest words counts. A phrase that stands inside a longer one of at
    least ``percent`` hundredths of its count is left out.
    """
    parts = phrases.select("name", F.col("phrase").alias("_part"), F.col("n").alias("_f"))
    long = phrases.where("size > 1").withColumn("_w", F.split("phrase", " "))
    cuts = long.select("name", "phrase", "size", F.col("n").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select(
        "name", "phrase", "a", "cut",
        F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("_left"),
        F.array_join(F.slice("_w", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("_right"),
    )
    for side, count in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(parts.select("name", F.col("_part").alias(side), F.col("_f").alias(count)), ["name", side])
    cuts = cut_scores(cuts.join(words.select("name", F.col("words").alias("n")), "name"))
    best = cuts.groupBy("name", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b"))
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    inside = F.flatten(
        F.transform(
            lengths,
            lambda k: F.transform(
                F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " ")
            ),
        )
    )
    cover = (
        long.where("size > 2").select("name", F.col("n").alias("_longer"), F.explode(inside).alias("phrase"))
        .groupBy("name", "phrase").agg(F.max("_longer").alias("_longer"))
    )
    kept = best.join(cover, ["name", "phrase"], "left").where(
        F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))
    )
    return kept.select(F.col("name").alias("lang"), "phrase", "a", "_b.l", "_b.r", "n", "_b.score")


def collocations(
    documents: DataFrame,
    group: str = "lang",
    least: int = 100,
    longest: int = LONGEST,
    percent: int = 100,
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each group, by score, count and text.

    ``a``, ``l``, ``r`` count the phrase and the two sides of its cut, ``n`` the words of the group. A group without
    frequent phrases has no row. A group is ranked in parts first, so one task orders a bounded number of rows.
    """
    found = scored_candidates(*frequent_phrases(documents, group, least, longest), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(_FORK)))
    first = parts.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

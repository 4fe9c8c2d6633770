"""MinHash near-dedup with tensored banding.

Documents with equal shingle sets form a class. Of each class, ``HALVES`` left and ``HALVES`` right half-keys
are made of ``ROWS`` minhashes each, and the key of table (i, j) is left half i with right half j: the
HALVES x HALVES tables cost 2 HALVES ROWS minhashes and not HALVES**2 x 2 ROWS. A pair of similarity s meets in
some table with probability (1 - (1 - s**ROWS)**HALVES)**2, 0.9999 for the defaults at s = 0.8.

Half-keys that only one class has are dropped before the tables are written out, for no table can match on
them. In each bucket the classes are first compared with one hub; what these links join needs no more
comparison. Classes of different components that share a bucket are compared pair by pair, each pair at one
of its keys, unless their rare shingles already show that they are too far apart. Every link is confirmed on
the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import flat
from lodestat.llm.components import components
from lodestat.llm.repeats import _column, keyed
from lodestat.llm.stored import doc_key, stored, whole_text
from lodestat.session import ship_by_value

ship_by_value(__name__)

HALVES = 14
ROWS = 3
RARE = 32


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each text, in order, text after text."""
    start, stop, first = flat.word_spans(data, offsets)
    prefix = flat.prefix_hashes(flat.word_hashes(data, start, stop, lower=True))
    rolling = flat.rolling_hashes(prefix, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(rolling[a : b - size + 1]))
        elif b > a:
            sets.append(flat.span_hashes(prefix, np.array([a]), np.array([b])))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), bounds


def _set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per set, alike for equal sets; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(flat.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    sums = total[bounds[1:]] - total[bounds[:-1]]
    sizes = np.diff(bounds).astype(np.uint64)
    return np.where(sizes > 0, flat.mix(sums + sizes * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def _half_keys(hashes: np.ndarray, bounds: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """Left and right half-keys of each set that is not empty, as one row of 2 x halves numbers."""
    numbers = np.random.default_rng(7).integers(1, 1 << 63, (2, 2 * halves * rows), dtype=np.uint64)
    begins = bounds[:-1][np.diff(bounds) > 0]
    keys = np.zeros((len(begins), 2 * halves), dtype=np.uint64)
    for k in range(2 * halves * rows):
        hashed = hashes * (numbers[0, k] * np.uint64(2) + np.uint64(1)) + numbers[1, k]
        least = np.minimum.reduceat(hashed, begins)
        keys[:, k // rows] = flat.mix(keys[:, k // rows] + least + np.uint64(k + 1))
    return keys


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc, tag, text); the tag has 64 bits, as it tells apart all texts without ``doc_id``."""
    return keyed(documents).withColumn("tag", F.xxhash64("text"))


def sketches(documents: DataFrame, size: int, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """(doc, tag, n, set, half): shingle count, id of the shingle set, and half-keys of every document."""

    def scan(batches):
        for part, data, offsets in flat.pieces(batches):
            hashes, bounds = _shingles(data, offsets, size)
            counts = np.diff(bounds)
            keys = _half_keys(hashes, bounds, halves, rows)
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, 2 * halves, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc")),
                    part.column(part.schema.get_field_index("tag")),
                    pa.array(counts),
                    pa.array(_set_ids(hashes, bounds).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc", "tag", "n", "set", "half"],
            )

    return _keyed(documents).mapInArrow(scan, "doc bigint, tag bigint, n bigint, set bigint, half array<bigint>")


def full_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set, hashes): the whole shingle sets of the classes in ``wanted`` (doc, tag, set)."""

    def scan(batches):
        for part, data, offsets in flat.pieces(batches):
            hashes, bounds = _shingles(data, offsets, size)
            ids = _set_ids(hashes, bounds).view(np.int64)
            take = np.flatnonzero(ids == _column(part, "set"))
            sets = [hashes[bounds[k] : bounds[k + 1]].view(np.int64) for k in take]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[take]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["set", "hashes"],
            )

    rows = _keyed(documents).join(wanted.hint("shuffle_hash"), ["doc", "tag"])
    return rows.mapInArrow(scan, "set bigint, hashes array<bigint>").dropDuplicates(["set"])


def _sets_of(documents: DataFrame, wanted: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(set, hashes) of the wanted classes, written once."""
    return stored(full_sets(documents, classes.join(wanted, "set").select("doc", "tag", "set"), size))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    one = sets.select(F.col("set").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return stored(pairs.join(one, "a").join(two, "b").where(both * 100 >= either * percent).select("a", "b"))


def _tables(halves_of: DataFrame, *columns: str) -> DataFrame:
    """(l, r) and the named columns: the keys of all tables a class is in."""
    return halves_of.select(*columns, F.explode("left").alias("l"), "right").select(
        "l", F.explode("right").alias("r"), *columns
    )


def near_components(
    documents: DataFrame, size: int, percent: int = 80, halves: int = HALVES, rows: int = ROWS
) -> DataFrame:
    """(doc, tag, n, component, first): every document with the least doc key that links reach from it, and the
    least tag under that key."""
    drawn = stored(sketches(documents, size, halves, rows))
    full = drawn.where("n > 0")
    classes = stored(full.groupBy("set", "n").agg(F.min(F.struct("doc", "tag")).alias("_f")).select("set", "n", "_f.*"))
    known = full.join(classes, ["set", "n", "doc", "tag"]).dropDuplicates(["set"])
    half = known.select("set", "n", F.posexplode("half").alias("place", "key"))
    shared = stored(half.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    key = F.col("key")
    halves_of = stored(
        half.join(shared, "key")
        .groupBy("set", "n")
        .agg(
            F.collect_list(F.when(F.col("place") < halves, key)).alias("left"),
            F.collect_list(F.when(F.col("place") >= halves, key)).alias("right"),
            F.sum("k").alias("met"),
        )
        .where((F.size("left") > 0) & (F.size("right") > 0))
    )
    # The hub of a bucket is the class whose half-keys are the most common: of copies, the least edited one.
    buckets = stored(
        _tables(halves_of, "set", "met")
        .groupBy("l", "r")
        .agg(F.max(F.struct("met", "set")).alias("hub"), F.min("set").alias("lo"), F.max("set").alias("hi"))
        .where("lo <> hi")
        .select("l", "r", F.col("hub.set").alias("hub"))
    )
    met = stored(_tables(halves_of, "set", "n").join(buckets, ["l", "r"]).where("set <> hub").select("set", "n", "hub").distinct())
    sizes = classes.select(F.col("set").alias("hub"), F.col("n").alias("hub_n"))
    spokes = stored(
        met.join(sizes, "hub")
        .where(_close("n", "hub_n", percent))
        .select(F.least("hub", "set").alias("a"), F.greatest("hub", "set").alias("b"))
        .distinct()
    )
    near = spokes.select(F.col("a").alias("set")).union(spokes.select("b")).distinct()
    links = _confirmed(spokes, _sets_of(documents, near, classes, size), percent)

    roots = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    rooted = stored(
        halves_of.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    )
    more = _links_across(rooted, spokes, documents, classes, size, percent)
    label = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    if more is not None:
        joined = stored(components(more))
        label = label.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn(
            "root", F.coalesce("top", "root")
        )
    label = stored(label.select("set", "n", "doc", "tag", "root"))
    least = label.groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("_f"))
    least = stored(least.select("root", F.col("_f.doc").alias("component"), F.col("_f.tag").alias("first")))
    placed = stored(label.join(least, "root").select("set", "n", "component", "first"))
    return drawn.join(placed, ["set", "n"], "left").select(
        "doc", "tag", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("first", "tag").alias("first")
    )


def _links_across(
    rooted: DataFrame, checked: DataFrame, documents: DataFrame, classes: DataFrame, size: int, percent: int
) -> DataFrame | None:
    """(u, v): components, by root, that a link joins beyond those already checked; None if there is none."""
    mixed = stored(
        _tables(rooted, "root").groupBy("l", "r").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("l", "r")
    )
    met = _tables(rooted, "set").join(mixed, ["l", "r"]).select("set").distinct()
    sets = _sets_of(documents, met, classes, size)
    able = stored(_able(rooted.join(sets.select("set"), "set"), sets, percent))
    still = stored(
        _tables(able, "root").groupBy("l", "r").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("l", "r")
    )
    rare = stored(_rare(sets.join(able.select("set"), "set")))
    wide = able.join(rare, "set", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>")))
    one = wide.select(F.explode("left").alias("l"), "left", "right", "set", "n", "root", "rare")
    one = one.join(still.select("l").distinct(), "l", "left_semi")
    two = one.toDF("l", "left_b", "right_b", "b", "m", "other", "rare_b")
    # A rare shingle of one class that is none of the other's is in no intersection of theirs.
    both = F.least(
        F.col("n") - F.size(F.array_except("rare", "rare_b")), F.col("m") - F.size(F.array_except("rare_b", "rare"))
    )
    pairs = (
        one.join(two, "l")
        .where((F.col("root") < F.col("other")) & _close("n", "m", percent))
        .where(F.arrays_overlap("right", "right_b"))
        .where(F.array_min(F.array_intersect("left", "left_b")) == F.col("l"))  # each pair at one of its keys
        .where(both * 100 >= (F.col("n") + F.col("m") - both) * percent)
        .select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b"))
    )
    pairs = stored(pairs.join(checked, ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return None
    links = _confirmed(pairs, sets, percent)
    if links.isEmpty():
        return None
    of = rooted.select("set", "root")
    return links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select("u", "v")


def _able(rooted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The classes that can be similar to any other of them: a shingle that one class alone has is in no
    intersection, and the others must be enough."""
    alone = sets.select("set", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("set").alias("set"))
    alone = alone.where("k = 1").groupBy("set").agg(F.count(F.lit(1)).alias("alone"))
    return (
        rooted.join(alone, "set", "left")
        .where((F.col("n") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("n") * percent)
        .drop("alone", "met")
    )


def _rare(sets: DataFrame) -> DataFrame:
    """(set, rare): the shingles of each class that at most ``RARE`` of these classes have. Of copies that were
    edited apart, these are the edits."""
    shingles = sets.select("set", F.explode("hashes").alias("h"))
    few = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE).select("h")
    return shingles.join(few, "h").groupBy("set").agg(F.collect_list("h").alias("rare"))


def _close(x: str, y: str, percent: int):
    """Whether two sets of these sizes can be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Shingles are of ``size`` words, A-Z in lower case; a text of fewer words is one shingle, a NULL or empty
    text has none and is linked with nothing. A document without ``doc_id`` has the component of the least
    ``doc_id`` NULL, and is kept as the first of its component. Repeated rows are returned alike.
    """
    found = near_components(documents, size, percent)
    null_key = F.lit(-(2**63)).cast("bigint")
    name = lambda c: F.when(F.col(c) != null_key, F.col(c))
    kind = documents.schema["doc_id"].dataType
    return found.select(
        name("doc").cast(kind).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        name("component").cast(kind).alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def first_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the one of the least (``doc_id``, text hash).

    Texts without ``doc_id`` or under one ``doc_id`` are documents of their own. Of repeated rows of the document
    that stays, one stays.
    """
    found = near_components(documents, size, percent).where("doc = component AND tag = first")
    kept = stored(found.groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("k")))
    names = [f"_{i}" for i in range(len(documents.columns))]
    rows = documents.toDF(*names)
    text, key = (names[documents.columns.index(c)] for c in ("text", "doc_id"))
    rows = rows.withColumns({"doc": doc_key(key), "tag": F.xxhash64(whole_text(text))})
    once = rows.join(kept.where("k = 1").hint("shuffle_hash"), ["doc", "tag"], "left_semi")
    more = rows.join(kept.where("k > 1").hint("shuffle_hash"), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    return once.unionByName(more).select(*names).toDF(*documents.columns)

"""Benchmark decontamination, DataFrame functions only.

The normalised word windows of all benchmark items form a hash set, one row per distinct window. Every
window of every document is looked up in it by hash and the hit is verified word by word in the join
itself. The set is broadcast when it was counted small; beyond that the same join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.stored import doc_key, stored, whole_text

WINDOW = 10
# At most this many windows, of ten words each, are broadcast: some tens of megabytes.
BROADCAST_WINDOWS = 200_000
# The characters that no word holds.
_NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a NULL text has none."""
    lowered = F.translate(text, _UPPER, _LOWER)
    return F.filter(F.split(lowered, _NOT_A_WORD), lambda word: word != "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, key, window, items): the distinct windows and the sorted ids of the items that hold each.

    An item of fewer words is one window of its own length; an item without words has none.
    """
    items = benchmark.select(F.col("item_id"), words(whole_text()).alias("words")).where(F.size("words") > 0)
    spans = items.withColumn("length", F.least(F.size("words"), F.lit(window))).select(
        "item_id",
        "length",
        "words",
        F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("at"),
    )
    return (
        spans.select("item_id", "length", F.expr("slice(words, at, length)").alias("window"))
        .groupBy("length", "window")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .withColumn("key", F.xxhash64("window"))
    )


def _places(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc, tag, words, length, at): the places of all windows; each text is split into words once."""
    texts = documents.select(
        doc_key().alias("doc"), F.xxhash64(whole_text()).alias("tag"), words(whole_text()).alias("words")
    )
    sized = texts.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    return sized.where("size(words) >= length").withColumn("at", F.explode(F.expr("sequence(1, size(words) - length + 1)")))


def hits(documents: DataFrame, windows: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """(doc, tag, at, length, key): every occurrence of a window in a document, verified.

    ``few`` windows are broadcast. Otherwise places are shuffled as hashes alone; those whose hash is known come
    back to their text, one row per text, take their own words from it and are compared.
    """
    places = _places(documents, lengths)
    mine = F.expr("slice(words, at, length)")
    known = windows.select("length", "key", "window")
    out = ["doc", "tag", "at", "length", "key"]
    if few:
        cut = places.select("doc", "tag", "at", "length", mine.alias("mine")).withColumn("key", F.xxhash64("mine"))
        return cut.join(F.broadcast(known), ["length", "key"]).where("mine = window").select(*out).distinct()
    hashed = places.select("doc", "tag", "at", "length", F.xxhash64(mine).alias("key"))
    maybe = stored(hashed.join(known.select("length", "key"), ["length", "key"], "left_semi").distinct())
    of_text = maybe.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "length", "key")).alias("places"))
    texts = documents.select(doc_key().alias("doc"), F.xxhash64(whole_text()).alias("tag"), whole_text().alias("text"))
    back = texts.join(of_text, ["doc", "tag"]).select("doc", "tag", words("text").alias("words"), "places")
    cut = back.select("doc", "tag", "words", F.inline("places")).select(*out, mine.alias("mine"))
    return cut.join(known, ["length", "key"]).where("mine = window").select(*out).distinct()


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, items): verified hits of all documents, and (length, key, items) of the windows."""
    spark = documents.sparkSession
    windows = stored(item_windows(benchmark, window))
    counts = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # at most `window` rows
    if not counts:
        none = spark.range(0).selectExpr(
            "id AS doc", "id AS tag", "int(id) AS at", "int(id) AS length", "id AS key"
        )
        return none, windows
    few = sum(counts.values()) <= BROADCAST_WINDOWS
    return stored(hits(documents, windows, sorted(counts), few)), windows


def hit_words(found: DataFrame) -> DataFrame:
    """(doc, tag, n_hit): words inside any hit; overlapping hits count once."""
    order = Window.partitionBy("doc", "tag").orderBy("at", "length")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("at") + F.col("length")
    reached = F.coalesce(F.max(stop).over(before), F.lit(0))
    return (
        found.select("doc", "tag", F.greatest(stop - F.greatest(F.col("at"), reached), F.lit(0)).alias("new"))
        .groupBy("doc", "tag")
        .agg(F.sum("new").cast("bigint").alias("n_hit"))
    )


def hit_items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, tag, items): sorted ids, as strings, of the items of which a window occurs."""
    kinds = found.select("doc", "tag", "length", "key").distinct()
    return (
        kinds.join(windows.select("length", "key", "items"), ["length", "key"])
        .select("doc", "tag", F.explode("items").alias("item"))
        .groupBy("doc", "tag")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    A NULL or empty text has no words and no hits; items without words hit nothing; an item id that is NULL
    is left out of the list; an empty benchmark leaves every document clean.
    """
    found, windows = scan(documents, benchmark, window)
    marks = hit_words(found).join(hit_items(found, windows), ["doc", "tag"], "left")
    sizes = documents.select(
        "doc_id",
        doc_key().alias("doc"),
        F.xxhash64(whole_text()).alias("tag"),
        F.size(words(whole_text())).cast("bigint").alias("n_words"),
    )
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    return sizes.join(marks, ["doc", "tag"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, unchanged, with all their columns."""
    found, _ = scan(documents, benchmark, window)
    keys = found.select("doc", "tag").distinct()
    return documents.join(
        keys, (doc_key() == keys["doc"]) & (F.xxhash64(whole_text()) == keys["tag"]), "left_anti"
    )

"""Queries of the operators that remove repeats and near copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.llm import minhash, substring, suffixes
from lodestat.llm.registry import query, table

_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op4_suffix_array_dedup")
def op4(spark, folder):
    """Byte strings of 100 that also start earlier, removed from all documents."""
    kept = suffixes.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op10_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w)
          WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
    every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
             FROM every ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op10(spark, folder):
    """Windows of 20 words that also start earlier, removed from all documents."""
    kept = substring.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_minhash_near_dedup")
def op9(spark, folder):
    """Near duplicates of all documents by shingles of four words."""
    return minhash.near_duplicates(table(spark, folder, "documents"), size=4)

"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from lodestat.llm import decontaminate, sharding
from lodestat.llm.registry import query, table

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query("op3_sharding")
def op3(spark, folder):
    """All documents over 16 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, folder, "documents"))


@query(
    "op6_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    bw AS (
      SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
    ),
    dw AS (
      SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS w
      FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i
            FROM d, (SELECT DISTINCT l FROM bw) AS lengths WHERE len(ws) >= l)
    ),
    hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, w)),
    covered AS (
      SELECT doc_id, count(DISTINCT j) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hit) GROUP BY doc_id
    ),
    items AS (
      SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
      sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op6(spark, folder):
    """Ten-word windows of the benchmark in all documents."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

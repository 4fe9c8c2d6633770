"""Queries of vector codes, phrases and the word-level encoder."""

from __future__ import annotations

import public_tokenizers

from lodestat.llm import codes, phrases, prefix_bpe
from lodestat.llm.registry import query, table

WORDS = "word_bpe_49k.json"


def _assign(k: int) -> str:
    """Distance and entry of each part in one number: its least value is the nearest entry of lowest index."""
    return (
        f"a{k} AS (SELECT vec_id, v.p, min(64 * list_sum(list_transform(range(1, len(v.part) + 1), "
        f"lambda i: (v.part[i] - b.part[i]) * (v.part[i] - b.part[i])))::BIGINT + e) AS de "
        f"FROM v JOIN b{k} AS b USING (p) GROUP BY ALL)"
    )


def _move(k: int) -> str:
    """Entries as the means of their parts, rounded down."""
    return (
        f"s{k} AS (SELECT a.p, de % 64 AS e, i, sum(v.part[i]) AS s, count(*) AS c "
        f"FROM a{k} AS a JOIN v USING (vec_id, p), unnest(range(1, len(v.part) + 1)) AS r(i) GROUP BY ALL), "
        f"m{k} AS (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS part FROM s{k} GROUP BY ALL), "
        f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e))"
    )


@query(
    "op11_vector_codes",
    f"""
    WITH kept AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS u
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    v AS (SELECT vec_id, p, u[p * w + 1:p * w + w] AS part FROM (SELECT vec_id, u, len(u) // 16 AS w, unnest(range(16)) AS p FROM kept)),
    b0 AS (SELECT p, e, part FROM v JOIN (
      SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)),
    {_assign(0)}, {_move(0)}, {_assign(1)}, {_move(1)}, {_assign(2)},
    coded AS (
      SELECT vec_id, string_agg(format('{{:02x}}', de % 64), '' ORDER BY p) AS code, CAST(sum(de // 64) AS BIGINT) AS error
      FROM a2 GROUP BY vec_id
    ),
    books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), books
    """,
)
def op11(spark, folder):
    """All vectors in 16 parts by codebooks of 64 entries, after two rounds."""
    return codes.codes(table(spark, folder, "embeddings"))


@query(
    "op12_phrase_collocations",
    """
    WITH w AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
    ),
    total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    f AS (
      SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k)
      GROUP BY ALL HAVING count(*) >= 100
    ),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    cut AS (SELECT *, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    s AS (
      SELECT cut.lang, cut.phrase, a, n, j, lf.f AS l, rf.f AS r,
        CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score
      FROM cut JOIN f AS lf ON lf.lang = cut.lang AND lf.phrase = lp JOIN f AS rf ON rf.lang = cut.lang AND rf.phrase = rp
      JOIN total ON total.lang = cut.lang
      QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1
    ),
    longer AS (
      SELECT lang, phrase, max(a) AS f FROM (
        SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) AS r(m) WHERE m < k)) GROUP BY ALL
    )
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
    FROM s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase
    WHERE longer.f IS NULL OR 100 * longer.f < 100 * a
    QUALIFY rank <= 2000
    """,
)
def op12(spark, folder):
    """The first 2,000 phrases of each language among those that occur a hundred times."""
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_word_bpe")
def op13(spark, folder):
    """All documents encoded by the public vocabulary of words with ends, and decoded again."""
    return prefix_bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(WORDS))

"""The query of the chat operator: calls, results and schemas derived from the turns of all conversations."""

from __future__ import annotations

from lodestat.llm import chat
from lodestat.llm.registry import query, table

# An assistant turn is a call, a user turn the result of the turn before it; TEXT is the type of texts.
_CALLS = """
  SELECT conv_id, concat('c', cast(turn AS TEXT)) AS call_id,
    CASE WHEN turn % 3 <> 0 THEN concat('c', cast(turn - 2 AS TEXT)) END AS after_id,
    CASE (turn + n) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'rank' ELSE 'unlisted' END AS tool,
    CASE WHEN n % 13 = 5 THEN concat('{"query": ', q)
      ELSE concat('{ "limit" : ', cast(n AS TEXT), '.0 , "query":', q, ', "flags" : { "b":true, "a":[1, 2.50, null] } }')
    END AS arguments, q, n
  FROM _turns WHERE role = 'assistant'
"""
_RESULTS = """
  SELECT conv_id, concat('c', cast(turn - 1 AS TEXT)) AS call_id,
    CASE WHEN turn % 4 = 1 THEN concat('{"ok": true, "chars": ', cast(chars AS TEXT), '}') ELSE words END AS content,
    CASE WHEN turn % 4 = 1 THEN concat('{"chars":', cast(chars AS TEXT), ',"ok":true}') ELSE q END AS result
  FROM _turns WHERE role = 'user'
"""
_TURNS = """
  SELECT conv_id, turn, role, coalesce(text, '') AS words, length(coalesce(text, '')) AS chars,
    length(coalesce(text, '')) % 97 AS n, QUOTED AS q
  FROM SOURCE
"""
_QUOTED = (
    "substring(to_json(named_struct('k', coalesce(text, ''))), 6, "
    "length(to_json(named_struct('k', coalesce(text, '')))) - 6)"
)
_SCHEMAS = {
    "search": '{"type":"object","properties":{"query":{"type":"string"},"limit":{"type":"integer","minimum":1,"maximum":50},'
    '"flags":{"type":"object"}},"required":["query","limit"],"additionalProperties":false}',
    "lookup": '{"type":"object","properties":{"query":{"type":"string"},"limit":{"type":"integer","maximum":20}},'
    '"required":["query","key"]}',
    "rank": '{"type":"object","properties":{"query":{"type":["string","array"]},"limit":{"type":"number"}},'
    '"additionalProperties":false}',
}


def derived(spark, conversations):
    """(calls, results, schemas) of the turns of some conversations."""
    conversations.createOrReplaceTempView("_conversations")
    spark.sql(_TURNS.replace("QUOTED", _QUOTED).replace("SOURCE", "_conversations")).createOrReplaceTempView("_turns")
    listed = ", ".join(f"('{tool}', '{schema}')" for tool, schema in _SCHEMAS.items())
    return (
        spark.sql(_CALLS.replace("TEXT", "STRING")),
        spark.sql(_RESULTS.replace("TEXT", "STRING")),
        spark.sql(f"SELECT * FROM VALUES {listed} AS v(tool, schema)"),
    )


_ORACLE = (
    "WITH RECURSIVE _turns AS (" + _TURNS.replace("QUOTED", "CAST(to_json(coalesce(text, '')) AS VARCHAR)").replace("SOURCE", "conversations") + "), "
    "calls AS (" + _CALLS.replace("TEXT", "VARCHAR") + "), results AS (" + _RESULTS.replace("TEXT", "VARCHAR") + "), "
    """
    deep AS (
      SELECT c.conv_id, c.call_id, CAST(0 AS BIGINT) AS depth FROM calls c
      WHERE NOT EXISTS (FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after_id)
      UNION ALL
      SELECT c.conv_id, c.call_id, d.depth + 1 FROM deep d JOIN calls c ON c.conv_id = d.conv_id AND c.after_id = d.call_id
    ),
    checked AS (
      SELECT conv_id, call_id, tool,
        CASE WHEN n % 13 <> 5 THEN concat('{"flags":{"a":[1,2.5,null],"b":true},"limit":', n, ',"query":', q, '}') END AS arguments,
        CASE WHEN n % 13 = 5 THEN ['$: not JSON']
          WHEN tool = 'unlisted' THEN ['$: unknown tool']
          WHEN tool = 'rank' THEN ['$.flags: additional']
          WHEN tool = 'lookup' THEN CASE WHEN n > 20 THEN ['$.key: required', '$.limit: maximum'] ELSE ['$.key: required'] END
          WHEN n < 1 THEN ['$.limit: minimum'] WHEN n > 50 THEN ['$.limit: maximum'] ELSE CAST([] AS VARCHAR[]) END AS violations
      FROM calls
    ),
    linked AS (
      SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, tool, depth, arguments, result,
        coalesce(violations, CAST([] AS VARCHAR[])) AS violations,
        CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN len(violations) > 0 THEN 'invalid'
          WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
        CAST(c.call_id IS NOT NULL AS BIGINT) AS n_calls, CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results
      FROM checked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
      LEFT JOIN deep d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
    )
    SELECT conv_id, call_id, tool, depth, false AS cyclic, n_calls, n_results, arguments, result,
      array_to_string(violations, '; ') AS violations, status,
      CASE WHEN status = 'linked' THEN concat('{"arguments":', arguments, ',"call_id":"', call_id, '","depth":', depth,
        ',"result":', result, ',"tool":"', tool, '"}') END AS record
    FROM linked
    """
)


@query("op1_chat_tool_calls", _ORACLE)
def op1(spark, folder):
    """Calls and results of all conversations, linked; violations in one text."""
    calls, results, schemas = derived(spark, table(spark, folder, "conversations"))
    linked = chat.link_calls(calls, results, schemas)
    return linked.withColumn("violations", chat.listed("violations"))

"""Chat formatting: tool calls linked with their results.

Calls and results are joined by identifier, calls are put in topological order along the calls they wait for,
arguments are checked against the schema of their tool, and arguments and results are written as canonical
JSON. Joins and ordering are Spark's; only the check of one JSON text is a function in Python.

Tables: ``calls`` (conv_id, call_id, after_id, tool, arguments), ``results`` (conv_id, call_id, content) and
``schemas`` (tool, schema), the last one row per tool. A schema is a JSON object with ``type``, ``properties``,
``required``, ``enum``, ``items``, ``minimum``, ``maximum`` and ``additionalProperties``.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.stored import stored
from lodestat.session import ship_by_value

ship_by_value(__name__)

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(word: str):
    raise ValueError(word)


def parsed(text: str | None):
    """The value of a JSON text; ValueError for other text, repeated keys, NaN and infinities."""
    value = json.loads(text or "", object_pairs_hook=_unique, parse_constant=_refuse)
    return value


def canonical(value) -> str:
    """JSON with keys in code point order, no spaces, and whole numbers without a fraction."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        value = int(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def _is_kind(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind]) if kind in _KINDS else True


def _is_schema(schema) -> bool:
    """Whether a value is an object whose known fields have the kinds that ``violations`` reads."""
    if not isinstance(schema, dict):
        return False
    kinds, fields = schema.get("type", []), schema.get("properties", {})
    names = [kinds] if isinstance(kinds, str) else kinds
    return (
        all(isinstance(part, list) for part in (names, schema.get("enum", []), schema.get("required", [])))
        and all(isinstance(name, str) for name in [*names, *schema.get("required", [])])
        and all(_is_kind(schema.get(bound, 0), "number") for bound in ("minimum", "maximum"))
        and isinstance(schema.get("additionalProperties", True), (bool, dict))
        and isinstance(fields, dict)
        and all(map(_is_schema, fields.values()))
        and ("items" not in schema or _is_schema(schema["items"]))
    )


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in a value goes against a schema, as ``place: what``, in the order of the schema."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            out.append(f"{at}: minimum")
        if value > schema.get("maximum", math.inf):
            out.append(f"{at}: maximum")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{name}: required" for name in schema.get("required", []) if name not in value]
        for name, inner in fields.items():
            if name in value:
                out += violations(value[name], inner, f"{at}.{name}")
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{name}: additional" for name in sorted(value) if name not in fields]
    if isinstance(value, list) and "items" in schema:
        for place, inner in enumerate(value):
            out += violations(inner, schema["items"], f"{at}[{place}]")
    return out


def _shown(text: str | None) -> tuple[object, str]:
    """(value, canonical text); ValueError where ``parsed`` says so and for half a surrogate pair, which is no text."""
    value = parsed(text)
    shown = canonical(value)
    shown.encode()
    return value, shown


def _checked(text: str | None, schema: str | None) -> tuple[str | None, list[str]]:
    try:
        value, shown = _shown(text)
    except (ValueError, RecursionError):
        return None, ["$: not JSON"]
    if schema is None:
        return shown, ["$: unknown tool"]
    try:
        rules, _ = _shown(schema)
        usable = _is_schema(rules)
    except (ValueError, RecursionError):
        usable = False
    return shown, violations(value, rules) if usable else ["$: no usable schema"]


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``canonical_arguments`` and ``violations``; a NULL or unknown tool is a violation.

    So is a schema that is not JSON or not such an object as the module names; arguments with half a surrogate
    pair are not JSON. Numbers in an ``enum`` are equal by value, and ``true`` is no number.
    """
    known = schemas.where("tool IS NOT NULL").groupBy("tool").agg(F.min("schema").alias("schema"))
    rows = calls.select("conv_id", "call_id", "after_id", "tool", "arguments").join(known, "tool", "left")
    rows = rows.select("conv_id", "call_id", "after_id", "tool", "arguments", "schema")

    def work(batches):
        for part in batches:
            found = [_checked(a, s) for a, s in zip(part.column(4).to_pylist(), part.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:4],
                    pa.array([f[0] for f in found], type=pa.string()),
                    pa.array([f[1] for f in found], type=pa.list_(pa.string())),
                ],
                names=["conv_id", "call_id", "after_id", "tool", "canonical_arguments", "violations"],
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "call_id", "after_id", "tool"))
    return rows.mapInArrow(work, f"{kinds}, canonical_arguments string, violations array<string>")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, cyclic): how many calls of its conversation a call waits for, one after another.

    Every call jumps to the call it waits for, and each round doubles the jumps, so a chain of n calls takes
    log2(n) rounds. A reference to no call of the conversation counts as none. Calls that wait for themselves,
    directly or not, and those behind them, have no depth and are cyclic.
    """
    node = ["conv_id", "call_id"]
    nodes = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*node).agg(F.min("after_id").alias("next"))
    parents = nodes.select("conv_id", F.col("call_id").alias("next"), F.lit(True).alias("there"))
    jumps = stored(
        nodes.join(parents, ["conv_id", "next"], "left").select(
            *node, F.when(F.col("there"), F.col("next")).alias("next"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("depth")
        )
    )
    longest = jumps.count()  # no chain is longer, so whatever still jumps beyond it runs in a circle
    reach = 1
    while reach <= longest and not jumps.where("next IS NOT NULL").isEmpty():
        onward = jumps.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("then"), F.col("depth").alias("more"))
        jumps = stored(
            jumps.join(onward, ["conv_id", "next"], "left").select(
                *node, F.col("then").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )
        reach *= 2
    return jumps.select(
        *node, F.when(F.col("next").isNull(), F.col("depth")).alias("depth"), F.col("next").isNotNull().alias("cyclic")
    )


def _canonical_text(text: str | None) -> str | None:
    try:
        return None if text is None else _shown(text)[1]
    except (ValueError, RecursionError):
        return json.dumps(text, ensure_ascii=False)


def _canonical_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of text as canonical JSON; text that is not JSON becomes a JSON string."""
    place = df.columns.index(column)

    def work(batches):
        for part in batches:
            new = pa.array([_canonical_text(t) for t in part.column(place).to_pylist()], type=pa.string())
            yield part.set_column(place, column, new)

    return df.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call.

    conv_id, call_id, tool, depth, cyclic, n_calls and n_results (rows of that identifier), arguments and result as
    canonical JSON, violations, status, record. The status is ``orphan`` (no call), ``ambiguous`` (several calls
    or results of one identifier; the least of each are shown), ``cyclic``, ``invalid`` (violations), ``open``
    (no result) or ``linked``, the first that holds. ``record`` is the whole row as canonical JSON, and NULL
    unless linked. Rows without conversation or identifier cannot be joined and are ``orphan``, one by one.
    """
    node = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    checked = stored(check_arguments(calls, schemas))
    # NULL sorts first in a struct: of several rows the least one is shown.
    one = checked.where(named).groupBy(*node).agg(
        F.count(F.lit(1)).alias("n_calls"), F.min(F.struct("tool", "canonical_arguments", "violations")).alias("c")
    )
    answers = _canonical_column(results.select("conv_id", "call_id", "content"), "content")
    answers = stored(answers)
    answer = answers.where(named).groupBy(*node).agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"))
    linked = one.join(answer, node, "full").join(stored(depths(calls)), node, "left").select(
        *node, F.col("c.tool").alias("tool"), "depth", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.col("c.canonical_arguments").alias("arguments"), F.col("content").alias("result"),
        F.coalesce(F.col("c.violations"), F.array().cast("array<string>")).alias("violations"),
    )
    nothing = F.lit(None)
    zero, unit = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    loose_calls = checked.where(~named).select(
        *node, "tool", nothing.cast("bigint").alias("depth"), F.lit(False).alias("cyclic"), unit.alias("n_calls"), zero.alias("n_results"),
        F.col("canonical_arguments").alias("arguments"), nothing.cast("string").alias("result"), "violations",
    )
    loose_results = answers.where(~named).select(
        *node, nothing.cast("string").alias("tool"), nothing.cast("bigint").alias("depth"), F.lit(False).alias("cyclic"), zero.alias("n_calls"),
        unit.alias("n_results"), nothing.cast("string").alias("arguments"), F.col("content").alias("result"), F.array().cast("array<string>").alias("violations"),
    )
    rows = linked.unionByName(loose_calls).unionByName(loose_results)
    status = (
        F.when((F.col("n_calls") == 0) | ~named, "orphan")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "ambiguous")
        .when(F.col("cyclic"), "cyclic")
        .when(F.size("violations") > 0, "invalid")
        .when(F.col("n_results") == 0, "open")
        .otherwise("linked")
    )
    return _recorded(rows.withColumn("status", status))


def _recorded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``record``, the linked ones as one canonical JSON object each."""
    names = ["status", "arguments", "call_id", "depth", "result", "tool"]

    def work(batches):
        for part in batches:
            columns = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
            records = [
                canonical({"arguments": parsed(a), "call_id": c, "depth": d, "result": None if r is None else parsed(r), "tool": t})
                if s == "linked"
                else None
                for s, a, c, d, r, t in zip(*columns)
            ]
            yield part.append_column("record", pa.array(records, type=pa.string()))

    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", record string")


def listed(column: str):
    """A list of violations as one text."""
    return F.array_join(F.col(column), "; ")

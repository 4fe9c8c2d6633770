import json

from lodestat.llm import chat


def test_canonical_and_violations():
    assert chat.canonical(chat.parsed('{"b": 1.0, "a": [2.50, null, "é\\n"], "": {"z":1,"y":true}}')) == '{"":{"y":true,"z":1},"a":[2.5,null,"é\\n"],"b":1}'
    for bad in ["", "{", '{"a":1,"a":2}', "NaN", "[1,]", None]:
        assert chat._checked(bad, "{}")[1] == ["$: not JSON"]
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "items": {"enum": [1, 2]}}}, "required": ["n"], "additionalProperties": False}
    assert chat.violations({"n": 2, "l": [1]}, schema) == []
    assert chat.violations({"l": [3], "x": 0}, schema) == ["$.n: required", "$.l[0]: enum", "$.x: additional"]
    assert chat.violations({"n": 0.5}, schema) == ["$.n: type"] and chat.violations({"n": True}, schema) == ["$.n: type"]
    assert chat.violations([], schema) == ["$: type"]


def test_values_and_schemas_that_are_hard_to_read():
    for half in ['"\\ud800"', '{"\\udc00": 1}', '["\\ud83d", "\\ude00"]']:
        assert chat._checked(half, "{}") == (None, ["$: not JSON"])
        assert json.loads(chat._canonical_text(half)) == half
    assert chat._checked('"\\ud83d\\ude00"', "{}") == ('"\U0001f600"', [])
    digits = "9" * 400
    assert chat._checked(digits, '{"type": "integer", "maximum": 5.5}') == (digits, ["$: maximum"])
    assert chat._checked("9" * 5000, "{}")[1] == ["$: not JSON"] and chat._checked("1e999", "{}")[1] == ["$: not JSON"]
    unusable = ["", "{", "null", "[]", "3", '"x"', '{"type": 1}', '{"type": [1]}', '{"enum": 1}', '{"required": [1]}', '{"minimum": "a"}', '{"minimum": true}',
                '{"properties": []}', '{"properties": {"a": 1}}', '{"items": []}', '{"items": {"enum": {}}}', '{"additionalProperties": 0}', '{"required": ["\\ud800"]}', "[" * 100_000]
    for schema in unusable:
        assert chat._checked('{"a": 1}', schema) == ('{"a":1}', ["$: no usable schema"]), schema
    assert chat.violations(True, {"enum": [1]}) == ["$: enum"] and chat.violations(1, {"enum": [True]}) == ["$: enum"]
    assert chat.violations(1.0, {"enum": [1]}) == [] and chat.violations({"b": [1], "a": None}, {"enum": [{"a": None, "b": [1.0]}]}) == []


def test_hard_values_and_clashing_columns(spark):
    calls = spark.createDataFrame(
        [(1, "a", None, "t", '"\\ud800"', "x", "y", 0), (1, "b", None, "t", '{"q": %s}' % ("9" * 400), "x", "y", 0), (1, "c", None, "u", '["%s"]' % ("long " * 200_000), "x", "y", 0)],
        "conv_id bigint, call_id string, after_id string, tool string, arguments string, schema string, violations string, depth int",
    )
    results = spark.createDataFrame([(1, "b", '"\\udfff"', "z"), (1, "b", '"\\udfff"', "z"), (1, "c", "done", "z")], "conv_id bigint, call_id string, content string, status string")
    schemas = spark.createDataFrame([("t", "no schema", "x"), ("u", '{"type": "array"}', "x")], "tool string, schema string, arguments string")
    found = {r.call_id: r for r in chat.link_calls(calls, results, schemas).collect()}
    assert (found["a"].status, found["a"].violations, found["a"].arguments) == ("invalid", ["$: not JSON"], None)
    assert (found["b"].status, found["b"].violations, found["b"].n_results) == ("ambiguous", ["$: no usable schema"], 2)
    assert found["c"].status == "linked" and len(found["c"].arguments) == 1_000_004


def test_linking(spark):
    calls = [
        (1, "a", None, "t", '{"q": 1}'), (1, "b", "a", "t", '{"q": 2}'), (1, "c", "b", "t", '{"q": "x"}'), (1, "d", "gone", "t", '{"q": 4}'),
        (1, "e", "f", "t", '{"q": 5}'), (1, "f", "e", "t", '{"q": 6}'), (1, "g", "f", "t", '{"q": 7}'), (2, "a", "b", "u", '{"q": 8}'),
        (1, "h", None, "t", '{"q": 9}'), (1, "h", None, "t", '{"q": 10}'), (None, "a", None, "t", '{"q": 11}'), (3, None, None, None, None),
    ]
    results = [(1, "a", '{"z": 1, "y": 2}'), (1, "b", "plain"), (1, "c", None), (1, "d", None), (1, "h", "x"), (9, "a", "lost"), (None, None, "no key")]
    schemas = [("t", json.dumps({"type": "object", "properties": {"q": {"type": "integer"}}})), (None, "{}")]
    found = chat.link_calls(
        spark.createDataFrame(calls, "conv_id bigint, call_id string, after_id string, tool string, arguments string"),
        spark.createDataFrame(results, "conv_id bigint, call_id string, content string"),
        spark.createDataFrame(schemas, "tool string, schema string"),
    ).collect()
    assert len(found) == 13
    got = {(r.conv_id, r.call_id): (r.status, r.depth) for r in found}
    assert got[1, "a"] == ("linked", 0) and got[1, "b"] == ("linked", 1) and got[1, "c"] == ("invalid", 2)
    assert got[1, "e"] == got[1, "f"] == got[1, "g"] == ("cyclic", None)
    assert got[2, "a"] == ("invalid", 0) and got[1, "h"] == ("ambiguous", 0) and got[9, "a"] == ("orphan", None)
    assert got[None, "a"] == ("orphan", None) and got[3, None] == ("orphan", None)
    records = {r.call_id: r.record for r in found if r.record}
    assert records["b"] == '{"arguments":{"q":2},"call_id":"b","depth":1,"result":"plain","tool":"t"}'
    assert records["a"] == '{"arguments":{"q":1},"call_id":"a","depth":0,"result":{"y":2,"z":1},"tool":"t"}'


def test_long_chain_and_empty_tables(spark):
    calls = spark.createDataFrame([(1, f"c{k}", f"c{k - 1}", "t", "{}") for k in range(300)], "conv_id bigint, call_id string, after_id string, tool string, arguments string")
    assert {r.call_id: r.depth for r in chat.depths(calls).collect()} == {f"c{k}": k for k in range(300)}
    results = spark.createDataFrame([], "conv_id bigint, call_id string, content string")
    schemas = spark.createDataFrame([], "tool string, schema string")
    assert chat.link_calls(calls.where("false"), results, schemas).count() == 0
    assert {r.status for r in chat.link_calls(calls, results, schemas).collect()} == {"invalid"}

"""Tool-call linking on small tables."""

import json

from rankspark.llm import tool_calls as T

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = [("add", "a", "number", True), ("add", "b", "integer", False), ("echo", "text", "string", True), ("echo", "text", "string", True)]


def link(spark, calls, results):
    return T.link_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    )


def test_order_status_and_json(spark):
    calls = [
        (1, "late", 0, "add", '{"b": 2, "a": 1.5}', ["early"]),  # depends on a later turn
        (1, "early", 5, "echo", '{ "text" : "h\\u00e9 \\"q\\"" }', None),
        (1, "last", 1, "echo", '{"text":"x"}', ["late", "gone", None]),
        (2, "p", 1, "echo", '{"text": 3, "more": null}', ["q"]),
        (2, "q", 2, "echo", "not json", ["p"]),
        (3, "one", 0, "fly", "{}", []),
        (3, None, 1, "echo", "[1]", None),
    ]
    results = [(1, "early", 9, "second"), (1, "early", 6, 'fir"st\n'), (3, "lost", 4, None), (None, "early", 1, "x")]
    rows = sorted(link(spark, calls, results).collect(), key=lambda r: (r.conv_id or -1, r.position))
    got = [(r.conv_id, r.position, r.call_id, r.status, r.errors) for r in rows]
    assert got == [
        (None, 0, "early", "no_call", []),
        (1, 0, "early", "ok", []),
        (1, 1, "late", "no_result", []),
        (1, 2, "last", "no_result", []),
        (2, 0, "p", "cyclic", ["type:text", "unknown:more"]),
        (2, 1, "q", "cyclic", ["not_an_object"]),
        (3, 0, "one", "invalid", ["unknown_tool"]),
        (3, 1, None, "invalid", ["not_an_object"]),
        (3, 2, "lost", "no_call", []),
    ]
    for r in rows:
        parsed = json.loads(r.json)
        assert r.json == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert parsed["call_id"] == r.call_id and parsed["name"] == r.name
    assert json.loads(rows[1].json) == {"arguments": {"text": 'hé "q"'}, "call_id": "early", "name": "echo", "result": 'fir"st\n'}


def test_deep_dependencies_and_empty_tables(spark):
    calls = [(1, f"c{i}", 100 - i, "add", '{"a":1}', [f"c{i - 1}"] if i else []) for i in range(6)]
    rows = sorted(link(spark, calls, []).collect(), key=lambda r: r.position)
    assert [r.call_id for r in rows] == [f"c{i}" for i in range(6)]
    assert link(spark, [], []).collect() == []


def test_integers_are_numbers_and_missing_fields_are_told(spark):
    calls = [(1, "a", 0, "add", '{"a": 1, "b": 1.5}', None), (1, "b", 1, "add", '{"b": 1}', None), (1, "c", 2, "add", None, None)]
    rows = sorted(link(spark, calls, []).collect(), key=lambda r: r.position)
    assert [r.errors for r in rows] == [["type:b"], ["missing:a"], ["not_an_object"]]


def test_turns_with_nulls(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", None), (1, None, "user", "x"), (None, 2, "system", "y"), (1, 4, None, "z"), (2, 0, "user", "d"), (2, 0, "user", "d")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = T.link_calls(*T.conversation_calls(frame)).collect()
    assert sorted(r.status for r in rows) == ["invalid", "no_result", "no_result", "no_result", "ok"]

"""op2 against plain Python on planted calls, and on the small conversations."""

import json

from cadenza.llm import op2_tools

SCHEMAS = {"add": {"a": ("integer", True), "b": ("integer", True)}, "say": {"text": ("string", True), "loud": ("boolean", False)}, "now": {}}
CALLS = "conv long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv long, call_id string, turn long, content string"


def run(spark, calls, results):
    return {(r["conv"], r["call_id"]): r for r in op2_tools.link_tools(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}


def test_linking_order_and_json(spark):
    calls = [
        (1, "a", 0, "add", '{"b": 2, "a": 1}', []), (1, "b", 1, "say", '{"text":"hé \\"q\\"", "loud":true}', ["a"]), (1, "c", 2, "now", "{}", ["a", "b", "zz"]),
        (1, "x", 3, "now", "{}", ["y"]), (1, "y", 4, "now", "{}", ["x"]), (1, "z", 5, "now", "{}", ["y"]), (1, "b", 9, "add", "{}", None),
        (2, "a", 0, "add", '{"a":1,"b":"no"}', None), (2, "b", 0, "add", '{"a":1}', None), (2, "c", 0, "add", '{"a":1,"b":2,"c":3}', None), (2, "d", 0, "add", "not json", None),
        (2, "e", 0, "add", None, None), (2, "f", 0, "other", "{}", None), (2, "g", 0, "say", '{"text":5}', None), (2, "h", 0, "say", '{"text":"x","loud":"y"}', None), (2, "i", 0, None, "{}", None), (2, "j", 0, "add", "[1]", None),
        (None, "a", 0, "now", "{}", ["a"]), (3, None, 0, "now", "{}", None),
    ]
    results = [(1, "a", 5, "3"), (1, "a", 4, "first"), (1, "q", 6, "orphan"), (None, "a", 1, "lone"), (1, "c", 7, None)]
    got = run(spark, calls, results)
    level = {k: r["level"] for k, r in got.items()}
    assert [level[1, k] for k in "abcxyz"] == [0, 1, 2, None, None, None]
    assert got[1, "c"]["n_unknown"] == 1 and got[1, "b"]["n_calls"] == 2 and got[1, "a"]["n_results"] == 2
    assert got[1, "a"]["json"] == '{"arguments":{"a":1,"b":2},"id":"a","name":"add","result":"first"}'
    assert json.loads(got[1, "b"]["json"])["arguments"] == {"loud": True, "text": 'hé "q"'}
    assert got[1, "q"]["name"] is None and json.loads(got[1, "q"]["json"])["result"] == "orphan"
    assert {k[1]: r["valid"] for k, r in got.items() if k[0] == 2} == dict.fromkeys("abcdefghij", False)
    assert got[1, "a"]["valid"] and got[1, "b"]["valid"] and got[1, "c"]["valid"]
    for r in got.values():
        o = json.loads(r["json"])
        assert list(o) == sorted(o)


def test_levels_of_paths_joins_and_cycles(spark):
    import random

    rng = random.Random(3)
    deps = {f"p{i}": [f"p{i - 1}"] if i else [] for i in range(70)}
    deps |= {f"d{i}": rng.sample([f"d{j}" for j in range(i)] + [f"p{j}" for j in range(0, 70, 9)], min(i, 3)) for i in range(25)}
    deps |= {"self": ["self"], "x": ["z"], "y": ["x"], "z": ["y"], "hang": ["x"], "both": ["x", "p3"], "after": ["both"], "tail": ["d24"]}
    calls = [(1, k, i, "now", "{}", v) for i, (k, v) in enumerate(deps.items())]
    lost = {"self", "x", "y", "z", "hang", "both", "after"}

    def level(k):
        return 1 + max(map(level, deps[k]), default=-1)

    got = {k[1]: r["level"] for k, r in run(spark, calls, []).items()}
    assert got == {k: None if k in lost else level(k) for k in deps}


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    turns = {(r["conv_id"], r["turn"]): r for r in rows}
    got = op2_tools.query(spark, "/root/testdata/sf0.001").collect()
    calls = {k: r for k, r in turns.items() if r["role"] in ("user", "system")}

    def level(k):
        before = [(k[0], k[1] - d) for d in (1, 2) if (k[0], k[1] - d) in calls]
        return 1 + max(map(level, before)) if before else 0

    assert {(r["conv_id"], r["call_turn"]): r["level"] for r in got if r["name"]} == {k: level(k) for k in calls}
    answered = {(r["conv_id"], r["result_turn"]): json.loads(r["json"])["result"] for r in got if r["result_turn"] is not None}
    assert answered == {k: r["text"] for k, r in turns.items() if r["role"] not in ("user", "system")}
    assert all(r["valid"] for r in got if r["name"])


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_turns_of_other_roles_are_results(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "tool", "t"), (1, 2, None, "n"), (2, 0, "user", "x" * 200_000), (2, 1, "assistant", None)]
    calls, results = op2_tools.turns_as_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv"], r["result_turn"]): r for r in op2_tools.link_tools(calls, results, op2_tools.TURN_TOOLS).collect()}
    assert got[1, 1]["name"] == "reply" and got[1, 2]["name"] is None and got[2, 1]["valid"]
    assert json.loads(got[2, 1]["json"])["arguments"]["text"] == "x" * 200_000

import json
import random

from distloom.llm import toolcalls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, level string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"n": ("integer", True), "s": ("string", False)}, "g": {"x": ("number", True), "b": ("boolean", False), "o": ("object", False), "l": ("array", False)}}


def link(spark, calls, results):
    out = toolcalls.link(spark.createDataFrame([(*c, "extra") for c in calls], CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_link(spark):
    calls = [
        (1, "a", 1, "f", '{"s": "é\\n\\"", "n": 2}', []), (1, "b", 2, "g", '{"x": 1.5, "b": true, "o": {"z": 1, "a": 2}, "l": [1]}', ["a"]), (1, "c", 3, "f", '{"n": "2", "q": 1}', ["a", "b", "gone"]),
        (1, "d", 4, "h", "{", None), (1, "e", 5, "f", None, ["g"]), (1, "g", 6, "f", '{"n": 1}', ["e"]), (2, "a", 1, "f", "[1]", []), (1, "a", 9, "f", '{"n": 3}', []), (1, "k", 7, "f", '{"n": 1}', ["g"]),
    ]
    results = [(1, "a", 2, 'ok "1"'), (1, "a", 3, "later"), (1, "b", 2, None), (3, "zz", 5, "lost"), (None, "a", 1, "x")]
    got = link(spark, calls, results)
    assert {k: r.problems for k, r in got.items()} == {
        (1, "a"): "several_results", (1, "b"): "", (1, "c"): "type:n,unknown_argument,missing_dependency,no_result", (1, "d"): "invalid_json,unknown_tool,no_result",
        (1, "e"): "invalid_json,cycle,no_result", (1, "g"): "cycle,no_result", (1, "k"): "cycle,no_result", (2, "a"): "missing:n,no_result", (3, "zz"): "no_call", (None, "a"): "no_call",
    }
    assert {k[1]: r.level for k, r in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "g": None, "k": None}
    first = got[1, "a"].message
    assert first == '{"arguments":{"n":2,"s":"é\\n\\""},"call_id":"a","name":"f","result":"ok \\"1\\""}'
    assert json.loads(got[1, "b"].message)["arguments"]["o"] == {"a": 2, "z": 1} and '"o":{"a":2,"z":1}' in got[1, "b"].message
    assert json.loads(got[1, "d"].message) == {"arguments": None, "call_id": "d", "name": "h", "result": None}


def test_deep_chain_and_empty(spark):
    n = 70
    calls = [(1, f"c{i}", i, "f", '{"n":1}', [f"c{i - 1}"] if i else []) for i in range(n)]
    got = link(spark, calls, [])
    assert [got[1, f"c{i}"].level for i in range(n)] == list(range(n))
    assert link(spark, [], []) == {}


def test_levels_of_random_graphs(spark):
    rng = random.Random(4)
    calls = []
    for conv in range(6):
        n = rng.randrange(2, 40)
        names = list(range(n))
        rng.shuffle(names)
        for i in range(n):
            after = [str(names[rng.randrange(max(0, i - 5), i)]) for _ in range(rng.randrange(3))] if i else []
            if conv == 5 and i == n // 2:
                after.append(str(names[-1]))  # may close a cycle
            calls.append((conv, str(names[i]), after))
    expected = {(c, x): 0 for c, x, _ in calls}
    for _ in range(60):  # the longest way back; what still grows is endless
        before = dict(expected)
        for c, x, after in calls:
            expected[c, x] = max([expected[c, a] + 1 for a in after], default=0)
    endless = {k for k in expected if expected[k] >= 60 or expected[k] != before[k]}
    df = spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(df).collect()}
    assert got == {k: None if k in endless else v for k, v in expected.items()}


def test_conversations(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f'say "{t}"') for t in range(16)] + [(2, 1, "assistant", None), (2, 1, "assistant", None), (None, 3, "assistant", "x"), (3, 0, "system", "s")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.calls_of_conversations(conversations)
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(calls, results, toolcalls.SCHEMAS).collect()}
    for t in range(1, 16, 2):
        r, k = got[1, t], (t - 1) // 2
        assert r.name == ("search", "translate", "lookup")[k % 3] and r.level == (k + 1).bit_length() - 1
        expected = [*(["invalid_json"] if t % 7 == 3 else ["type:limit"] if t % 5 == 1 else []), *(["no_result"] if t == 15 else [])]
        assert r.problems == ",".join(expected)
        arguments = None if t % 7 == 3 else {"limit": str(t) if t % 5 == 1 else t, "query": f'say "{t}"'}
        assert json.loads(r.message) == {"arguments": arguments, "call_id": f"call_1_{t}", "name": r.name, "result": None if t == 15 else f'say "{t + 1}"'}
    assert got[1, 0].problems == "no_call" and got[2, 1].problems.startswith("missing:query")

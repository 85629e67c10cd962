"""Tool-call levels against a plain topological sort, and texts that JSON readers stumble over."""

import json
import random

import pytest

from coinbrook.llm import toolcalls

TURN = "conv_id long, turn long, role string, text string"


def turn(conv, at, calls):
    return (conv, at, "assistant", json.dumps({"tool_calls": calls}))


def plain_levels(graph):
    """Level of each node by repeated removal; what depends on a cycle has none."""
    level = {}
    while ready := [n for n, needs in graph.items() if n not in level and all(x in level for x in needs)]:
        level |= {n: max((level[x] + 1 for x in graph[n]), default=0) for n in ready}
    return level


def test_levels_of_random_graphs(spark):
    rng, turns, expected = random.Random(7), [], {}
    for conv in range(12):
        n = rng.randrange(1, 9)
        names = [f"c{i}" for i in range(n)]
        later = conv % 3 == 0  # every third one may have cycles
        graph = {c: sorted({x for x in names[: n if later else i] if rng.random() < 0.4}) for i, c in enumerate(names)}
        graph[names[0]] += ["absent"] if conv % 2 else []
        turns.append(turn(conv, 1, [{"id": c, "name": "f", "arguments": [{"$ref": x} for x in graph[c]]} for c in rng.sample(names, n)]))
        known = {c: [x for x in needs if x in graph] for c, needs in graph.items()}
        expected |= {(conv, c): plain_levels(known).get(c) for c in names}
    got = toolcalls.tool_links(spark.createDataFrame(turns, TURN), {"f": {"type": "array", "items": {"type": "object"}}}).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == expected
    assert all((r.status == "cycle") == (r.level is None) and r.valid for r in got)
    assert len(set(expected.values())) > 3


def test_texts_that_are_no_plain_json(spark):
    deep = '{"tool_calls":[{"id":"deep","arguments":' + '{"a":' * 100_000 + "1" + "}" * 100_000 + "}]}"
    deeper_than_bound = '{"tool_calls":[{"id":"bound","arguments":' + "[" * 150 + "]" * 150 + "}]}"
    turns = [
        (1, 1, "assistant", deep),
        (1, 3, "assistant", deeper_than_bound),
        (1, 5, "assistant", '{"tool_calls":[{"id":"nan","arguments":{"x":NaN}}]}'),
        (1, 7, "assistant", '{"tool_calls":[{"id":"inf","arguments":{"x":1e999}}]}'),
        (2, 1, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"f\\udfff","arguments":{"k\\ud800":{"$ref":"\\ud800"}}}]}'),
        (3, 1, "assistant", '{"tool_calls":[{"name":"f","arguments":{}},{"name":"g","arguments":{}},{"id":7,"name":"f","arguments":{}},{"id":"x","name":"f","arguments":1},{"id":"x","name":"g","arguments":1}]}'),
        (3, 2, "tool", '{"tool_call_id":7,"content":"seven"}'),
        (3, 3, "tool", "plain"),
        (3, 4, "system", "rules"),
        (3, 5, None, None),
    ]
    got = toolcalls.tool_links(spark.createDataFrame(turns, TURN), {"f": {}, "g": {"type": "object"}}).collect()
    by = {(r.conv_id, r.call_id, r.name, r.status) for r in got}
    assert by == {
        (1, "1:0", None, "orphan"), (1, "1:2", None, "orphan"), (1, "1:4", None, "orphan"), (1, "1:6", None, "orphan"),
        (2, "\\ud800", "f\\udfff", "cycle"),
        (3, "no-id:1:0", "f", "open"), (3, "no-id:1:1", "g", "open"), (3, "7", "f", "linked"), (3, "x", "f", "open"), (3, "x", "g", "duplicate"),
    }
    assert all(json.loads(r.canonical) is not None for r in got)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": ["string", "null"]}, ["x", None], [1, True, []]),
        ({"type": "integer"}, [1, 1.0, -3], [1.5, True, "1"]),
        ({"type": ["integer", "boolean"]}, [1.0, False], [0.5, None]),
        ({"enum": [1, "a", {"k": [1]}]}, [1, 1.0, "a", {"k": [1.0]}], [True, "b", {"k": [True]}, {"k": [1], "l": 2}]),
        ({"enum": [True]}, [True], [1, False]),
        ({"type": "object", "properties": {"n": {"type": ["number", "null"], "minimum": 2}}}, [{"n": None}, {"n": 2.5}, {}], [{"n": 1}, {"n": "2"}]),
        ({}, [None, 1, {}], []),
    ],
)
def test_schemas(schema, good, bad):
    assert not [v for v in good if toolcalls.violations(v, schema)] and all(toolcalls.violations(v, schema) for v in bad)

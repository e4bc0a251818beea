"""Chat formatting against a plain Python version over random conversations."""

import json
import random

import pytest

from lodestream.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level string"
FIRST = lambda x: (x is not None, x or 0)  # noqa: E731  nulls come first


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parsed(text):
    if not (text or "").lstrip().startswith("{"):
        return {}
    try:
        return json.loads(text)
    except ValueError:
        return {}


def wrong(schema, arguments):
    """Of one level: required names and types."""
    kinds = {"integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v), "string": lambda v: isinstance(v, str), "null": lambda v: v is None}
    out = [f"missing:{n}" for n in schema.get("required", []) if n not in arguments]
    for name, own in schema.get("properties", {}).items():
        types = [own["type"]] if isinstance(own["type"], str) else own["type"]
        if name in arguments and not any(kinds[t](arguments[name]) for t in types):
            out.append(f"type:{name}")
    return sorted(out)


def brute(rows):
    out, calls, answers, tools = [], {}, {}, {}
    for conv, turn, role, text, _ in rows:
        body = parsed(text)
        if role == "tool" and body.get("tool_call_id") is not None:
            answers.setdefault(conv, []).append([turn, body["tool_call_id"], body.get("content")])
            continue
        calling = role == "assistant" and body.get("tool_calls") is not None
        content = body.get("content") if calling else text or ""
        out.append((conv, turn, 0, 0, "message", role, None, 0, None, True, (), canonical({"content": content, "role": role})))
        for slot, call in enumerate(body["tool_calls"] if calling else [], 1):
            calls.setdefault(conv, []).append({"turn": turn, "slot": slot, **call})
        if role == "system":
            for tool in body.get("tools", []):
                tools.setdefault((conv, tool["name"]), []).append((FIRST(turn), canonical(tool["parameters"]), tool["parameters"]))
    for conv in {*calls, *answers}:
        own, first = calls.get(conv, []), {}
        for call in sorted(own, key=lambda c: (FIRST(c["turn"]), c["slot"], c["name"], canonical(c["arguments"]))):
            if conv is not None and call.get("id") is not None:
                first.setdefault(call["id"], call)
        waits = {i: {a for a in c.get("after", []) if a in first} for i, c in first.items()}
        level, moved = {}, True
        while moved:
            ready = {i: max([level[a] + 1 for a in w], default=0) for i, w in waits.items() if i not in level and all(a in level for a in w)}
            level |= ready
            moved = bool(ready)
        linked = {}
        for turn, of, content in sorted(answers.get(conv, []), key=lambda a: (FIRST(a[0]), (a[2] is not None, a[2] or ""))):
            call = first.get(of) if conv is not None else None
            line = canonical({"call_id": of, "content": content})
            behind = call is not None and FIRST(turn) >= FIRST(call["turn"])
            if behind and of not in linked:
                linked[of] = turn
                out.append((conv, call["turn"], call["slot"], 1, "result", "tool", of, level.get(of, -1), turn, True, (), line))
            else:
                why = "no_call" if call is None else "later_result" if behind else "before_call"
                out.append((conv, turn, 0, 1, "orphan", "tool", of, 0, turn, False, (why,), line))
        for call in own:
            tool = min(tools.get((conv, call["name"]) if conv is not None else None, [(None, None, None)]), key=lambda t: t[:2])[2]
            arguments = call["arguments"]
            problems = ["unknown_tool"] if tool is None else ["arguments_not_an_object"] if not isinstance(arguments, dict) else wrong(tool, arguments)
            i = call.get("id")
            is_first = i is not None and conv is not None and first[i] is call
            if i is not None and conv is not None and not is_first:
                problems.append("duplicate_id")
            if i is None:
                problems.append("no_id")
            if is_first:
                problems += [f"unknown_after:{a}" for a in sorted({*call.get("after", [])} - {*first})] + ["cycle"] * (i not in level)
            line = canonical({"arguments": arguments, "call": {"id": i, "name": call["name"]}})
            out.append((conv, call["turn"], call["slot"], 0, "call", "assistant", i, level.get(i, -1) if is_first else 0, linked.get(i) if is_first else None, not problems, tuple(problems), line))
    return sorted(out, key=repr)


def found(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in out), key=repr)


def conversation(conv, n):
    """Random turns: calls that wait for others, repeated and missing identifiers, results before, behind and without their call."""
    schema = {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": ["string", "null"]}}}
    rows = [(conv, random.choice([0, 0, None]), "system", json.dumps({"tools": [{"name": "f", "parameters": schema}, {"name": random.choice("fg"), "parameters": {"required": ["z"]}}]}), "x")]
    names = [f"c{i}" for i in range(n)]
    for turn in range(1, n):
        kind = random.random()
        if kind < 0.45:
            calls = []
            for _ in range(random.randint(0, 3)):
                call = {"name": random.choice("fgh"), "arguments": random.choice([{"a": 1}, {"a": 1.0, "b": None}, {"b": 2, "a": "é\n"}, {"z": {"q": [1, "x"], "p": 2}}, [1], "no json"])}
                if random.random() < 0.9:
                    call["id"] = random.choice(names)
                if random.random() < 0.6:
                    call["after"] = random.choices([*names, "unknown"], k=random.randint(1, 2))
                calls.append(call)
            rows.append((conv, turn, "assistant", json.dumps({"content": random.choice(["ok", None]), "tool_calls": calls}), "x"))
        elif kind < 0.8:
            rows.append((conv, random.choice([turn, turn, None]), "tool", json.dumps({"tool_call_id": random.choice(names), "content": random.choice(["one", "two", None])}), "x"))
        else:
            rows.append((conv, turn, random.choice(["user", None, "assistant", "tool"]), random.choice([None, "", "plain", '{"broken', '{"tool_calls_": [], "note": "see"}']), "x"))
    return rows + random.sample(rows[1:], min(2, len(rows) - 1)) * (random.random() < 0.3)


def simple(line):
    return line.replace("1.0", "1")  # the value 1.0 is written as 1


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    random.seed(seed)
    rows = [r for conv in [*range(40), None] for r in conversation(conv, random.randint(1, 14))]
    rows.append((3, 2, "user", '{"tool_calls": [], "note": "see this"}', "x"))
    got, told = found(spark, rows), brute(rows)
    assert [(*r[:-1], simple(r[-1])) for r in got] == [(*r[:-1], simple(r[-1])) for r in told]


def test_long_chains_diamonds_and_cycles(spark):
    """A chain of 3000 calls, a ladder of diamonds and calls behind a cycle; the levels come from a few rounds."""
    call = lambda i, *after: {"id": i, "name": "f", "arguments": {}, "after": list(after)}
    chain = [call(f"a{i}", *([f"a{i - 1}"] if i else [])) for i in range(3000)]
    ladder = []
    for i in range(40):
        ladder += [call(f"x{i}", *([f"z{i - 1}"] if i else [])), call(f"y{i}", *([f"z{i - 1}"] if i else [])), call(f"z{i}", f"x{i}", f"y{i}")]
    cycle = [call("p", "q"), call("q", "p"), call("r", "q", "a0"), call("s", "s")]
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": random.sample(chain, len(chain))}), "x"), (1, 2, "assistant", json.dumps({"tool_calls": ladder + cycle}), "x")]
    level = {r[6]: r[7] for r in found(spark, rows) if r[4] == "call"}
    assert all(level[f"a{i}"] == i for i in range(3000))
    assert all((level[f"x{i}"], level[f"y{i}"], level[f"z{i}"]) == (2 * i, 2 * i, 2 * i + 1) for i in range(40))
    assert [level[i] for i in "pqrs"] == [-1] * 4


def test_very_long_text_and_integers_beyond_64_bits(spark):
    tools = {"tools": [{"name": "f", "parameters": {"properties": {"n": {"type": "integer"}, "t": {"type": "string"}}}}]}
    long = "é" * 1_000_000
    rows = [(1, 0, "system", json.dumps(tools), "x"), (1, 1, "user", long, "x"), (1, 2, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"n": 10**25, "t": long}}]}), "x")]
    out = found(spark, rows)
    call = next(r for r in out if r[4] == "call")
    assert call[9] and json.loads(call[11])["arguments"]["t"] == long
    assert json.loads(next(r for r in out if r[5] == "user")[11])["content"] == long

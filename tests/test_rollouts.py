"""Native rollout readers against plain Python ones, on files drawn at random and on odd ones."""

import json
import random

import pytest

from tests import rollouts_plain as plain
from weftline.operators.rollouts import parsed_rollouts

PLAIN = {"atif": plain.atif, "claude_code": plain.claude, "codex": plain.codex, "hermes_agent": plain.hermes, "pi_coding_agent": plain.pi}
WORDS = ["", "hi", "two\nlines", 'q"\\', "ü 😀", "[1]", "{}", "null"]


def some(r, *of):
    return r.choice(of)


def moment(r):
    return some(r, None, "bad", f"2025-01-{r.randint(10, 28)}T0{r.randint(0, 9)}:00:00", f"2025-01-{r.randint(10, 28)}T0{r.randint(0, 9)}:00:00.5+02:00", f"2025-02-{r.randint(10, 28)}T00:00:00Z")


def content(r):
    part = lambda: some(r, "plain", {"type": "text", "text": some(r, *WORDS)}, {"content": some(r, *WORDS)}, {"other": 1})
    return some(r, some(r, *WORDS), None, [], [part() for _ in range(r.randint(1, 3))])


def given(**more):
    return {k: v for k, v in more.items() if v is not None}


def codex_file(r):
    item = lambda p: {"type": "response_item", "timestamp": moment(r), "payload": p}
    out = [{"type": "session_meta", "timestamp": moment(r), "payload": given(id=some(r, None, "s1"), cwd="/w", timestamp=some(r, None, "2024-05-05T00:00:00Z"), git=some(r, None, {"branch": "b"}), git_branch=some(r, None, "g"), originator="o", model_provider=some(r, None, "p"))}] if r.random() < 0.8 else []
    for i in range(r.randint(0, 14)):
        out.append(
            some(
                r,
                item({"type": "message", "role": some(r, "user", "assistant", "developer"), "content": content(r)}),
                item({"type": "reasoning", "summary": [{"text": some(r, *WORDS)}, "no", {"text": f"t{i}"}]}),
                {"type": "event_msg", "payload": {"type": "agent_reasoning", "text": some(r, "", f"e{i}")}},
                item(given(type=some(r, "function_call", "custom_tool_call", "apply_patch_call"), call_id=f"c{i}", name="f", arguments=some(r, '{"a": 1}', {"b": [1, "x"]}, None), input=some(r, None, "in"))),
                item({"type": some(r, "function_call_output", "apply_patch_call_output"), "call_id": f"c{i}", "output": content(r)}),
                {"type": "event_msg", "payload": some(r, "text", [1], None, {"type": "token_count"})},
                item({"type": "web_search_call"}),
            )
        )
    if r.random() < 0.1:
        out.append(item({"type": "function_call", "name": "f"}))
    return "rollout-%d.jsonl", out


def claude_file(r):
    block = lambda i: some(r, {"type": "text", "text": some(r, *WORDS)}, {"type": "thinking", "thinking": some(r, *WORDS)}, {"type": "tool_use", "id": f"c{i}", "name": "n", "input": {"z": 1, "a": [None, True]}}, {"type": "tool_result", "tool_use_id": f"c{i}", "content": content(r)}, "odd")
    line = lambda i: given(type=some(r, "user", "assistant", "system", "summary"), sessionId=some(r, None, "s", "s2"), agentId=some(r, None, None, "a"), cwd=some(r, None, "/c"), gitBranch=some(r, None, "b"), version=some(r, None, "1", "2"), isSidechain=some(r, None, False, True), timestamp=moment(r), message=some(r, None, given(role=some(r, "user", "assistant", None), content=some(r, "say", None, [block(j) for j in range(r.randint(0, 4))]))))
    return "x%d.jsonl", [line(i) for i in range(r.randint(0, 8))]


def hermes_file(r):
    turn = lambda i: given(role=some(r, "user", "assistant", "assistant", "system", "tool"), content=content(r), reasoning=some(r, None, "why"), tool_call_id=f"c{i}", timestamp=moment(r), tool_calls=some(r, None, [{"id": "1", "function": {"name": "f", "arguments": some(r, "{}", {"k": 1})}}, {"id": "2", "name": "g"}]))
    turns = [turn(i) for i in range(r.randint(0, 6))] + ([{"role": "tool", "content": "x"}] if r.random() < 0.1 else [])
    if r.random() < 0.5:
        return "g%d.jsonl", turns
    return "session_%d.json", given(session_id=some(r, None, "h"), system_prompt=some(r, None, "", "be good"), model=some(r, None, "m"), platform="p", session_start=moment(r), last_updated=moment(r), messages=some(r, turns, turns, turns, "none"))


def pi_file(r):
    out = [{"type": "session", "id": some(r, "z", None), "cwd": "/p", "version": 3, "parentSession": some(r, None, "y"), "timestamp": moment(r)}]
    for i in range(1, r.randint(1, 12)):
        m = some(r, {"role": "user", "content": some(r, *WORDS)}, {"role": "assistant", "model": some(r, "a", "b"), "stopReason": some(r, "stop", "toolUse", None), "content": [{"type": "text", "text": "t"}, {"type": "thinking", "thinking": "h"}, {"type": "toolCall", "id": f"c{i}", "name": "n", "arguments": {"x": 1}}]}, {"role": "toolResult", "toolCallId": "c1", "content": [{"type": "text", "text": "r"}]}, {"role": "bashExecution", "command": "ls", "output": "o"})
        kind = some(r, "message", "message", "message", "model_change", "compaction", "custom_message", "label")
        above = some(r, str(i - 1), str(i - 1), str(r.randint(0, i)), None)
        out.append(given(type=kind, id=str(i), parentId=above, timestamp=moment(r), message=m if kind == "message" else None, modelId="c", summary=some(r, None, "", "sum"), content=some(r, "said", ["x"]), display=some(r, True, False)))
    return "p%d.jsonl", out[r.random() < 0.05 :]


def atif_file(r):
    steps = []
    for i in range(1, r.randint(1, 7)):
        source = some(r, "user", "agent", "agent", "system")
        s = given(step_id=i if r.random() < 0.97 else 9, source=source, message=some(r, "", "m", ["a", {"text": "b"}]), timestamp=moment(r), is_copied_context=some(r, None, True, False))
        if source == "agent" or r.random() < 0.02:
            s |= given(reasoning_content=some(r, None, "why"), tool_calls=some(r, None, [{"tool_call_id": "1", "function_name": "f", "arguments": {"q": "x"}}]))
            if s.get("tool_calls"):
                s |= {"observation": {"results": [{"source_call_id": some(r, "1", "1", "1", None), "content": content(r), "subagent_trajectory_ref": some(r, [], [{"session_id": "kid"}])}]}}
        steps.append(s)
    return "a%d.json", {"schema_version": some(r, "1", "1", ""), "session_id": "t", "agent": given(name="n", version=some(r, None, "v"), extra=some(r, None, {"cwd": "/a", "git_branch": "b"})), "steps": steps, "notes": some(r, None, "note"), "final_metrics": some(r, None, {"cost": 1})}


FILES = {"atif": atif_file, "claude_code": claude_file, "codex": codex_file, "hermes_agent": hermes_file, "pi_coding_agent": pi_file}


def told(record):
    """A record with its JSON texts parsed, so that only what they say counts."""

    def value(text):
        try:
            return json.loads(text)
        except ValueError:
            return text

    messages = json.loads(record["messages"])
    for m in messages:
        for c in m.get("tool_calls", []):
            c["function"]["arguments"] = value(c["function"]["arguments"])
    return record | {"messages": messages, "source_meta": json.loads(record["source_meta"])}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_records_are_those_of_the_plain_reader(spark, kind):
    r = random.Random(kind)
    files = []
    for i in range(250):
        name, data = FILES[kind](r)
        files.append((f"/d/{name % i}", (json.dumps(data) if isinstance(data, dict) else some(r, "\n", "\r\n", "\n\n").join(map(json.dumps, data))).encode()))
    end = "json" if kind == "atif" else "jsonl"
    files += [(f"/d/odd{i}.{end}", x) for i, x in enumerate((b"", b"\n \n", b"{broken", b"[1]", b"\xff\xfe", b'"text"', b"null", b'{"type": "session"}'))]
    want, bad = {}, set()
    for path, data in files:
        try:
            want[path] = told(PLAIN[kind](path, data.decode())[0])
        except (plain.RolloutError, ValueError, KeyError, TypeError, AttributeError):
            bad.add(path)
    df = spark.createDataFrame(files, "path string, content binary").repartition(3)
    got = {x["source_path"]: told(x.asDict()) for x in parsed_rollouts(df, kind).collect()}
    assert len(want) > 60 and bad
    assert set(got) == set(want)
    for path in want:
        assert got[path] == want[path], dict(files)[path].decode()
    faults = parsed_rollouts(df, kind, faults=True).collect()
    assert {x["path"] for x in faults} == bad and len(faults) == len(bad) and all(x["fault"] for x in faults)


def test_an_empty_table_of_files(spark):
    for kind in FILES:
        assert parsed_rollouts(spark.createDataFrame([], "path string, content binary"), kind).collect() == []


def test_long_conversations_keep_their_order(spark):
    """Thoughts between calls by the thousand; a file's rows are in one task, in the order of its lines."""
    item = lambda p: json.dumps({"type": "response_item", "payload": p})
    lines = [item({"type": "reasoning", "summary": [{"text": f"t{i}"}]}) if i % 3 else item({"type": "message", "role": "assistant", "content": str(i)}) for i in range(9000)]
    df = spark.createDataFrame([("/d/rollout-1.jsonl", "\n".join(lines).encode())], "path string, content binary")
    x = told(parsed_rollouts(df, "codex").first().asDict())
    assert [m["content"] for m in x["messages"]] == [str(i) for i in range(0, 9000, 3)]
    assert x["messages"][2]["reasoning_content"] == "t4\n\nt5" and x["source_meta"]["unattached_reasoning"] == ["t8998", "t8999"]

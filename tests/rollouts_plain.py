"""Plain Python readers of the five rollout formats, one file at a time, to hold the native ones against."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

ROLES = {"human": "user", "user": "user", "agent": "assistant", "ai": "assistant", "assistant": "assistant", "model": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool", "toolResult": "tool"}


class RolloutError(ValueError):
    pass


def role_of(name: Any) -> str:
    if name not in ROLES:
        raise RolloutError(f"the role {name!r} isn't known")
    return ROLES[name]


def time_of(text: Any) -> dt.datetime | None:
    try:
        at = dt.datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


def span(times: list[Any]) -> tuple[str | None, str | None]:
    """The earliest and latest of the times as they were written; those without an offset are UTC, bad ones are left out."""
    good = [(at, str(t)) for t in times if t and (at := time_of(t)) is not None]
    return (min(good)[1], max(good)[1]) if good else (None, None)


def message(role: str, content: Any, **more: Any) -> dict:
    return {"role": role, "content": content if isinstance(content, str) else "" if content is None else flat_text(content)} | {k: v for k, v in more.items() if v}


def flat_text(content: Any) -> str:
    if isinstance(content, list):
        return "\n".join(x if isinstance(x, str) else str(x.get("text") or x.get("content") or "") for x in content if isinstance(x, (str, dict)))
    return content if isinstance(content, str) else json.dumps(content)


def tool_call(id_: Any, name: Any, arguments: Any) -> dict:
    return {"id": id_, "type": "function", "function": {"name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments or {})}}


def record(kind: str, path: str, trace: str, messages: list[dict], times: list[Any], root: str | None = None, agent: str | None = None, sidechain: bool = False, cwd: str | None = None, branch: str | None = None, meta: dict | None = None, project: str | None = None) -> dict:
    if not messages:
        raise RolloutError("there is no message")
    start, end = span(times)
    last = next((m["content"] for m in reversed(messages) if m["role"] == "assistant" and m["content"]), None)
    return {
        "trace_id": trace, "source_kind": kind, "source_path": path, "root_session_id": root or trace, "agent_id": agent, "is_sidechain": sidechain, "cwd": cwd, "project_path": project or cwd, "git_branch": branch,
        "started_at": start, "ended_at": end, "messages": json.dumps(messages), "source_meta": json.dumps(meta or {}, sort_keys=True), "message_count": len(messages),
        "tool_call_count": sum(len(m.get("tool_calls", [])) for m in messages), "final_assistant_message": last,
    }


def lines(text: str) -> list[dict]:
    out = []
    for line in text.splitlines():
        if line.strip():
            try:
                x = json.loads(line)
            except ValueError:
                raise RolloutError("a line isn't JSON") from None
            if not isinstance(x, dict):
                raise RolloutError("a line is no object")
            out.append(x)
    return out


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def atif(path: str, text: str) -> list[dict]:
    data = json.loads(text)
    if not isinstance(data, dict) or any(not data.get(k) for k in ("schema_version", "session_id", "agent", "steps")):
        raise RolloutError("schema_version, session_id, agent and steps are needed")
    if [s.get("step_id") for s in data["steps"]] != list(range(1, len(data["steps"]) + 1)):
        raise RolloutError("step ids must run from 1")
    messages, copied, children = [], [], []
    for s in data["steps"]:
        if s.get("is_copied_context") is True:
            copied.append(s["step_id"])
        if s.get("source") not in ("user", "agent", "system") or "message" not in s:
            raise RolloutError("a step needs a message from the user, the agent or the system")
        if s["source"] != "agent" and (wrong := [k for k in ("reasoning_content", "tool_calls", "observation") if s.get(k) is not None]):
            raise RolloutError(f"only an agent's step may have {', '.join(wrong)}")
        if any(not (c.get("tool_call_id") and c.get("function_name")) for c in s.get("tool_calls") or []):
            raise RolloutError("a tool call needs an id and a function's name")
        calls = [tool_call(c["tool_call_id"], c["function_name"], c.get("arguments")) for c in s.get("tool_calls") or []]
        messages.append(message(role_of(s["source"]), s["message"], tool_calls=calls, reasoning_content=s.get("reasoning_content")))
        for r in (s.get("observation") or {}).get("results") or []:
            if r.get("source_call_id") is not None and r["source_call_id"] not in {c["id"] for c in calls}:
                raise RolloutError("an observation names a call that the step doesn't make")
            messages.append(message("tool", r.get("content"), tool_call_id=r.get("source_call_id")))
            children += [x.get("session_id") for x in r.get("subagent_trajectory_ref") or []]
    agent = data["agent"]
    extra = agent.get("extra") or {}
    meta = {"schema_version": data["schema_version"], "step_count": len(data["steps"]), "agent_name": agent.get("name"), "version": agent.get("version"), "model_name": agent.get("model_name"), "copied_context_step_ids": copied, "subagent_sessions": children}
    meta |= {k: data.get(k) for k in ("notes", "continued_trajectory_ref", "final_metrics", "extra")}
    meta = {k: v for k, v in meta.items() if v}
    return [record("atif", path, data["session_id"], messages, [s.get("timestamp") for s in data["steps"]], cwd=extra.get("cwd"), project=extra.get("project_path"), branch=extra.get("git_branch"), meta=meta)]


def claude(path: str, text: str) -> list[dict]:
    """One record a session; tool uses are calls, thinking is reasoning, tool results are tool messages."""
    rows, messages = lines(text), []
    for r in rows:
        if r.get("type") not in ("user", "assistant") or not isinstance(r.get("message"), dict):
            continue
        content = r["message"].get("content")
        blocks = [{"type": "text", "text": content}] if isinstance(content, str) else [b for b in content or [] if isinstance(b, dict)]
        said = "\n".join(b.get("text", "") for b in blocks if b.get("type") == "text")
        thought = "\n".join(b.get("thinking", "") for b in blocks if b.get("type") == "thinking")
        calls = [tool_call(b.get("id"), b.get("name"), b.get("input")) for b in blocks if b.get("type") == "tool_use"]
        results = [b for b in blocks if b.get("type") == "tool_result"]
        messages += [message("tool", b.get("content"), tool_call_id=b.get("tool_use_id")) for b in results]
        if said or calls or thought or not results:
            messages.append(message(role_of(r["message"].get("role") or r["type"]), said, tool_calls=calls, reasoning_content=thought))
    get = lambda k: next((r[k] for r in rows if r.get(k)), None)
    side = any(r.get("isSidechain") for r in rows)
    session = get("sessionId") or stem(path)
    agent = get("agentId")
    meta = {"record_count": len(rows), "record_types": sorted({str(r.get("type", "unknown")) for r in rows})}
    if versions := sorted({str(r["version"]) for r in rows if r.get("version")}):
        meta["claude_versions"] = versions
    return [record("claude_code", path, f"{session}:{agent}" if agent else session, messages, [r.get("timestamp") for r in rows], root=session, agent=agent, sidechain=side, cwd=get("cwd"), branch=get("gitBranch"), meta=meta)]


def codex(path: str, text: str) -> list[dict]:
    messages, pending, meta, times, kinds, its = [], [], {}, [], set(), set()
    rows = lines(text)
    for r in rows:
        times.append(r.get("timestamp"))
        kinds.add(r.get("type", "unknown"))
        p = r.get("payload")
        if not isinstance(p, dict):
            continue
        if r.get("type") == "session_meta":
            meta = p
            times.append(p.get("timestamp"))
        if r.get("type") == "event_msg" and p.get("type") == "agent_reasoning" and p.get("text"):
            pending.append(p["text"])
        if r.get("type") != "response_item":
            continue
        kind, thought = p.get("type"), "\n\n".join(pending)
        its.add(kind)
        if kind == "reasoning":
            pending += [x["text"] for x in p.get("summary") or [] if isinstance(x, dict) and x.get("text")]
        elif kind == "message":
            role = role_of(p.get("role"))
            messages.append(message(role, p.get("content"), reasoning_content=thought if role == "assistant" else None))
            pending = []
        elif kind in ("function_call", "custom_tool_call", "apply_patch_call"):
            if not p.get("call_id") or not p.get("name"):
                raise RolloutError("a call lacks its id or name")
            messages.append(message("assistant", "", tool_calls=[tool_call(p["call_id"], p["name"], p.get("arguments", p.get("input")))], reasoning_content=thought))
            pending = []
        elif kind in ("function_call_output", "custom_tool_call_output", "apply_patch_call_output"):
            if not p.get("call_id"):
                raise RolloutError("an output lacks its call's id")
            messages.append(message("tool", p.get("output"), tool_call_id=p["call_id"]))
    told = {k: meta[k] for k in ("originator", "cli_version", "model_provider", "source") if meta.get(k)} | ({"unattached_reasoning": pending} if pending else {}) | {"response_item_types": sorted(its)}
    out = record("codex", path, meta.get("id") or stem(path), messages, times, cwd=meta.get("cwd"), branch=meta.get("git_branch") or (meta.get("git") or {}).get("branch"), meta=told | {"record_count": len(rows), "record_types": sorted(kinds)})
    return [out | {"started_at": meta.get("timestamp") or out["started_at"]}]


def hermes(path: str, text: str) -> list[dict]:
    """A session file with a list of messages, or a gateway log of one message a line; tool messages need their call's id."""
    data = json.loads(text) if path.endswith(".json") else {"messages": lines(text)}
    rows = data.get("messages")
    if not isinstance(rows, list):
        raise RolloutError("there are no messages")
    messages = [message("system", data["system_prompt"])] if data.get("system_prompt") else []
    for r in rows:
        role = role_of(r.get("role"))
        if role == "tool" and not r.get("tool_call_id"):
            raise RolloutError("a tool message lacks its call's id")
        calls = [tool_call(c.get("id"), (c.get("function") or c).get("name"), (c.get("function") or c).get("arguments")) for c in r.get("tool_calls") or []]
        messages.append(message(role, r.get("content"), tool_calls=calls, tool_call_id=r.get("tool_call_id"), reasoning_content=r.get("reasoning")))
    times = [data.get("session_start"), data.get("last_updated"), *(r.get("timestamp") for r in rows)]
    return [record("hermes_agent", path, data.get("session_id") or stem(path).removeprefix("session_"), messages, times, agent=data.get("model"), meta={k: data[k] for k in ("model", "platform") if data.get(k)})]


def pi(path: str, text: str) -> list[dict]:
    """A tree of entries: the branch from the last entry up to the root is the conversation."""
    rows = lines(text)
    header = rows[0] if rows else {}
    if header.get("type") != "session":
        raise RolloutError("the first line must be the session")
    entries = {r["id"]: r for r in rows[1:] if r.get("id")}
    at, branch, seen = rows[-1].get("id"), [], set()
    while at in entries and at not in seen:
        seen.add(at)
        branch.append(entries[at])
        at = entries[at].get("parentId")
    parents = [r.get("parentId") for r in entries.values()]
    messages, models, reasons, bash = [], [], [], 0
    for r in reversed(branch):
        if r["type"] == "model_change":
            models.append(r.get("modelId"))
        elif r["type"] in ("compaction", "branch_summary"):
            messages += [message("system", r["summary"])] if r.get("summary") else []
        elif r["type"] == "custom_message":  # what extensions put into the conversation, if it is shown
            messages += [message("system", r.get("content"))] if r.get("display") else []
        elif r["type"] == "message":
            m = r["message"]
            if m.get("role") == "bashExecution":
                bash += 1
                messages.append(message("assistant", "", tool_calls=[tool_call(r["id"], "bash", {"command": m.get("command")})]))
                messages.append(message("tool", m.get("output"), tool_call_id=r["id"]))
                continue
            if m.get("role") == "assistant":
                models.append(m.get("model"))
                reasons.append(m.get("stopReason"))
            blocks = m.get("content") if isinstance(m.get("content"), list) else [{"type": "text", "text": m.get("content") or ""}]
            calls = [tool_call(b.get("id"), b.get("name"), b.get("arguments")) for b in blocks if b.get("type") == "toolCall"]
            thought = "\n".join(b.get("thinking", "") for b in blocks if b.get("type") == "thinking")
            messages.append(message(role_of(m.get("role")), "\n".join(b.get("text", "") for b in blocks if b.get("type") == "text"), tool_calls=calls, reasoning_content=thought, tool_call_id=m.get("toolCallId")))
    once = lambda xs: list(dict.fromkeys(x for x in xs if x))
    meta = {"record_count": len(rows), "entry_types": sorted({r["type"] for r in branch}), "stop_reasons": once(reasons)}
    more = {"session_version": header.get("version"), "models_used": once(models), "has_branches": any(parents.count(p) > 1 for p in set(parents) if p), "bash_execution_count": bash, "parent_session": header.get("parentSession")}
    return [record("pi_coding_agent", path, header.get("id") or stem(path), messages, [r.get("timestamp") for r in rows], cwd=header.get("cwd"), meta=meta | {k: v for k, v in more.items() if v})]

"""Agent rollouts: five file formats read into one record for each conversation.

Files are read whole by Spark. Their lines or steps become rows, each is turned into
messages by native expressions over variants, and a file's rows are grouped into its
record; the one thing that isn't an expression is the walk up a tree of entries,
over their ids alone. Rows of a file go to one task, as its record holds them all.

A file that can't be parsed is left out (its path and fault can be listed); a file
that can't be read fails the job. Empty files, and files without a message, are
faults. JSON texts within records are compact and have their names in order; what
is null or empty is left out of messages and, mostly, of ``source_meta``. A JSON text (a line, or
a whole ``.json`` file) may be as large as a variant; a larger one is a fault, and so
is one with a name twice in one object. Of lists of sessions the last by path counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = (
    "trace_id string, source_kind string, source_path string, root_session_id string, agent_id string, is_sidechain boolean, cwd string, project_path string, git_branch string, started_at string, "
    "ended_at string, messages string, source_meta string, message_count long, tool_call_count long, final_assistant_message string"
)
CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string,reasoning_content:string>"
ROLES = {"human": "user", "user": "user", "agent": "assistant", "ai": "assistant", "assistant": "assistant", "model": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool", "toolResult": "tool"}
NOT_JSON, NO_OBJECT = "a line isn't JSON", "a line is no object"


# ---- variants


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def given(v: Column, path: str) -> Column:
    """Text that isn't empty."""
    return F.nullif(at(v, path), F.lit(""))


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def items(v: Column, path: str) -> Column:
    """A list's elements; of what is no list, none."""
    return F.coalesce(at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def flat(v: Column) -> Column:
    """Content as text: a list's texts by lines, what is no text as JSON."""
    one = lambda x: F.when(is_kind(x, "STRING"), at(x, "$")).when(is_kind(x, "OBJECT"), F.coalesce(given(x, "$.text"), given(x, "$.content"), F.lit("")))
    some = F.array_join(F.transform(items(v, "$"), one), "\n")
    return F.when(v.isNull() | F.is_variant_null(v), "").when(is_kind(v, "ARRAY"), some).when(is_kind(v, "STRING"), at(v, "$")).otherwise(F.to_json(v))


def part(v: Column, path: str) -> Column:
    return at(v, path, "variant")


def quoted(x: Column) -> Column:
    """A value as JSON text."""
    return F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", "")


# ---- messages


def role_of(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.coalesce(name, F.lit("")))


def role_fault(name: Column) -> Column:
    return F.when(role_of(name).isNull(), F.concat(F.lit("the role "), F.coalesce(name, F.lit("null")), F.lit(" isn't known")))


def call(id_: Column, name: Column, arguments: Column) -> Column:
    text = F.when(arguments.isNull() | F.is_variant_null(arguments), "{}").when(is_kind(arguments, "STRING"), at(arguments, "$")).otherwise(F.to_json(arguments))
    return F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), text.alias("arguments")).alias("function")).cast(CALL)


def message(role: Column | str, content: Column | None = None, calls: Column | None = None, call_id: Column | None = None, thought: Column | None = None) -> Column:
    nothing = F.lit(None)
    held = F.when(F.size(calls) > 0, calls) if calls is not None else nothing
    fields = {"role": F.lit(role) if isinstance(role, str) else role, "content": F.coalesce(content, F.lit("")) if content is not None else F.lit(""), "tool_calls": held}
    fields |= {"tool_call_id": F.nullif(call_id, F.lit("")) if call_id is not None else nothing, "reasoning_content": F.nullif(thought, F.lit("")) if thought is not None else nothing}
    return F.struct(*(x.alias(n) for n, x in fields.items())).cast(MESSAGE)


def nothing_said() -> Column:
    return F.array().cast(f"array<{MESSAGE}>")


def blocks_text(blocks: Column, kind: str, name: str) -> Column:
    """The texts of a message's blocks of one type, by lines."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: at(b, "$.type") == kind), lambda b: F.coalesce(at(b, f"$.{name}"), F.lit(""))), "\n")


def blocks_calls(blocks: Column, kind: str, arguments: str) -> Column:
    return F.transform(F.filter(blocks, lambda b: at(b, "$.type") == kind), lambda b: call(at(b, "$.id"), at(b, "$.name"), part(b, f"$.{arguments}")))


def objects(v: Column) -> Column:
    return F.filter(items(v, "$"), lambda b: is_kind(b, "OBJECT"))


# ---- rows of files


def when_written(text: Column) -> Column:
    """(moment, text) of a time; without an offset it is UTC; null for what is no time."""
    dated = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$|^.{10}$"), text).otherwise(F.concat(text, F.lit("Z"))))
    moment = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(dated).try_cast("timestamp")
    return F.when(moment.isNotNull(), F.struct(moment.alias("moment"), text.alias("text")))


def by_lines(files: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: path, pos, v, fault; one row of nulls for a file without any."""
    text = F.col("content").cast("string")
    parsed = F.transform(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), F.try_parse_json)
    rows = files.select("path", F.when(~F.is_valid_utf8(text), "it isn't UTF-8").alias("bad"), F.posexplode_outer(parsed).alias("pos", "v"))
    return rows.select("path", "pos", "v", F.coalesce("bad", line_fault(F.col("pos"), F.col("v"))).alias("fault"))


def line_fault(pos: Column, v: Column) -> Column:
    return F.when(pos.isNotNull() & v.isNull(), NOT_JSON).when(pos.isNotNull() & ~is_kind(v, "OBJECT"), NO_OBJECT)


def first_of(x: Column) -> Column:
    """The first row's that has one."""
    return F.min_by(x, F.when(x.isNotNull(), F.col("pos")))


def in_order(x: Column) -> Column:
    """The rows' arrays on end."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(x) > 0, F.struct("pos", x.alias("held"))))), lambda r: r["held"]))


def kinds_seen(x: Column) -> Column:
    return F.array_sort(F.collect_set(x))


@dataclass
class Told:
    """A format's rows (path, pos, said, times, fault, and what ``own`` aggregates), and what its record's columns are."""

    rows: DataFrame
    own: dict[str, Column] = field(default_factory=dict)
    columns: dict[str, Column] = field(default_factory=dict)
    meta: dict[str, Column] = field(default_factory=dict)  # JSON texts
    always: tuple[str, ...] = ("record_count",)  # of ``meta``, what is told though it be empty


def atif(files: DataFrame) -> Told:
    doc = files.select("path", F.try_parse_json(F.col("content").cast("string")).alias("d"))
    d, s, agent = F.col("d"), F.col("v"), part(F.col("d"), "$.agent")
    lacking = F.lit(False)
    for k in ("schema_version", "session_id", "agent", "steps"):
        lacking = lacking | at(d, f"$.{k}").isNull() | at(d, f"$.{k}").isin("", "{}", "[]")
    bad = F.when(d.isNull(), "it isn't JSON").when(lacking, "schema_version, session_id, agent and steps are needed")
    told = {"session": at(d, "$.session_id"), "cwd": at(agent, "$.extra.cwd"), "project": at(agent, "$.extra.project_path"), "branch": at(agent, "$.extra.git_branch")}
    plain = {"schema_version": part(d, "$.schema_version"), "agent_name": part(agent, "$.name"), "version": part(agent, "$.version"), "model_name": part(agent, "$.model_name")}
    plain |= {k: part(d, f"$.{k}") for k in ("notes", "continued_trajectory_ref", "final_metrics", "extra")}
    heads = {**told, **{f"m_{k}": F.to_json(x) for k, x in plain.items()}}
    rows = doc.select("path", bad.alias("bad"), *(x.alias(k) for k, x in heads.items()), F.posexplode_outer(items(d, "$.steps")).alias("pos", "v"))
    source, calls = at(s, "$.source"), items(s, "$.tool_calls")
    made = F.transform(calls, lambda c: call(at(c, "$.tool_call_id"), at(c, "$.function_name"), part(c, "$.arguments")))
    results = items(s, "$.observation.results")
    said = F.concat(F.array(message(role_of(source), flat(part(s, "$.message")), made, None, at(s, "$.reasoning_content"))), F.transform(results, lambda r: message("tool", flat(part(r, "$.content")), None, at(r, "$.source_call_id"))))
    held = lambda k: part(s, f"$.{k}").isNotNull() & ~F.is_variant_null(part(s, f"$.{k}"))
    only = F.array_join(F.array_compact(F.array(*(F.when(held(k), k) for k in ("reasoning_content", "tool_calls", "observation")))), ", ")
    ids = F.transform(calls, lambda c: at(c, "$.tool_call_id"))
    fault = F.coalesce(
        F.col("bad"),
        F.when(F.coalesce(at(s, "$.step_id", "long"), F.lit(-1)) != F.col("pos") + 1, "step ids must run from 1"),
        F.when(~F.coalesce(source.isin("user", "agent", "system"), F.lit(False)) | part(s, "$.message").isNull(), "a step needs a message from the user, the agent or the system"),
        F.when((source != "agent") & (only != ""), F.concat(F.lit("only an agent's step may have "), only)),
        F.when(F.exists(calls, lambda c: given(c, "$.tool_call_id").isNull() | given(c, "$.function_name").isNull()), "a tool call needs an id and a function's name"),
        F.when(F.exists(results, lambda r: at(r, "$.source_call_id").isNotNull() & ~F.coalesce(F.array_contains(ids, at(r, "$.source_call_id")), F.lit(False))), "an observation names a call that the step doesn't make"),
    )
    children = F.flatten(F.transform(results, lambda r: F.transform(items(r, "$.subagent_trajectory_ref"), lambda x: at(x, "$.session_id"))))
    step = F.when(at(s, "$.is_copied_context", "boolean"), at(s, "$.step_id", "long"))
    rows = rows.select("path", "pos", F.when(F.col("pos").isNotNull() & fault.isNull(), said).otherwise(nothing_said()).alias("said"), F.array(at(s, "$.timestamp")).alias("times"), F.when(F.col("pos").isNull(), F.col("bad")).otherwise(fault).alias("fault"), *heads, children.alias("children"), step.alias("copied"))
    own = {k: F.any_value(k) for k in heads} | {"steps": F.count("pos"), "children": in_order(F.col("children")), "copied": F.array_sort(F.collect_list("copied"))}
    meta = {k: F.col(f"m_{k}") for k in plain} | {"step_count": quoted(F.col("steps")), "copied_context_step_ids": F.to_json("copied"), "subagent_sessions": F.to_json("children")}
    return Told(rows, own, {"trace_id": F.col("session"), "cwd": F.col("cwd"), "project_path": F.coalesce("project", "cwd"), "git_branch": F.col("branch")}, meta)


def claude(files: DataFrame) -> Told:
    """One record a session; tool uses are calls, thinking is reasoning, tool results are tool messages."""
    v, kind = F.col("v"), at(F.col("v"), "$.type")
    content, whole = part(v, "$.message.content"), is_kind(part(v, "$.message.content"), "STRING")
    blocks = objects(content)
    said = F.when(whole, at(content, "$")).otherwise(blocks_text(blocks, "text", "text"))
    thought, calls = blocks_text(blocks, "thinking", "thinking"), blocks_calls(blocks, "tool_use", "input")
    results = F.filter(blocks, lambda b: at(b, "$.type") == "tool_result")
    answers = F.transform(results, lambda b: message("tool", flat(part(b, "$.content")), None, at(b, "$.tool_use_id")))
    name = F.coalesce(given(v, "$.message.role"), kind)
    main = F.when((said != "") | (thought != "") | (F.size(calls) > 0) | (F.size(results) == 0), F.array(message(role_of(name), said, calls, None, thought))).otherwise(nothing_said())
    talks = F.coalesce(kind.isin("user", "assistant"), F.lit(False)) & is_kind(part(v, "$.message"), "OBJECT")
    fields = {"session": "sessionId", "agent": "agentId", "cwd": "cwd", "branch": "gitBranch"}
    rows = by_lines(files).select("path", "pos", F.when(talks, F.concat(answers, main)).otherwise(nothing_said()).alias("said"), F.array(at(v, "$.timestamp")).alias("times"), F.coalesce(F.col("fault"), F.when(talks, role_fault(name))).alias("fault"), *(given(v, f"$.{x}").alias(k) for k, x in fields.items()), F.when(F.col("pos").isNotNull(), F.coalesce(kind, F.lit("unknown"))).alias("kind"), given(v, "$.version").alias("version"), at(v, "$.isSidechain", "boolean").alias("side"))
    own = {k: first_of(F.col(k)) for k in fields} | {"side": F.coalesce(F.bool_or("side"), F.lit(False)), "n": F.count("pos"), "kinds": kinds_seen(F.col("kind")), "versions": kinds_seen(F.col("version"))}
    root = F.coalesce("session", stem(F.col("path")))
    columns = {"trace_id": F.concat_ws(":", root, "agent"), "root_session_id": root, "agent_id": F.col("agent"), "is_sidechain": F.col("side"), "cwd": F.col("cwd"), "git_branch": F.col("branch")}
    return Told(rows, own, columns, {"record_count": quoted(F.col("n")), "record_types": F.to_json("kinds"), "claude_versions": F.to_json("versions")})


def codex(files: DataFrame) -> Told:
    """Reasoning waits for the next message or call and is that one's, if it is the assistant's; outputs are tool messages.

    Lines are parted behind each message and call, so a part's reasoning belongs to its last line; what waits behind the last of
    them is told in ``source_meta``. Lines whose payload is no object say nothing.
    """
    v, p = F.col("v"), F.col("p")
    lines = by_lines(files).withColumn("kind", F.when(F.col("pos").isNotNull(), F.coalesce(at(v, "$.type"), F.lit("unknown")))).withColumn("p", F.when(is_kind(part(v, "$.payload"), "OBJECT"), part(v, "$.payload")))
    item = F.when((F.col("kind") == "response_item") & p.isNotNull(), F.coalesce(at(p, "$.type"), F.lit("unknown")))
    talks, calls, answers = item == "message", item.isin("function_call", "custom_tool_call", "apply_patch_call"), item.isin("function_call_output", "custom_tool_call_output", "apply_patch_call_output")
    summary = F.filter(F.transform(objects(part(p, "$.summary")), lambda x: given(x, "$.text")), lambda x: x.isNotNull())
    aside = (F.col("kind") == "event_msg") & (at(p, "$.type") == "agent_reasoning") & given(p, "$.text").isNotNull()
    thoughts = F.when(item == "reasoning", summary).when(aside, F.array(given(p, "$.text"))).otherwise(F.array().cast("array<string>"))
    name, id_ = at(p, "$.role"), given(p, "$.call_id")
    arguments = F.coalesce(part(p, "$.arguments"), part(p, "$.input"))
    said = F.when(talks, message(role_of(name), flat(part(p, "$.content")))).when(calls, message("assistant", None, F.array(call(id_, at(p, "$.name"), arguments)))).when(answers, message("tool", flat(part(p, "$.output")), None, id_))
    fault = F.coalesce(F.col("fault"), F.when(talks, role_fault(name)), F.when((calls | answers) & id_.isNull(), "a tool call or its output lacks the call's id"), F.when(calls & given(p, "$.name").isNull(), "a tool call lacks its tool's name"))
    head = F.when(F.col("kind") == "session_meta", p)
    fields = {"id": "id", "cwd": "cwd", "begun": "timestamp", "originator": "originator", "cli_version": "cli_version", "model_provider": "model_provider", "source": "source"}
    rows = lines.select("path", "pos", "kind", item.alias("item"), said.alias("one"), thoughts.alias("thoughts"), F.coalesce(talks | calls, F.lit(False)).alias("ends"), F.array(at(v, "$.timestamp"), at(head, "$.timestamp")).alias("times"), fault.alias("fault"), *(given(head, f"$.{x}").alias(k) for k, x in fields.items()), F.coalesce(given(head, "$.git_branch"), given(head, "$.git.branch")).alias("branch"))
    parts = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.count_if("ends").over(parts), F.lit(0)))
    last = {k: F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.col("pos"))) for k in [*fields, "branch"]}
    fold = rows.groupBy("path", "part").agg(F.min("pos").alias("pos"), in_order(F.array_compact(F.array("one"))).alias("some"), in_order(F.col("thoughts")).alias("thoughts"), F.bool_or("ends").alias("ended"), F.flatten(F.collect_list("times")).alias("times"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.coalesce("pos", F.lit(-1)))).alias("fault"), F.count("pos").alias("n"), F.collect_set("kind").alias("kinds"), F.collect_set("item").alias("its"), *(x.alias(k) for k, x in last.items()))
    final = F.element_at("some", -1)
    thinking = final.withField("reasoning_content", F.nullif(F.array_join("thoughts", "\n\n"), F.lit("")))
    ended = F.when(final["role"] == "assistant", F.concat(F.slice("some", 1, F.size("some") - 1), F.array(thinking))).otherwise(F.col("some"))
    fold = fold.withColumn("said", F.when(F.col("ended"), ended).otherwise(F.col("some"))).withColumn("left", F.when(~F.col("ended"), F.col("thoughts")).otherwise(F.array().cast("array<string>")))
    several = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    own = last | {"n": F.sum("n"), "kinds": several("kinds"), "its": several("its"), "left": in_order(F.col("left"))}
    columns = {"trace_id": F.coalesce("id", stem(F.col("path"))), "cwd": F.col("cwd"), "git_branch": F.col("branch"), "started_at": F.coalesce("begun", F.col("low.text"))}
    meta = {k: F.when(F.col(k).isNotNull(), quoted(F.col(k))) for k in ("originator", "cli_version", "model_provider", "source")}
    return Told(fold, own, columns, meta | {"record_count": quoted(F.col("n")), "record_types": F.to_json("kinds"), "response_item_types": F.to_json("its"), "unattached_reasoning": F.to_json("left")}, ("record_count", "response_item_types"))


def hermes(files: DataFrame) -> Told:
    """A session file with a list of messages, or a gateway log of one message a line; tool messages need their call's id."""
    text, v = F.col("content").cast("string"), F.col("v")
    whole = F.endswith(F.col("path"), F.lit(".json"))
    doc = files.select("path", F.when(whole, F.try_parse_json(text)).alias("d"), F.when(~whole, F.transform(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), F.try_parse_json)).alias("logged"), F.when(~F.is_valid_utf8(text), "it isn't UTF-8").alias("bad"))
    d = F.col("d")
    bad = F.coalesce(F.col("bad"), F.when(whole & d.isNull(), "it isn't JSON"), F.when(whole & at(d, "$.messages", "array<variant>").isNull(), "there are no messages"))
    heads = {"session": given(d, "$.session_id"), "prompt": given(d, "$.system_prompt"), "model": given(d, "$.model"), "platform": given(d, "$.platform"), "begun": at(d, "$.session_start"), "ended": at(d, "$.last_updated")}
    rows = doc.select("path", bad.alias("bad"), *(x.alias(k) for k, x in heads.items()), F.posexplode_outer(F.when(whole, items(d, "$.messages")).otherwise(F.col("logged"))).alias("pos", "v"))
    name, id_ = at(v, "$.role"), given(v, "$.tool_call_id")
    inner = lambda c: F.coalesce(F.when(is_kind(part(c, "$.function"), "OBJECT"), part(c, "$.function")), c)
    calls = F.transform(objects(part(v, "$.tool_calls")), lambda c: call(at(c, "$.id"), at(inner(c), "$.name"), part(inner(c), "$.arguments")))
    fault = F.coalesce(F.col("bad"), line_fault(F.col("pos"), v), F.when(F.col("pos").isNotNull(), F.coalesce(role_fault(name), F.when((role_of(name) == "tool") & id_.isNull(), "a tool message lacks its call's id"))))
    said = F.when(F.col("pos").isNotNull() & fault.isNull(), F.array(message(role_of(name), flat(part(v, "$.content")), calls, id_, at(v, "$.reasoning")))).otherwise(nothing_said())
    opening = F.when(F.coalesce(F.col("pos"), F.lit(0)).isin(0) & F.col("prompt").isNotNull(), F.array(message("system", F.col("prompt")))).otherwise(nothing_said())
    rows = rows.select("path", F.coalesce("pos", F.lit(0)).alias("pos"), F.concat(opening, said).alias("said"), F.array(F.col("begun"), F.col("ended"), at(v, "$.timestamp")).alias("times"), fault.alias("fault"), "session", "model", "platform")
    own = {k: F.any_value(k) for k in ("session", "model", "platform")}
    columns = {"trace_id": F.coalesce("session", F.regexp_replace(stem(F.col("path")), "^session_", "")), "agent_id": F.col("model")}
    return Told(rows, own, columns, {k: F.when(F.col(k).isNotNull(), quoted(F.col(k))) for k in ("model", "platform")})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def branch_of(ids: pd.Series, parents: pd.Series) -> pd.Series:
    """Places of the entries from the root down to the last one. Of an id that is there twice the later entry counts."""

    def walk(mine: list, above: list) -> list[int]:
        place = {x: i for i, x in enumerate(mine) if x and i}
        step, seen = mine[-1] if len(mine) else None, {}
        while step in place and step not in seen:
            seen[step] = place[step]
            step = above[place[step]]
        return list(seen.values())[::-1]

    return pd.Series([walk(list(i), list(p)) for i, p in zip(ids, parents, strict=True)])


def pi(files: DataFrame) -> Told:
    """A tree of entries: the branch from the last entry up to the root is the conversation."""
    text, v = F.col("content").cast("string"), F.col("v")
    parsed = F.transform(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), F.try_parse_json)
    held = files.select("path", parsed.alias("all"), F.when(~F.is_valid_utf8(text), "it isn't UTF-8").alias("bad"))
    head = F.get("all", F.lit(0))
    broken = F.when(F.exists("all", lambda x: x.isNull()), NOT_JSON).when(F.exists("all", lambda x: ~is_kind(x, "OBJECT")), NO_OBJECT)
    bad = F.coalesce(F.col("bad"), broken, F.when(F.coalesce(at(head, "$.type"), F.lit("")) != "session", "the first line must be the session"))
    ids = held.withColumns({"bad": bad, "ids": F.transform("all", lambda x: at(x, "$.id")), "parents": F.transform("all", lambda x: at(x, "$.parentId"))})
    # Entries beyond the first line, one for each id: where two have one parent, the tree has branches.
    several = F.map_from_entries(F.filter(F.arrays_zip(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), F.slice("parents", 2, F.greatest(F.size("ids") - 1, F.lit(0)))), lambda x: F.coalesce(x["0"], F.lit("")) != ""))
    above = F.filter(F.map_values(several), lambda x: F.coalesce(x, F.lit("")) != "")
    heads = {"session": given(head, "$.id"), "cwd": at(head, "$.cwd"), "version": F.to_json(part(head, "$.version")), "parent": given(head, "$.parentSession"), "branches": F.size(F.array_distinct(above)) < F.size(above), "n": F.size("all")}
    times = F.transform("all", lambda x: at(x, "$.timestamp"))
    walked = ids.withColumn("branch", F.when(F.col("bad").isNull(), branch_of("ids", "parents")))
    rows = walked.select("path", "bad", times.alias("written"), *(x.alias(k) for k, x in heads.items()), F.posexplode_outer(F.transform("branch", lambda i: F.get("all", i))).alias("pos", "v"))
    kind, m = at(v, "$.type"), part(v, "$.message")
    name, content = at(m, "$.role"), part(m, "$.content")
    blocks, shell = objects(content), F.coalesce(at(m, "$.role") == "bashExecution", F.lit(False))
    said = F.when(is_kind(content, "ARRAY"), blocks_text(blocks, "text", "text")).otherwise(F.coalesce(at(content, "$"), F.lit("")))
    talk = message(role_of(name), said, blocks_calls(blocks, "toolCall", "arguments"), at(m, "$.toolCallId"), blocks_text(blocks, "thinking", "thinking"))
    command = F.try_parse_json(F.to_json(F.struct(at(m, "$.command").alias("command"))))
    ran = F.array(message("assistant", None, F.array(call(at(v, "$.id"), F.lit("bash"), command))), message("tool", flat(part(m, "$.output")), None, at(v, "$.id")))
    summed = F.when(given(v, "$.summary").isNotNull(), F.array(message("system", given(v, "$.summary"))))
    shown = F.when(at(v, "$.display", "boolean"), F.array(message("system", flat(part(v, "$.content")))))
    every = F.when(kind.isin("compaction", "branch_summary"), summed).when(kind == "custom_message", shown).when((kind == "message") & shell, ran).when(kind == "message", F.array(talk))
    fault = F.coalesce(F.col("bad"), F.when((kind == "message") & ~shell, role_fault(name)))
    answer = (kind == "message") & (name == "assistant")
    once = lambda x: F.array_compact(F.array(x))
    models = F.when(kind == "model_change", given(v, "$.modelId")).when(answer, given(m, "$.model"))
    rows = rows.select("path", "pos", F.when(fault.isNull(), F.coalesce(every, nothing_said())).otherwise(nothing_said()).alias("said"), F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("written")).otherwise(F.array().cast("array<string>")).alias("times"), fault.alias("fault"), *heads, kind.alias("kind"), once(models).alias("models"), once(F.when(answer, given(m, "$.stopReason"))).alias("reasons"), ((kind == "message") & shell).alias("shell"))
    own = {k: F.any_value(k) for k in heads} | {"kinds": kinds_seen(F.col("kind")), "models": F.array_distinct(in_order(F.col("models"))), "reasons": F.array_distinct(in_order(F.col("reasons"))), "shells": F.count_if("shell")}
    meta = {"record_count": quoted(F.col("n")), "entry_types": F.to_json("kinds"), "stop_reasons": F.to_json("reasons"), "session_version": F.col("version"), "models_used": F.to_json("models")}
    meta |= {"has_branches": quoted(F.col("branches")), "bash_execution_count": quoted(F.col("shells")), "parent_session": F.when(F.col("parent").isNotNull(), quoted(F.col("parent")))}
    return Told(rows, own, {"trace_id": F.coalesce("session", stem(F.col("path"))), "cwd": F.col("cwd")}, meta, ("record_count", "stop_reasons"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


# ---- lists of sessions: (session, of, entry), and what a record takes from its entry


def claude_entries(lists: DataFrame) -> DataFrame:
    each = lists.select("path", F.explode(items(F.try_parse_json(F.col("content").cast("string")), "$.entries")).alias("e"))
    return each.select(given(F.col("e"), "$.sessionId").alias("session"), F.col("path").alias("of"), F.to_json("e").alias("entry"))


def hermes_entries(lists: DataFrame) -> DataFrame:
    """A key's session, or an entry that names it."""
    each = lists.select("path", F.explode(at(F.try_parse_json(F.col("content").cast("string")), "$", "map<string,variant>")).alias("key", "e"))
    e, key = F.col("e"), F.concat(F.lit('{"session_key":'), quoted(F.col("key")))
    plain = is_kind(e, "STRING")
    more = F.when(plain | (F.to_json(e) == "{}"), F.concat(key, F.lit("}"))).otherwise(F.concat(key, F.lit(","), F.substr(F.to_json(e), F.lit(2))))
    return each.select(F.when(plain, F.nullif(at(e, "$"), F.lit(""))).otherwise(given(e, "$.session_id")).alias("session"), F.col("path").alias("of"), more.alias("entry"))


def claude_taken(e: Column) -> tuple[dict[str, Column], Column]:
    taken = {"summary": F.to_json(part(e, "$.summary")), "first_prompt": F.to_json(part(e, "$.firstPrompt"))}
    return {"project_path": F.coalesce(given(e, "$.projectPath"), F.col("project_path"))}, F.map_from_arrays(F.array(*map(F.lit, taken)), F.array(*taken.values()))


def hermes_taken(e: Column) -> tuple[dict[str, Column], Column]:
    """Only of gateway logs; a session file tells of itself."""
    log = ~F.endswith(F.col("source_path"), F.lit(".json"))
    told = F.map_filter(at(e, "$", "map<string,variant>"), lambda k, _: log & ~k.isin("session_id", "created_at", "updated_at"))
    times = {c: F.coalesce(F.when(log, given(e, f"$.{n}")), F.col(c)) for c, n in (("started_at", "created_at"), ("ended_at", "updated_at"))}
    return times, F.transform_values(told, lambda _, x: F.to_json(x))


FORMATS: dict[str, tuple[str, Callable[[DataFrame], Told]]] = {"atif": ("*.json", atif), "claude_code": ("*.jsonl", claude), "codex": ("rollout-*.jsonl", codex), "hermes_agent": ("*.json*", hermes), "pi_coding_agent": ("*.jsonl", pi)}
#: Files that list sessions, how they are read, and what a record takes over from its session's entry.
INDEXES: dict[str, tuple[str, Callable[[DataFrame], DataFrame], Callable[[Column], tuple[dict[str, Column], Column]]]] = {"claude_code": ("sessions-index.json", claude_entries, claude_taken), "hermes_agent": ("sessions.json", hermes_entries, hermes_taken)}
#: Files within a format's pattern that aren't sessions.
OTHER = {"claude_code": r"(^|/)tool-results/|(^|/)history\.jsonl$", "hermes_agent": r"(^|/)sessions\.json$|(^|/)(?!session_)[^/]*\.json$"}


def read_rollouts(spark: SparkSession, kind: str, path: str, pattern: str | None = None, faults: bool = False) -> DataFrame:
    """Records of all files below the path; or, with ``faults``, the files left out and why.

    Where the format keeps lists of sessions, records are joined with them by session.
    """
    glob, _ = FORMATS[kind]
    scan = lambda g: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    files = scan(pattern or glob)
    if kind in OTHER:
        files = files.where(~F.col("path").rlike(OTHER[kind]))
    return parsed_rollouts(files, kind, scan(INDEXES[kind][0]) if kind in INDEXES else None, faults)


def parsed_rollouts(files: DataFrame, kind: str, listed: DataFrame | None = None, faults: bool = False) -> DataFrame:
    """The same of files that are held as rows (path, content), and of the files that list their sessions."""
    told = FORMATS[kind][1](files)
    moments = F.transform("times", when_written)
    rows = told.rows.withColumns({"low": F.array_min(moments), "high": F.array_max(moments)})
    fault = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.coalesce("pos", F.lit(-1))))
    whole = rows.groupBy("path").agg(in_order(F.col("said")).alias("said"), F.min("low").alias("low"), F.max("high").alias("high"), fault.alias("fault"), *(x.alias(k) for k, x in told.own.items()))
    why = F.coalesce("fault", F.when(F.size("said") == 0, "there is no message"))
    if faults:
        return whole.select("path", why.alias("fault")).where("fault is not null")
    meta = F.map_from_arrays(F.array(*map(F.lit, told.meta)), F.array(*told.meta.values()))
    spoken = F.filter("said", lambda m: (m["role"] == "assistant") & (m["content"] != ""))
    columns = {"source_kind": F.lit(kind), "source_path": F.col("path"), "root_session_id": told.columns["trace_id"], "agent_id": F.lit(None), "is_sidechain": F.lit(False), "cwd": F.lit(None), "project_path": told.columns.get("cwd", F.lit(None)), "git_branch": F.lit(None)}
    columns |= {"started_at": F.col("low.text"), "ended_at": F.col("high.text"), "messages": F.to_json("said"), "source_meta": meta, "message_count": F.size("said"), "final_assistant_message": F.get(spoken, F.size(spoken) - 1)["content"]}
    columns |= {"tool_call_count": F.aggregate(F.transform("said", lambda m: F.greatest(F.size(m["tool_calls"]), F.lit(0))), F.lit(0), lambda n, x: n + x)} | told.columns
    out = whole.where(why.isNull()).select(*(x.alias(k) for k, x in columns.items()))
    if listed is not None and kind in INDEXES:
        _, read, taken = INDEXES[kind]
        entries = read(listed).where("session is not null").groupBy("session").agg(F.max_by("entry", "of").alias("entry"))
        over, more = taken(F.try_parse_json("entry"))
        more = F.coalesce(more, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        merged = F.map_concat(F.map_filter("source_meta", lambda k, _: ~F.map_contains_key(more, k)), more)
        out = out.join(entries, F.col("root_session_id") == F.col("session"), "left").withColumns(over | {"source_meta": merged})
    held = F.filter(F.map_entries("source_meta"), lambda e: e["key"].isin(*told.always) | ~F.coalesce(e["value"].isin("null", '""', "[]", "{}", "0", "false"), F.lit(True)))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(held), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    names = [(x.split()[0], x.split()[1]) for x in RECORD.split(", ")]
    return out.withColumn("source_meta", text).select(*(F.col(n).cast(t).alias(n) for n, t in names))


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """message_count and final_assistant_message of conversations held as rows, by aggregation."""
    last = F.max_by(F.when(F.col(role) == "assistant", F.col(text)), F.when(F.col(role) == "assistant", F.col(turn)))
    return turns.groupBy(conv).agg(F.count(F.lit(1)).alias("message_count"), last.alias("final_assistant_message"))

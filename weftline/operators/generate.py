"""Columns made by models: prompts are native columns, calls run in Arrow batches with one client per partition.

A task keeps calls in flight in threads, as calls wait for a server; how many run at once over all tasks, and whether so
many fail that the run stops, a gate on the driver decides (``operators.gate``). Each row is asked for once. A client is a function ``client(kind, messages, parameters) -> dict`` with ``content`` and, if it has any,
``reasoning``, ``usage`` and, for embeddings and images, ``data``. It is given by the caller; ``EchoClient`` is an
offline stand-in whose answers are a function of the prompt.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import closing, nullcontext
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.draws import uniform
from weftline.functions.jsonrepair import repair
from weftline.functions.template import Compiler
from weftline.operators.gate import Address, Leases
from weftline.operators.samplers import SamplerError, pick
from weftline.operators.validate import code_block, conforms, pruned, struct_of
from weftline.sources.media import IMAGES, MediaError, MediaStore


class ModelError(RuntimeError):
    """``retry`` says whether the same call may succeed later."""

    def __init__(self, message: str, retry: bool = False, status: int | None = None) -> None:
        super().__init__(message)
        self.retry, self.status = retry, status


@dataclass
class EchoClient:
    """Answers from the prompt's digest; for tests and previews without a network."""

    dimension: int = 4

    def __call__(self, kind: str, messages: list[dict], parameters: dict) -> dict:
        prompt = messages[-1]["content"]
        prompt = prompt if isinstance(prompt, str) else "".join(b.get("text") or f"<{b['type']}>" for b in prompt)
        digest = hashlib.sha256(prompt.encode()).digest()
        if kind == "embedding":
            return {"data": [[(digest[(i + k) % 32] / 255) for k in range(self.dimension)] for i, _ in enumerate(json.loads(prompt))]}
        if kind == "image":
            return {"data": [digest.hex()]}
        if kind == "structured":
            return {"content": "```json\n" + json.dumps(example(parameters["schema"], digest)) + "\n```"}
        if kind == "code":
            return {"content": f"```{parameters.get('lang', '')}\nx = {digest[0]}\n```"}
        return {"content": f"echo: {prompt}", "reasoning": None}


def example(schema: dict, digest: bytes) -> Any:
    kind = schema.get("type")
    if "enum" in schema:
        return schema["enum"][digest[0] % len(schema["enum"])]
    if kind == "object":
        return {k: example(s, digest[i:] + digest[:i]) for i, (k, s) in enumerate(schema.get("properties", {}).items())}
    if kind == "array":
        return [example(schema.get("items", {}), digest)]
    return {"integer": digest[0], "number": digest[0] / 255, "boolean": digest[0] % 2 == 0}.get(kind, digest[:4].hex())


@dataclass
class Admission:
    """How many calls may run at once: cut by a quarter when the server is busy, one more after a run of successes."""

    most: int = 16
    factor: float = 0.75
    successes: int = 25
    cooldown: float = 2.0
    now: float = field(default=0.0)
    run: int = 0
    busy_until: float = 0.0

    def __post_init__(self) -> None:
        self.now, self.lock = self.now or float(self.most), threading.Lock()

    @property
    def limit(self) -> int:
        return max(1, int(self.now))

    def succeeded(self) -> None:
        with self.lock:
            self.run += 1
            if self.run >= self.successes:
                self.now, self.run = min(self.most, self.now + 1), 0

    def refused(self, at: float) -> None:
        with self.lock:
            self.now, self.run = max(1.0, self.now * self.factor), 0
            self.busy_until = at + self.cooldown

    def pause(self, at: float) -> float:
        """Seconds until the server may be asked again."""
        return max(0.0, self.busy_until - at)

    def enter(self) -> bool:
        return True

    def failed(self) -> None:
        pass


class SharedAdmission:
    """Admission by the run's gate, which all tasks share: each call takes a lease and gives it back."""

    def __init__(self, leases: Leases, most: int) -> None:
        self.leases, self.limit = leases, most  # threads that may wait for a lease

    def enter(self) -> bool:
        return self.leases.enter()

    def succeeded(self) -> None:
        self.leases.leave("ok")

    def refused(self, at: float) -> None:
        self.leases.leave("busy")

    def failed(self) -> None:
        self.leases.leave("failed")

    def pause(self, at: float) -> float:
        return 0.0


RETRIED = (502, 503, 504)
STOPPED = "stopped early"
UNRENDERED = "the prompt can't be rendered"


def call(client: Callable, kind: str, messages: list[dict], parameters: dict, admission: Admission | SharedAdmission, tries: int = 3, backoff: float = 2.0, longest: float = 60.0, sleep: Callable = time.sleep) -> dict:
    """One call with retries for passing faults; a busy server (429) lowers the limit and is asked again after a pause."""
    for attempt in range(tries + 1):
        if pause := admission.pause(time.monotonic()):
            sleep(pause)
        if not admission.enter():
            raise ModelError(STOPPED)
        try:
            out = client(kind, messages, parameters)
        except ModelError as e:
            if e.status == 429:
                admission.refused(time.monotonic())
                if attempt == tries:
                    raise
                continue
            admission.failed()
            if not (e.retry or e.status in RETRIED) or attempt == tries:
                raise
            sleep(min(longest, backoff**attempt))
        except BaseException:
            admission.failed()
            raise
        else:
            admission.succeeded()
            return out
    raise AssertionError


def converse(client: Callable, kind: str, messages: list[dict], parameters: dict, parse: Callable[[str], Any], corrections: int = 0, restarts: int = 0, admission: Admission | None = None, tools: dict[str, Callable] | None = None, budget: int = 5) -> tuple[Any, dict, list[dict]]:
    """Calls until the answer parses: what was wrong is told to the model, then the conversation starts over.

    ``tools`` are those that the model may ask for, within a budget of turns.
    """
    admission, fault = admission or Admission(), "no answer"
    for _ in range(restarts + 1):
        talk = list(messages)
        for _ in range(corrections + 1):
            ask = lambda k, m, p: call(client, kind, m, p, admission)
            talk = tool_turns(ask, talk, tools or {}, parameters, budget)
            answer = talk[-1].pop("answer")
            try:
                return parse(answer.get("content", "")), answer, talk
            except ValueError as e:
                fault = str(e)
                talk.append({"role": "user", "content": f"That answer can't be used: {fault}. Answer again in the form asked for."})
    raise ModelError(f"no usable answer: {fault}")


def scores_schema(scores: list[dict]) -> dict:
    """The JSON schema of judge answers: for each score one of its options, and the reasoning."""
    one = lambda s: {"type": "object", "properties": {"score": {"enum": list(s["options"])}, "reasoning": {"type": "string"}}, "required": ["score", "reasoning"]}
    return {"type": "object", "properties": {s["name"]: one(s) for s in scores}, "required": [s["name"] for s in scores]}


def fitted_score(value: Any, options: list) -> Any:
    """A judge's score as one of the options: 4.0 is 4, case doesn't count, and true is no number."""
    for o in options:
        if isinstance(value, bool) == isinstance(o, bool) and value == o:
            return o
    for o in options:
        if not isinstance(value, bool) and str(value).strip().lower() == str(o).strip().lower():
            return o
        if isinstance(o, int) and not isinstance(o, bool) and isinstance(value, str):
            try:
                if float(value) == o:
                    return o
            except ValueError:
                pass
    raise ValueError(f"{value!r} isn't one of {options}")


def parser(kind: str, schema: dict | None, scores: list[dict]) -> Callable[[str], Any]:
    def block(text: str, lang: str) -> str:
        found = re.findall(rf"```[ \t]*{lang}[^\n]*\n(.*?)```", text, re.S) or (re.findall(r"```[ \t]*json[^\n]*\n(.*)\Z", text, re.S) if lang == "json" else [])
        if not found:
            raise ValueError(f"there is no {lang} block")
        return found[-1].rstrip("\n")

    def structured(text: str) -> Any:
        try:
            raw = block(text, "json")
        except ValueError:
            raw = text
        try:
            value = json.loads(raw)
        except ValueError:
            begins = re.search(r"[{\[]", raw)
            if not begins:
                raise ValueError("it isn't JSON") from None
            value = json.loads(repair(raw[begins.start() :]))
        if kind == "llm-judge":
            for s in scores:
                if not isinstance(value.get(s["name"]), dict):
                    raise ValueError(f"the score {s['name']!r} is missing")
                value[s["name"]]["score"] = str(fitted_score(value[s["name"]].get("score"), list(s["options"])))
            return value
        value = pruned(value, schema or {})
        if not conforms(value, schema or {}):
            raise ValueError("it doesn't fit the schema")
        return value

    if kind in ("llm-structured", "llm-judge"):
        return structured
    if kind == "llm-code":
        return lambda text: block(text, r"\w*")
    return lambda text: text


def output_type(c: Any) -> T.DataType:
    if c.kind == "llm-structured":
        return struct_of(c.output_format)
    if c.kind == "llm-judge":
        inner = T.StructType([T.StructField("score", T.StringType()), T.StructField("reasoning", T.StringType())])
        return T.StructType([T.StructField(s["name"], inner) for s in c.scores])
    if c.kind == "embedding":
        return T.StructType([T.StructField("embeddings", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("num_embeddings", T.LongType()), T.StructField("dimension", T.LongType())])
    return T.ArrayType(T.StringType()) if c.kind == "image" else T.StringType()


def context_blocks(columns: list[str], kind: str) -> list[Column]:
    """Attachments as content blocks: an url as it is, anything else as base64 with its format by its first bytes."""
    return [context_block(F.col(c), kind) for c in columns]


def context_block(value: Column, kind: str) -> Column:
    url = value.rlike("^https?://")
    return F.struct(F.lit(kind).alias("type"), F.when(url, "url").otherwise("base64").alias("form"), F.when(~url, media_format(value)).alias("format"), value.alias("value"))


def attachments(schema: T.StructType, columns: list[str], kind: str) -> list[Column]:
    """Arrays of content blocks; a column of lists, as image columns are, gives a block for each element."""
    several = lambda c: isinstance(schema[c].dataType, T.ArrayType)
    return [F.coalesce(F.transform(F.col(c), lambda x: context_block(x, kind)), F.array()) if several(c) else F.array(context_block(F.col(c), kind)) for c in columns]


def with_image(block: dict, media: MediaStore | None) -> dict:
    """A content block whose value is the path of one of the dataset's images, with the image itself."""
    if media is None or block["form"] != "base64" or not block["value"].startswith(f"{IMAGES}/"):
        return block
    value, kind = media.load(block["value"])
    return block | {"value": value, "format": kind}


def media_format(base64: Column) -> Column:
    """The format of base64 data by its first bytes, which are fixed values of the formats."""
    head = F.hex(F.substring(F.try_to_binary(base64, F.lit("base64")), 1, 12))
    kinds = (("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("25504446", "pdf"), ("4F676753", "ogg"), ("494433", "mp3"), ("664C6143", "flac"))
    out = F.when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^52494646.{8}57415645"), "wav").when(head.rlike("^.{8}66747970"), "mp4")
    for start, name in kinds:
        out = out.when(F.startswith(head, F.lit(start)), name)
    return out


@dataclass(frozen=True)
class CallRules:
    """How a run calls models: calls at once over all tasks, and when it stops calling because too many of the last rows failed."""

    most_calls: int = 16
    stop_rate: float = 0.5
    stop_window: int = 10
    stop_early: bool = True
    tool_budget: int = 5


def stand_in(value: Any, kind: T.DataType) -> Any:
    """A skipped cell's value as one of the column's type; null where it can't be."""
    if value is None or isinstance(kind, T.StringType):
        return None if value is None else str(value)
    if isinstance(kind, T.StructType):
        return value if isinstance(value, dict) else None
    return value if not isinstance(kind, T.ArrayType) or isinstance(value, list) else None


def at_once(work: list[Callable[[], Any]], admission: Admission, pool: ThreadPoolExecutor, done: Callable[[int, Any], None]) -> None:
    """Runs the calls with as many in flight as the admission allows at each moment; ``done`` gets each result as it comes."""
    flying: dict[Future, int] = {}
    todo = deque(enumerate(work))
    while todo or flying:
        while todo and len(flying) < admission.limit:
            i, f = todo.popleft()
            flying[pool.submit(f)] = i
        for f in wait(flying, return_when=FIRST_COMPLETED).done:
            done(flying.pop(f), f.result())


def drawn_parameters(parameters: dict, seed: int, alias: str, row: Column) -> dict[str, Column]:
    """Those call parameters that are distributions (``{"uniform": [low, high]}``, ``{"values": [...], "weights": [...]}``) as columns,
    drawn by a row's id alone."""
    out = {}
    for name, p in parameters.items():
        if isinstance(p, dict) and ("uniform" in p or "values" in p):
            u = uniform(seed, f"{alias}|{name}", row)
            if "uniform" in p:
                low, high = map(float, p["uniform"])
                out[name] = F.lit(low) + F.lit(high - low) * u
            else:
                try:
                    out[name] = pick(u, p["values"], p.get("weights"))
                except SamplerError:
                    raise ValueError(f"the weights of {name!r} don't fit its values") from None
    return out


def generate_model_column(df: DataFrame, c: Any, client: Callable, seed: int = 0, rules: CallRules | None = None, defaults: dict | None = None, tools: dict[str, Callable] | None = None, off: str | None = None, instead: Any = None, gate: Address | None = None, media: MediaStore | None = None) -> DataFrame:
    """Adds the column, with its trace, its reasoning and its usage where asked for, by one call for each row.

    Rows for which the column ``off`` is true aren't asked for and get ``instead``. Rows whose call failed for good are marked
    in ``_drop_reason`` where there is such a column, else left out. ``params["context"]`` names columns of attachments by kind,
    ``params["tools"]`` the tools that the model may ask for. All tasks share the limit of ``gate``; without one each task has a limit
    of its own. With ``media`` images become files there and cells hold their paths; a call whose answer is no image failed.
    """
    rules, instead = rules or CallRules(), stand_in(instead, output_type(c))
    compiler = Compiler(df.schema, seed, F.col("_row_id") if "_row_id" in df.columns else None)
    if c.kind == "embedding":
        target = df.schema[c.target_columns[0]].dataType
        texts = F.col(c.target_columns[0]) if isinstance(target, T.ArrayType) else F.array(F.col(c.target_columns[0]).cast("string"))
        prompt = F.to_json(texts)
    else:
        prompt = compiler.render(c.prompt)
    system = compiler.render(c.system_prompt) if c.system_prompt else F.lit(None).cast("string")
    blocks = [b for kind, columns in (c.params.get("context") or {}).items() for b in attachments(df.schema, columns, kind)]
    context = F.to_json(F.filter(F.concat(*blocks), lambda b: b["value"].isNotNull())) if blocks else F.lit(None).cast("string")
    trace, reasoning, usage = f"{c.name}__trace", f"{c.name}__reasoning_content", f"{c.name}__usage"
    marks = "_drop_reason" in df.columns
    fields = [*df.schema.fields, T.StructField(c.name, output_type(c))]
    fields += [T.StructField(n, T.StringType()) for n in (trace, reasoning, usage) if n in c.side_effects]
    schema, names = T.StructType([*fields, T.StructField("_failed", T.StringType())]), df.columns
    kind = {"llm-text": "text", "llm-code": "code", "llm-structured": "structured", "llm-judge": "structured", "embedding": "embedding", "image": "image"}[c.kind]
    form = scores_schema(c.scores) if c.kind == "llm-judge" else c.output_format
    own = {k: v for k, v in c.params.items() if k not in ("context", "tools", "max_correction_steps", "max_conversation_restarts")}
    parameters = (defaults or {}) | own | ({"schema": form} if form else {}) | ({"lang": c.code_lang} if c.code_lang else {})
    held = {n: (tools or {})[n] for n in c.params.get("tools", [])}
    corrections, restarts = (int(c.params.get(k, 0)) for k in ("max_correction_steps", "max_conversation_restarts"))
    parse, alias = parser(c.kind, form, c.scores), c.model_alias

    def one(p: str | None, s: str | None, attached: str | None, drawn: str, admission: Admission | SharedAdmission) -> tuple[Any, str | None, str | None, str | None, str | None]:
        """Value, trace, reasoning, usage and fault."""
        try:
            content = [{"type": "text", "text": p}, *(with_image(b, media) for b in json.loads(attached))] if attached and attached != "[]" else p
            messages = ([{"role": "system", "content": s}] if s else []) + [{"role": "user", "content": content}]
            if p is None:
                raise ModelError(UNRENDERED)
            told = parameters | json.loads(drawn)
            if kind in ("embedding", "image"):
                answer = call(client, kind, messages, told, admission)
                data = answer["data"]
                value = {"embeddings": data, "num_embeddings": len(data), "dimension": len(data[0]) if data else 0} if kind == "embedding" else [media.save(x, c.name) for x in data] if media else data
                return value, None, None, json.dumps(answer.get("usage")), None
            value, answer, talk = converse(client, kind, messages, told, parse, corrections, restarts, admission, held, rules.tool_budget)
            return value, json.dumps(talk), answer.get("reasoning"), json.dumps(answer.get("usage")), None
        except (ModelError, MediaError) as e:
            return None, None, None, None, str(e) or "failed"

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        leases = Leases(gate) if gate is not None else None
        admission = SharedAdmission(leases, rules.most_calls) if leases else Admission(rules.most_calls)
        stop, stopped = EarlyStop(rules.stop_rate, rules.stop_window), False
        with ThreadPoolExecutor(rules.most_calls) as pool, closing(leases) if leases else nullcontext():
            for frame in frames:
                skipped = frame[off].to_numpy(bool) if off else [False] * len(frame)
                got: list[tuple] = [(instead, None, None, None, None)] * len(frame)
                asked = [i for i in range(len(frame)) if not skipped[i]]

                def done(k: int, result: tuple, asked: list[int] = asked, got: list[tuple] = got) -> None:
                    nonlocal stopped
                    got[asked[k]] = result
                    if result[4] == STOPPED:
                        stopped = True
                    elif result[4] != UNRENDERED and leases:
                        leases.told(result[4] is not None)
                    elif result[4] != UNRENDERED:
                        stopped = stop.add(result[4] is not None) or stopped

                def ask(i: int, frame: Any = frame) -> tuple:
                    if stopped and rules.stop_early:
                        return None, None, None, None, STOPPED
                    return one(*(frame[x].iat[i] for x in ("_prompt", "_system", "_context", "_drawn")), admission)

                at_once([lambda i=i: ask(i) for i in asked], admission, pool, done)
                out = frame[names].copy()
                for n, at in ((c.name, 0), (trace, 1), (reasoning, 2), (usage, 3), ("_failed", 4)):
                    if n in schema.names:
                        out[n] = [g[at] for g in got]
                yield out[[f.name for f in schema.fields]]

    drawn = drawn_parameters(parameters, seed, str(alias), F.col("_row_id") if "_row_id" in df.columns else F.monotonically_increasing_id())
    told = F.to_json(F.struct(*(x.alias(n) for n, x in drawn.items()))) if drawn else F.lit("{}")
    made = df.withColumns({"_prompt": prompt, "_system": system, "_context": context, "_drawn": told}).mapInPandas(run, schema)
    if not marks:
        return made.where(F.col("_failed").isNull()).drop("_failed")
    why = F.when(F.col("_failed") == STOPPED, f"{c.name}:stopped").when(F.col("_failed").isNotNull(), f"{c.name}:model")
    return made.withColumn("_drop_reason", F.coalesce("_drop_reason", why)).drop("_failed")


class EarlyStop:
    """Tells when too many of the last calls failed."""

    def __init__(self, rate: float = 0.5, window: int = 10) -> None:
        self.rate, self.last = rate, deque(maxlen=window)

    def add(self, failed: bool) -> bool:
        self.last.append(failed)
        return len(self.last) == self.last.maxlen and sum(self.last) / len(self.last) >= self.rate


def tool_turns(client: Callable, messages: list[dict], tools: dict[str, Callable], parameters: dict, budget: int = 5) -> list[dict]:
    """Runs allowed tools that the model asks for, up to a budget of turns; then refuses, and the model must answer.

    The last message is the model's answer; it holds the client's whole answer as ``answer``.
    """
    talk = list(messages)
    for turn in range(budget + 1):
        answer = client("text", talk, parameters)
        calls = answer.get("tool_calls") or []
        talk.append({"role": "assistant", "content": answer.get("content", "")} | ({"tool_calls": calls} if calls else {}))
        if not calls or turn == budget and not tools:
            break
        for t in calls:
            said = "no more tool calls are allowed" if turn >= budget else tools[t["name"]](**t.get("arguments", {})) if t["name"] in tools else f"the tool {t['name']!r} isn't allowed"
            talk.append({"role": "tool", "tool_call_id": t.get("id"), "content": str(said)})
    if talk[-1]["role"] == "tool":
        answer = client("text", talk, parameters)
        talk.append({"role": "assistant", "content": answer.get("content", "")})
    talk[-1]["answer"] = answer
    return talk


def usage_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Calls and tokens of model columns by their ``__usage`` side effects: column, calls, input_tokens, output_tokens."""
    counts = "input_tokens long, output_tokens long"
    told = [F.struct(F.lit(c).alias("column"), F.from_json(f"{c}__usage", counts).alias("u")) for c in columns]
    rows = df.select(F.explode(F.array(*told)).alias("x")).where("x.u is not null")
    return rows.groupBy(F.col("x.column").alias("column")).agg(F.count(F.lit(1)).alias("calls"), F.sum("x.u.input_tokens").alias("input_tokens"), F.sum("x.u.output_tokens").alias("output_tokens"))


def health_check(clients: dict[str, Callable]) -> dict[str, str | None]:
    """Asks each client once; the fault of those that fail."""
    out: dict[str, str | None] = {}
    for alias, client in clients.items():
        try:
            client("text", [{"role": "user", "content": "ping"}], {})
            out[alias] = None
        except Exception as e:  # any fault means that the model isn't ready
            out[alias] = str(e)
    return out


def approximate_tokens(text: Column) -> Column:
    """A count of tokens without a vocabulary: words, and for long words one more for each four characters past six."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_\\x09-\\x0D ]"), F.lit(0))
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + 1 + F.greatest(F.lit(0), F.ceil((F.length(w) - 6) / F.lit(4.0))).cast("long"))


__all__ = ["Admission", "CallRules", "EarlyStop", "EchoClient", "ModelError", "approximate_tokens", "code_block", "context_blocks", "generate_model_column", "health_check", "math", "media_format", "tool_turns"]

"""Validation columns, and extraction of code and JSON from generated text."""

from __future__ import annotations

import ast
import functools
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.draws import bound
from weftline.functions.jsonrepair import repaired

FENCE = "(?s)```[ \\t]*{lang}[^\\n]*\\n(.*?)```"


def code_block(text: Column, lang: str = "\\w*") -> Column:
    """The last fenced block in the language, without its fences; null if there is none."""
    return F.try_element_at(F.transform(F.regexp_extract_all(text, F.lit(FENCE.format(lang=lang)), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "\\n$", ""))), F.lit(-1))


def json_block(text: Column, schema: T.StructType | str | None = None) -> Column:
    """The last ``json`` block, one that breaks off, or the text from its first bracket on, repaired where it isn't JSON (see
    ``functions.jsonrepair``). Null if there is none."""
    cut = F.nullif(F.regexp_extract(text, "(?s)```[ \\t]*json[^\\n]*\\n(?!.*```)(.*)$", 1), F.lit(""))
    found = F.coalesce(code_block(text, "json"), cut, text)
    raw = F.nullif(F.regexp_extract(found, "(?s)([{\\[].*)$", 1), F.lit(""))
    clean = bound(raw, lambda x: F.when(F.try_parse_json(x).isNotNull(), x).otherwise(repaired(x)))
    return F.from_json(clean, schema) if schema is not None else F.when(F.try_parse_json(clean).isNotNull(), clean)


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_list(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> list | None:
        if x is None:
            return None
        try:
            got = ast.literal_eval(x)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            got = None
        return [str(v) for v in got] if isinstance(got, (list, tuple)) else [x]

    return text.map(one)


def list_of_text(text: Column) -> Column:
    """A list from text: JSON, JSON with trailing commas, a Python literal, or else the text as the only element. Only text that
    looks like a list and isn't JSON goes through Python."""
    clean = F.trim(text)
    repaired = F.regexp_replace(clean, ",\\s*\\]$", "]")
    shaped = clean.rlike(r"(?s)^[\[(].*[\])]$")
    parsed = F.from_json(F.when(F.try_parse_json(repaired).isNotNull(), repaired), "array<string>")
    odd = F.when(shaped & F.try_parse_json(repaired).isNull(), clean)
    return F.when(text.isNull(), None).when(~shaped, F.array(clean)).otherwise(F.coalesce(parsed, python_list(odd)))


def sql_valid(code: Column) -> Column:
    """struct(is_valid, error): no DECIMAL with a precision and no scale, closed quotes and brackets, and a statement's first word."""
    bare = F.regexp_replace(F.regexp_replace(code, "'(?:[^']|'')*'", "''"), "(?s)--[^\\n]*|/\\*.*?\\*/", "")
    decimal = bare.rlike("(?i)\\b(decimal|numeric)\\s*\\(\\s*\\d+\\s*\\)")
    quotes = F.length(F.regexp_replace(bare, "[^']", "")) % 2 == 1
    brackets = F.length(F.regexp_replace(bare, "[^(]", "")) != F.length(F.regexp_replace(bare, "[^)]", ""))
    first = ~bare.rlike("(?i)^\\s*\\(?\\s*(select|with|insert|update|delete|create|alter|drop|merge|truncate|grant|revoke|explain|values|set|use|show|describe|begin|commit|rollback|replace)\\b")
    error = F.when(code.isNull(), "no code").when(decimal, "DECIMAL needs a scale").when(quotes, "a quote isn't closed").when(brackets, "a bracket isn't closed").when(first, "no statement")
    return F.struct(error.isNull().alias("is_valid"), error.alias("error"))


PYTHON_RESULT = T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("severity", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])


def python_verdict(code: str | None) -> tuple[bool, str, float, str | None]:
    """Syntax errors are fatal (score 0); bare excepts, wildcard imports and tabs for indentation count as warnings."""
    if code is None:
        return False, "fatal", 0.0, "no code"
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return False, "fatal", 0.0, type(e).__name__
    statements = sum(isinstance(n, ast.stmt) for n in ast.walk(tree))
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name)]
    warnings = sum(isinstance(n, ast.ExceptHandler) and n.type is None for n in ast.walk(tree))
    warnings += sum(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in ast.walk(tree))
    conventions = sum(len(line) > 100 for line in code.split("\n")) + sum(n.id in ("l", "O", "I") for n in names)
    score = max(0.0, 10 - 10 * (warnings + conventions) / max(statements, 1))
    return True, "warning" if warnings else "convention" if conventions else "none", score, None


@F.pandas_udf(PYTHON_RESULT)
def python_valid(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([python_verdict(x) for x in code], columns=PYTHON_RESULT.names)


def validate_code(df: DataFrame, name: str, targets: list[str], lang: str, off: str | None = None) -> DataFrame:
    """One struct with is_valid for a single target; with several, a struct of one for each, every one judged on its own rows.

    Rows for which the column ``off`` is true get null.
    """
    if lang != "python" and not lang.startswith("sql"):
        raise ValueError(f"code in {lang!r} isn't validated")
    judge: Callable[[Column], Column] = (lambda c: python_valid(c)) if lang == "python" else sql_valid
    judged = [judge(F.col(t) if off is None else F.when(~F.col(off), F.col(t))) for t in targets]
    one = judged[0] if len(targets) == 1 else F.struct(*(j.alias(t) for j, t in zip(judged, targets, strict=True)))
    return df.withColumn(name, one if off is None else F.when(~F.col(off), one))


def validate_local(df: DataFrame, name: str, targets: list[str], function: Callable, schema: str = "is_valid boolean", off: str | None = None) -> DataFrame:
    """``function`` takes and returns pandas frames of the targets; the result must have ``is_valid`` and as many rows.

    It isn't given the rows for which the column ``off`` is true; they get null.
    """
    names, fields = df.columns, T._parse_datatype_string(schema)
    out = T.StructType([*df.schema.fields, T.StructField(name, fields)])

    def run(frames: Iterator[Any]) -> Iterator[Any]:
        for frame in frames:
            seen = ~frame[off].to_numpy(bool) if off else [True] * len(frame)
            values: list = [None] * len(frame)
            if any(seen):
                got = function(frame.loc[seen, targets].reset_index(drop=True))
                if "is_valid" not in got or len(got) != sum(seen):
                    raise ValueError("a validator must return is_valid for every row")
                if missing := [n for n in fields.names if n not in got]:
                    raise ValueError(f"a validator's result lacks {', '.join(missing)}")
                made = got[fields.names].astype(object)
                made = iter(made.where(made.notna(), None).to_dict("records"))
                values = [next(made) if s else None for s in seen]
            yield frame[names].assign(**{name: pd.Series(values, index=frame.index, dtype=object)})

    return df.mapInPandas(run, out)


@dataclass(frozen=True)
class RemoteRules:
    """How batches are posted: seconds to wait, further tries after a failure, the factor of the pause between them, and batches at once."""

    timeout: float = 30.0
    retries: int = 3
    backoff: float = 2.0
    parallel: int = 4


def http_post(url: str, body: dict, timeout: float = 30.0) -> list[dict] | None:
    """Posts JSON and reads a list of results, or an object that holds it as ``data``."""
    request = urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        got = json.loads(answer.read())
    return got.get("data") if isinstance(got, dict) else got


def validate_remote(df: DataFrame, name: str, targets: list[str], url: str, post: Callable[[str, dict], list[dict] | None] | None, batch: int = 10, rules: RemoteRules | None = None, off: str | None = None, sleep: Callable = time.sleep) -> DataFrame:
    """Posts batches ``{"data": [...]}`` by ``post(url, body)`` (``http_post`` if none is given), several at once; a batch that keeps
    failing (an error, null, or another number of results) has is_valid null."""
    rules = rules or RemoteRules()
    post = post or functools.partial(http_post, timeout=rules.timeout)

    def sent(some: list[dict]) -> list[dict]:
        for attempt in range(rules.retries + 1):
            try:
                got = post(url, {"data": some})
            except Exception:  # any fault of the service; the batch is asked again, and then told as not judged
                got = None
            if got is not None and len(got) == len(some):
                return [{"is_valid": g.get("is_valid")} for g in got]
            if attempt < rules.retries:
                sleep(rules.backoff**attempt)
        return [{"is_valid": None}] * len(some)

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        batches = [frame.iloc[at : at + batch].to_dict("records") for at in range(0, len(frame), batch)]
        with ThreadPoolExecutor(max(1, rules.parallel)) as pool:
            return pd.DataFrame([g for got in pool.map(sent, batches) for g in got], columns=["is_valid"])

    return validate_local(df, name, targets, judged, off=off)


# ---- JSON schemas


def resolved(schema: Any, root: Any) -> Any:
    """What a local ``$ref`` (``#/$defs/name``) stands for; keywords beside the reference count too."""
    seen: set[str] = set()
    while isinstance(schema, dict) and isinstance(at := schema.get("$ref"), str):
        if not at.startswith("#") or at in seen:
            raise ValueError(f"the reference {at!r} can't be resolved")
        seen.add(at)
        found = root
        for step in filter(None, at[1:].split("/")):
            found = found[step.replace("~1", "/").replace("~0", "~")]
        rest = {k: v for k, v in schema.items() if k != "$ref"}
        schema = found | rest if isinstance(found, dict) else found
    return schema


def same(a: Any, b: Any) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


JSON_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def conforms(value: Any, schema: Any, root: Any = None) -> bool:
    """Whether a value fits a JSON schema: references, types, allOf, anyOf, oneOf, not, enum, const, and the bounds of each type."""
    root = schema if root is None else root
    schema = resolved(schema, root)
    if isinstance(schema, bool):
        return schema
    fits = lambda s, v=value: conforms(v, s, root)
    if not all(map(fits, schema.get("allOf", []))) or "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        return False
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1 or "not" in schema and fits(schema["not"]):
        return False
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]) or "const" in schema and not same(value, schema["const"]):
        return False
    kinds = schema.get("type")
    if kinds is not None and not any(of_kind(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if isinstance(value, bool):
        return True
    if isinstance(value, (int, float)):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            return False
        if value <= schema.get("exclusiveMinimum", value - 1) or value >= schema.get("exclusiveMaximum", value + 1):
            return False
        return "multipleOf" not in schema or abs(value / schema["multipleOf"] - round(value / schema["multipleOf"])) < 1e-9
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if schema.get("uniqueItems") and any(same(a, b) for i, a in enumerate(value) for b in value[:i]):
            return False
        first = schema.get("prefixItems", [])
        return all(fits(s, v) for s, v in zip(first, value, strict=False)) and all(fits(schema.get("items", True), v) for v in value[len(first) :])
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", [])) or not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return False
        return all(fits(known[k] if k in known else other, v) for k, v in value.items())
    return True


def of_kind(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or value == int(value))
    return isinstance(value, JSON_KINDS[kind])


def pruned(value: Any, schema: Any, root: Any = None) -> Any:
    """The value without properties that the schema doesn't name; of alternatives, the one that the value fits once pruned, by its
    discriminator where there is one."""
    root = schema if root is None else root
    schema = resolved(schema, root)
    if isinstance(schema, bool):
        return value
    if choices := schema.get("anyOf") or schema.get("oneOf"):
        by = (schema.get("discriminator") or {}).get("propertyName")
        for s in choices:
            told = resolved(s, root)
            if by and isinstance(value, dict):
                tag = told.get("properties", {}).get(by, {})
                if not conforms(value.get(by), tag, root):
                    continue
            got = pruned(value, told, root)
            if conforms(got, told, root):
                return got
        return value
    if isinstance(value, dict) and "properties" in schema:
        return {k: pruned(v, schema["properties"][k], root) for k, v in value.items() if k in schema["properties"]}
    return [pruned(v, schema.get("items", True), root) for v in value] if isinstance(value, list) else value


def struct_of(schema: dict, root: dict | None = None) -> T.DataType:
    """The Spark type of a JSON schema; alternatives, and what has no type, are text (null beside one type leaves that type)."""
    root = schema if root is None else root
    schema = resolved(schema, root)
    if choices := [s for s in schema.get("anyOf", []) if s.get("type") != "null"]:
        return struct_of(choices[0], root) if len(choices) == 1 else T.StringType()
    kind = schema.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), None) if len([k for k in kind if k != "null"]) == 1 else None
    if kind == "object" and schema.get("properties"):
        return T.StructType([T.StructField(k, struct_of(s, root)) for k, s in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(struct_of(schema.get("items", {}), root))
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())

"""Repair of JSON as models write it: a fold over its tokens with a stack of open brackets.

Texts that break off are closed, and so are texts, lists and objects within them; names
and texts may stand in single quotes or in none; commas, colons and closing brackets that
are missing are put in and those too many left out; True, False and None are taken as
JSON's words; a name without a value has null. What follows a whole value is left out.

``repaired`` is one native expression, an ``aggregate`` over the tokens that a regular
expression finds; ``repair`` is the same fold for a text in a worker's hands. Text that
parses as it is isn't touched by callers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A text ends at its mark after an even number of backslashes; one that breaks off goes to the end. No group here is repeated with
# choices inside, which Java's matcher would recurse into.
DOUBLE = r'"[\s\S]*?(?<!\\)(?:\\\\)*+"'
SINGLE = r"'[\s\S]*?(?<!\\)(?:\\\\)*+'"
WORD = r"[^\s{}\[\],:\"'](?:[^{}\[\],:\"'\r\n]*[^\s{}\[\],:\"'])?"
TOKENS = rf"{DOUBLE}|{SINGLE}|[\"'][\s\S]*+|[{{}}\[\],:]|{WORD}"
UNITS = r"""[^\\"]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\'|[\\"]"""
DANGLING = r"(?<!\\)((?:\\\\)*+)\\$"
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
FILLS = {"k": ":null", "c": "null"}  # what a name lacks, and what a colon


# ---- the fold over columns


def quoted(t: Column) -> Column:
    """A text or bare word as a JSON string."""
    whole = F.substring(t, F.lit(2), F.length(t) - 2)
    broken = F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), DANGLING, "$1")
    inner = F.when(t.rlike(f"^(?:{DOUBLE}|{SINGLE})$"), whole).when(t.rlike("^[\"']"), broken).otherwise(F.replace(t, F.lit("\\"), F.lit("\\\\")))
    unit = lambda x: F.when(x == "\\'", "'").when(x == "\\", "\\\\").when(x == '"', '\\"').otherwise(x)
    out = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(UNITS), F.lit(0)), unit), "")
    for old, new in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), out, F.lit('"'))


def value(t: Column) -> Column:
    low = F.lower(t)
    return F.when(low.isin("true", "false", "null"), low).when(low == "none", "null").when(t.rlike(NUMBER), t).otherwise(quoted(t))


def closers(open_: Column) -> Column:
    return F.translate(F.reverse(open_), "{[", "}]")


def step(s: Column, t: Column) -> Column:
    out, stack, prev = s["out"], s["stack"], s["prev"]
    state = lambda o, k, p: F.struct(o.alias("out"), k.alias("stack"), (F.lit(p) if isinstance(p, str) else p).alias("prev"))
    same = state(out, stack, prev)
    within = F.right(stack, F.lit(1)) == "{"
    fill = F.when(prev == "k", ":null").when(prev == "c", "null").otherwise("")
    comma = F.when(prev.isin(",", "v"), ",").otherwise("")
    opened = F.when(within & prev.isin("o", ",", "v"), same).otherwise(state(F.concat(out, F.when(prev == "k", ":").otherwise(F.when(within, "").otherwise(comma)), t), F.concat(stack, t), "o"))
    want = F.translate(t, "}]", "{[")
    at = F.length(stack) - F.call_function("instr", F.reverse(stack), want)  # brackets before the one that closes
    closed = F.when(F.contains(stack, want), state(F.concat(out, fill, closers(F.substring(stack, at + 1, F.length(stack)))), F.left(stack, at), "v")).otherwise(same)
    parted = F.when(prev.isin("o", ","), same).otherwise(state(F.concat(out, fill), stack, ","))
    told = F.when(prev == "k", state(F.concat(out, F.lit(":")), stack, "c")).otherwise(same)
    named = state(F.concat(out, comma, quoted(t)), stack, "k")
    held = F.when(within & prev.isin("o", ",", "v"), named).otherwise(state(F.concat(out, F.when(prev == "k", ":").otherwise(F.when(within, "").otherwise(comma)), value(t)), stack, "v"))
    return F.when((stack == "") & (out != ""), same).when(t.isin("{", "["), opened).when(t.isin("}", "]"), closed).when(t == ",", parted).when(t == ":", told).otherwise(held)


def repaired(text: Column) -> Column:
    """The value that a text begins with, as JSON; null where it holds nothing."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("stack"), F.lit("o").alias("prev"))
    fill = lambda s: F.when(s["prev"] == "k", ":null").when(s["prev"] == "c", "null").otherwise("")
    return F.nullif(F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), start, step, lambda s: F.concat(s["out"], fill(s), closers(s["stack"]))), F.lit(""))


# ---- the same over a text


def _quoted(t: str) -> str:
    if re.fullmatch(f"{DOUBLE}|{SINGLE}", t):
        inner = t[1:-1]
    elif t[0] in "\"'":
        inner = re.sub(DANGLING, r"\1", t[1:])
    else:
        inner = t.replace("\\", "\\\\")
    out = "".join({"\\'": "'", "\\": "\\\\", '"': '\\"'}.get(x, x) for x in re.findall(UNITS, inner))
    return '"' + out.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _value(t: str) -> str:
    low = t.lower()
    return low if low in ("true", "false", "null") else "null" if low == "none" else t if re.search(NUMBER, t) else _quoted(t)


def repair(text: str) -> str | None:
    """As ``repaired``."""
    out, stack, prev = [], [], "o"
    close = {"{": "}", "[": "]"}
    for t in re.findall(TOKENS, text):
        if not stack and out:
            break
        within = bool(stack) and stack[-1] == "{"
        lead = ":" if prev == "k" else "" if within or prev not in ",v" else ","
        if t in "{[":
            if not (within and prev in "o,v"):
                out += [lead, t]
                stack.append(t)
                prev = "o"
        elif t in "}]":
            if (want := "{" if t == "}" else "[") in stack:
                out.append(FILLS.get(prev, ""))
                while True:
                    last = stack.pop()
                    out.append(close[last])
                    if last == want:
                        break
                prev = "v"
        elif t == ",":
            if prev not in "o,":
                out.append(FILLS.get(prev, ""))
                prev = ","
        elif t == ":":
            if prev == "k":
                out.append(":")
                prev = "c"
        elif within and prev in "o,v":
            out += ["" if prev == "o" else ",", _quoted(t)]
            prev = "k"
        else:
            out += [lead, _value(t)]
            prev = "v"
    return "".join([*out, FILLS.get(prev, ""), *(close[b] for b in reversed(stack))]) or None

"""Secret scan: fixed patterns, and assignments read as name-literal pairs.

The base kinds are patterns over the whole text. Beside them the text is lexed
as source code or configuration: it is cut into names, operators, quoted
literals and bare words; assignments in the usual spellings (``name = "x"``,
``"name": "x"``, ``name: x``, ``NAME=x``, ``name => "x"``, ``<name>x</name>``,
``setName("x")``) give name-literal pairs, also where the value lies on a later
line or takes several (triple quotes, block scalars); a name assigned to a sensitive
name (``x``, ``$x``, ``${x}``) passes its literals on, quoted or not; and each literal is scored by what its target's name
says and what the literal looks like. Literals that score high enough are added
as spans of kind ``literal``, unless a base span covers them; of several lines each
is judged by itself. So are the lines of PEM private keys.

Nulls and empty texts have no spans. The whole text is read. Rows that repeat give repeated rows. Only the key and the text are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_slices, texts


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    value: int  # where the secret itself begins


KINDS = ("assign", "access", "hex", "literal")
SLICE_BYTES = 16 << 20


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"({'|'.join(map(_either_case, ASSIGN_WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # the same runs as [0-9a-f]+ of 32 or more
LEAST = {"assign": 8, "access": 16}

# Words of sensitive target names and their scores.
NAME_SCORES = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5,
    "credential": 2.5, "credentials": 2.5, "cred": 2.0, "apikey": 3.0, "auth": 1.5, "bearer": 2.5, "private": 1.5,
    "access": 1.0, "api": 1.0, "key": 1.0, "signing": 1.0, "encryption": 1.0, "session": 0.5, "client": 0.5,
}
HINTS = ("pass", "pwd", "secret", "token", "cred", "key", "auth", "bearer")
# Literals that stand for a secret without being one.
STAND_INS = {"changeme", "password", "passwd", "secret", "example", "placeholder", "redacted", "undefined", "required", "optional", "none", "null", "true", "false", "todo", "string", "your_password", "your_token", "username"}
NAME = r"[A-Za-z_$][A-Za-z0-9_$.\-]*+"
TRIPLE = r"\"\"\"(?s:.*?)\"\"\"|'{3}(?s:.*?)'{3}"
LITERAL = rf"{TRIPLE}|\"(?:[^\"\\\n]|\\(?s:.))*+\"|'(?:[^'\\\n]|\\(?s:.))*+'|`[^`]*+`"
BRACED = r"\$\{[^{}\s\"'`]+\}"
BARE = r"[^\s\"'`,;<>()\[\]{}]+"
ELEMENT = rf"(?:{LITERAL}|{BRACED}|{NAME})"
MORE = rf"(?:[ \t]*(?:\r?\n[ \t]*)?[+.][ \t]*(?:\r?\n[ \t]*)?{ELEMENT})*+"
PAIR = re.compile(
    # A run of name characters is read once, from its first letter on, whatever its length.
    rf"(?<![A-Za-z0-9_$.\-])[0-9.\-]*+(?P<name>{NAME})[\"']?\]?[ \t]*(?::=|=>|==?|:)"
    rf"(?:(?P<block>[ \t]*[|>][+\-0-9]*[ \t\r]*(?=\n))|[ \t]*(?P<value>{ELEMENT}{MORE}|{BARE})|[ \t]*\r?\n\s*(?P<later>(?:{LITERAL}){MORE})(?![ \t]*[:=])"
    rf"|[ \t]*\r?\n[ \t]+(?P<below>{BARE})(?<!:)(?=[ \t\r]*(?:\n|\Z)))"
    rf"|<(?P<tag>{NAME})>(?P<inner>[^<>]++)</(?P=tag)>"
    rf"|\b(?:set|with|put|add)_?(?P<setter>[A-Za-z_]{{3,}}+)\(\s*(?P<argument>{LITERAL})"
)
PART = re.compile(rf"(?P<quoted>{LITERAL})|(?P<ref>{BRACED}|{NAME})")
INNER = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.\-]*)|([A-Za-z_][A-Za-z0-9_]*))")  # names within a literal
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----([^-]++)-----END")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
LEAST_SCORE = 4.0


def name_score(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    score = sum({w: NAME_SCORES.get(w, 0.0) for w in words}.values())
    joined = "".join(words)
    return max(score, 3.0 if "apikey" in joined or "accesskey" in joined or "privatekey" in joined else 0.0)


def literal_score(text: str, quoted: bool) -> float:
    """How much a literal looks like a secret: its length, mix of characters and entropy; stand-ins score far below 0."""
    plain = text.strip()
    if len(plain) < 6 or plain.lower() in STAND_INS or len(set(plain)) < 4 or re.search(r"\$\{|\{\{|%\(|^<.*>$|[\s]", plain):
        return -9.0
    kinds = sum(bool(re.search(p, plain)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    counts = Counter(plain)
    entropy = -sum(n / len(plain) * math.log2(n / len(plain)) for n in counts.values())
    score = min(len(plain), 24) / 24 + 0.5 * (kinds - 1) + max(0.0, entropy - 2.0) / 2
    if not re.search("[0-9]", plain):
        score -= 0.5
    return score - (0.0 if quoted else 0.5 if kinds > 1 else 9.0)


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, leftmost and non-overlapping within each kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):
        out += [Span(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [Span(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [Span(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def block_end(text: str, start: int, at: int) -> int:
    """Where the lines after ``at`` that are blank or indented more than the line of ``start`` end."""
    first = text.rfind("\n", 0, start) + 1
    deep = len(text[first:start]) - len(text[first:start].lstrip(" \t"))
    return re.compile(rf"(?:\n(?:[ \t]{{{deep + 1},}}[^\n]*|[ \t\r]*(?=\n)))*").match(text, at).end()


def inner_names(text: str) -> list[str]:
    return [a or b for a, b in INNER.findall(text)] if "$" in text else []


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]], list[str]]]:
    """Name, the literals on the right (start, end, quoted) and the names on the right, for each assignment.
    What is within a value that takes several lines, or lies on a later line than its name, is lexed too."""
    at = 0
    while m := PAIR.search(text, at):
        at, name = m.end(), m["name"] or m["tag"] or m["setter"]
        group = next(g for g in ("value", "later", "below", "block", "inner", "argument") if m[g] is not None)
        held, base = m[group], m.start(group)
        if group == "block":
            yield name, [(at, block_end(text, m.start(), at), True)], []
            continue
        if group in ("later", "below") or "\n" in held:
            at = base + (group != "below" and held[0] in "\"'`<")
        if group == "inner":
            yield name, [(base, base + len(held), True)], inner_names(held)
            continue
        if held[0] not in "\"'`" and not held.startswith("${") and not re.fullmatch(rf"{NAME}(?:\s*[+.].*)?", held, re.DOTALL):
            yield name, [(base, base + len(held), False)], inner_names(held)
            continue
        literals, refs = [], []
        for p in PART.finditer(held):
            if p["quoted"]:
                marks = 3 if re.match(TRIPLE, p["quoted"]) else 1
                literals.append((base + p.start() + marks, base + p.end() - marks, True))
                refs += inner_names(p["quoted"])
            else:
                refs += inner_names(p["ref"]) or [p["ref"]]
        if not literals and len(refs) == 1 and not held.startswith("${") and PART.fullmatch(held.strip()):
            literals = [(base, base + len(held), False)]
        yield name, literals, refs


def lines_of(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The literal itself, or of one that takes several lines each line that isn't blank, without space around it."""
    if "\n" not in text[start:end]:
        yield start, end
        return
    for m in re.finditer(r"\S(?:[^\n]*\S)?", text[start:end]):
        yield start + m.start(), start + m.end()


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names, and the lines of private keys.

    A name stands for what was assigned to it last; one that wasn't assigned yet, for what the text assigns to it in the end.
    """
    lower = text.lower()
    if not any(h in lower for h in HINTS) or not any(c in text for c in ("=", ":", "<", "(", "-----BEGIN")):
        return []
    known: dict[str, int] = {}
    # Literals of a constant, the constants it is made of, and names in it that weren't known yet.
    nodes: list[tuple[list[tuple[int, int, bool]], list[int], list[str]]] = []
    targets: list[tuple[float, list[int], list[str]]] = []
    told: dict[int, float] = {}  # the highest score by which a constant's literals were judged
    found = {x for m in PEM.finditer(text) for x in lines_of(text, *m.span(1)) if literal_score(text[x[0] : x[1]], True) > 0}
    for name, literals, refs in pairs(text):
        names = [r.lstrip("$") for r in refs]
        through, missing = list({known[r] for r in names if r in known}), [r for r in names if r not in known and r != name.lstrip("$")]
        own = [x for x in literals if x[2]] if through else [x for x in literals if x[2]] or literals
        if through or own:
            name_ = name.lstrip("$")
            bare = not through and not any(x[2] for x in own) and name_ in known  # an unquoted word doesn't displace what is known
            nodes.append((own, [known[name_]] if bare else list(through), missing))
            known[name_] = len(nodes) - 1
        score = name_score(name)
        if score >= 2.0:
            targets.append((score, list(through), missing))
            while True:
                for start, end, quoted in own:
                    found.update(x for x in lines_of(text, start, end) if score + literal_score(text[x[0] : x[1]], quoted) >= LEAST_SCORE)
                while through and told.get(through[-1], 0.0) >= score:
                    through.pop()
                if not through:
                    break
                told[through[-1]] = score
                own, more, _ = nodes[through.pop()]
                through = through + more
    late = lambda names: [known[n] for n in names if n in known]
    if any(late(missing) for *_, missing in (*nodes, *targets)):
        told = {}
        for score, through, missing in sorted(targets, key=lambda t: -t[0]):
            todo = through + late(missing)
            while todo:
                if told.get(k := todo.pop(), 0.0) >= score:
                    continue
                told[k] = score
                own, more, missing = nodes[k]
                found.update(x for start, end, quoted in own for x in lines_of(text, start, end) if score + literal_score(text[x[0] : x[1]], quoted) >= LEAST_SCORE)
                todo += more + late(missing)
    return [Span(a, b, "literal", a) for a, b in sorted(found)]


def scan(text: str) -> list[Span]:
    """All spans of a text by start, then kind: the base ones, and literals that no base span covers."""
    base = base_spans(text)
    starts, ends = [b.start for b in base], list(accumulate((b.end for b in base), max))  # where any base span from the first on has ended by then
    before = lambda s: bisect_right(starts, s.start) - 1
    more = [s for s in literal_spans(text) if (i := before(s)) < 0 or ends[i] < s.end]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind)))


def told(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each secret's own characters replaced by ``[SECRET]``; overlapping secrets are replaced together."""
    out, at = [], 0
    for begin, end in sorted((s.value, s.end) for s in spans):
        if begin >= at:
            out += [text[at:begin], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key and an array of spans (kind, start, end in code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in bounded_slices(batch, "text", SLICE_BYTES):
                found = [[{"kind": s.kind, "start": s.start, "end": s.end} for s in scan(t)] for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, kind)], ["key", "spans"])

    type_ = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {type_}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("key", key)


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its text column replaced; all other columns and rows stay."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in bounded_slices(batch.rename_columns([str(i) for i in range(len(names))]), str(at), SLICE_BYTES):
                clean = [None if t is None else redact(t, s) if (s := scan(t)) else t for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(clean, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def secret_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    out = find_secrets(df, key, text)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(key, count("assign"), count("access"), count("hex"), F.sha2(show(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), show("spans").alias("spans"))

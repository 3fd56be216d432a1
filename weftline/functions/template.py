"""Text templates compiled to columns.

A template is parsed once, checked against limits and known columns, and turned
into one native expression: ``{{ ... }}`` outputs, ``if``/``elif``/``else``,
one level of ``for``, filters, tests and the usual operators. A null result
means that rendering failed for the row, and the row is dropped by the caller;
a column that is null itself renders as ``None``.

Strings that hold JSON are read as JSON where the template looks into them
(``{{ col.a }}``, ``{{ col[0] }}``) or computes with them; ``true``, ``false``
and ``null`` render as True, False and None.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import jsonpath
from weftline.functions.draws import bound, index, uniform

MAX_NODES = 600
MAX_DEPTH = 10
MAX_CHARS = 512_000
DOCUMENT = "_document_"  # begins the names of columns that hold what others' texts parse to
FORBIDDEN = {"import", "from", "macro", "set", "extends", "block", "include", "call"}


class TemplateError(ValueError):
    pass


# ---- syntax


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~<>()\[\]{}.,:|=]))")
PIECE = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<stmt>.*?)-?%\}|\{#.*?#\}", re.S)


class Parser:
    """Recursive descent over one expression's tokens."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> Node:
        out = self.expression()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def expression(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expression() if self.take("else") else Node("lit", "")
            return Node("cond", None, (test, value, other))
        return value

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", None, (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", None, (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("not", None, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        first, chain = self.joined(), []
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                pass
            elif self.peek("not") and self.tokens[self.at + 1][1] == "in":
                self.at, op = self.at + 2, "not in"
            elif self.take("is"):
                op = "is not" if self.take("not") else "is"
                chain.append(Node(op, self.name(), (first,)))
                continue
            else:
                break
            right = self.joined()
            chain.append(Node("compare", op, (first, right)))
            first = right
        if not chain:
            return first
        out = chain[0]
        for c in chain[1:]:
            out = Node("and", None, (out, c))
        return out

    def joined(self) -> Node:
        out = self.sum()
        while self.take("~"):
            out = Node("binary", "~", (out, self.sum()))
        return out

    def sum(self) -> Node:
        out = self.product()
        while op := self.take("+", "-"):
            out = Node("binary", op, (out, self.product()))
        return out

    def product(self) -> Node:
        out = self.signed()
        while op := self.take("*", "/", "//", "%"):
            out = Node("binary", op, (out, self.signed()))
        return out

    def signed(self) -> Node:
        if op := self.take("-", "+"):
            return Node("sign", op, (self.signed(),))
        out = self.postfix()
        return Node("binary", "**", (out, self.signed())) if self.take("**") else out

    def arguments(self, end: str) -> tuple[Node, ...]:
        out = []
        while not self.take(end):
            if self.tokens[self.at : self.at + 2] and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1 : self.at + 2] == [("op", "=")]:
                key = self.name()
                self.need("=")
                out.append(Node("named", key, (self.expression(),)))
            else:
                out.append(self.expression())
            if not self.take(","):
                self.need(end)
                break
        return tuple(out)

    def postfix(self) -> Node:
        out = self.atom()
        while True:
            if self.take("."):
                key = self.name()
                out = Node("method", key, (out, *self.arguments(")"))) if self.take("(") else Node("item", None, (out, Node("lit", key)))
            elif self.take("["):
                if self.take(":"):
                    stop = None if self.peek("]") else self.expression()
                    out = Node("slice", None, (out, None, stop))
                else:
                    key = self.expression()
                    if self.take(":"):
                        out = Node("slice", None, (out, key, None if self.peek("]") else self.expression()))
                    else:
                        out = Node("item", None, (out, key))
                self.need("]")
            elif self.take("|"):
                name = self.name()
                out = Node("filter", name, (out, *(self.arguments(")") if self.take("(") else ())))
            else:
                return out

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("lit", int(text) if text.isdigit() else float(text))
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if text.lower() in ("true", "false", "none") and text in ("true", "True", "false", "False", "none", "None"):
                return Node("lit", {"true": True, "false": False, "none": None}[text.lower()])
            return Node("name", text)
        if text == "(":
            out = self.expression()
            if self.peek(","):
                self.need(",")
                return Node("list", None, (out, *self.arguments(")")))
            self.need(")")
            return out
        if text == "[":
            return Node("list", None, self.arguments("]"))
        if text == "{":
            pairs = []
            while not self.take("}"):
                key = self.expression()
                self.need(":")
                pairs += [key, self.expression()]
                if not self.take(","):
                    self.need("}")
                    break
            return Node("dict", None, tuple(pairs))
        raise TemplateError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    """The template's tree: a ``body`` of text, outputs, ``if`` and ``for`` nodes, within the limits."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in PIECE.finditer(text):
        pieces.append(("text", text[at : m.start()]))
        if m["out"] is not None:
            pieces.append(("out", m["out"]))
        elif m["stmt"] is not None:
            pieces.append(("stmt", m["stmt"].strip()))
        at = m.end()
    pieces.append(("text", text[at:]))
    if any(k == "text" and re.search(r"\{\{|\{%", x) for k, x in pieces):
        raise TemplateError("a tag isn't closed")
    tree, rest = body(pieces, 0, (), False)
    if rest != len(pieces):
        raise TemplateError(f"unexpected {pieces[rest][1]!r}")
    nodes, depth = measured(tree)
    if nodes > MAX_NODES or depth > MAX_DEPTH:
        raise TemplateError("the template is too large")
    return tree


def body(pieces: list[tuple[str, str]], at: int, stops: tuple[str, ...], inside: bool) -> tuple[Node, int]:
    out = []
    while at < len(pieces):
        kind, text = pieces[at]
        if kind == "text":
            if text:
                out.append(Node("text", text))
            at += 1
        elif kind == "out":
            out.append(Node("out", None, (Parser(text).whole(),)))
            at += 1
        else:
            word = text.split(None, 1)[0] if text else ""
            if word in stops:
                break
            if word in FORBIDDEN:
                raise TemplateError(f"{word!r} isn't allowed")
            rest = text[len(word) :]
            if word == "if":
                branches, test = [], Parser(rest).whole()
                while True:
                    inner, at = body(pieces, at + 1, ("elif", "else", "endif"), inside)
                    branches += [test, inner]
                    if at >= len(pieces):
                        raise TemplateError("an if isn't closed")
                    word, _, rest = pieces[at][1].partition(" ")
                    if word == "endif":
                        break
                    test = Parser(rest).whole() if word == "elif" else Node("lit", True)
                out.append(Node("if", None, tuple(branches)))
                at += 1
            elif word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if inside or not m or m[2].strip().endswith(" recursive"):
                    raise TemplateError("only one plain level of for is allowed")
                inner, at = body(pieces, at + 1, ("endfor",), True)
                if at >= len(pieces):
                    raise TemplateError("a for isn't closed")
                out.append(Node("for", m[1], (Parser(m[2]).whole(), inner)))
                at += 1
            else:
                raise TemplateError(f"{word!r} isn't known")
    return Node("body", None, tuple(out)), at


def measured(node: Node) -> tuple[int, int]:
    """Nodes and depth; a chain of ``~`` is one node, however many values it joins."""
    parts = [p for p in node.parts if isinstance(p, Node)]
    while node.value == "~" and node.kind == "binary" and parts[0].kind == "binary" and parts[0].value == "~":
        parts = [*parts[0].parts, *parts[1:]]
    inner = [measured(p) for p in parts]
    return 1 + sum(n for n, _ in inner), 1 + max((d for _, d in inner), default=0)


def walk(node: Node) -> Iterator[Node]:
    yield node
    for p in node.parts:
        if isinstance(p, Node):
            yield from walk(p)


def references(template: str | Node) -> list[str]:
    """Columns that a template needs, in order of first use."""
    tree = parse(template) if isinstance(template, str) else template
    bound = {n.value for n in walk(tree) if n.kind == "for"} | {"loop"}
    return list(dict.fromkeys(n.value for n in walk(tree) if n.kind == "name" and n.value not in bound))


# ---- compilation


@dataclass(frozen=True)
class Value:
    """A compiled expression: its column, what it is, and for lists what they hold. ``plain`` is a column read as it is."""

    column: Column
    kind: str  # int, float, str, bool, list, map, struct, json, none
    of: str = "str"
    plain: bool = False
    type: T.DataType | None = None
    shown: Column | None = None  # a list's text, where its elements don't tell it
    found: Column | None = None  # what a list's elements are made of, as many as they
    document: Column | None = None  # a text as JSON, where it is parsed already


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType):
        return "float"
    return {T.ArrayType: "list", T.MapType: "map", T.StructType: "struct", T.NullType: "none"}.get(type(t), "str")


def value_of(column: Column, t: T.DataType, plain: bool = False) -> Value:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), "str", plain=plain)
    if isinstance(t, T.DateType):
        return Value(F.date_format(column, "yyyy-MM-dd"), "str", plain=plain)
    if isinstance(t, T.DecimalType):
        return Value(column.cast("double"), "float", plain=plain)
    if isinstance(t, T.BinaryType):
        return Value(F.decode(column, "UTF-8"), "str", plain=plain)
    return Value(column, kind_of(t), kind_of(t.elementType) if isinstance(t, T.ArrayType) else "str", plain, t)


def float_text(c: Column) -> Column:
    """A number as Python shows a float: with an exponent below 1e-4 and from 1e16 on. The digits are Java's, which before
    Java 19 are too many for a few numbers (-1.25e22)."""

    def written(s: Column) -> Column:
        sign, digits = F.regexp_extract(s, "^-?", 0), F.regexp_replace(F.regexp_replace(s, "E.*|[-.]", ""), "(?<=.)0+$", "")
        power, n = F.regexp_extract(s, "E(.*)$", 1).cast("int"), F.length(digits)
        rest = lambda at, none: F.when(n > at, F.concat(F.lit("."), F.substring(digits, at + 1, n))).otherwise(none)
        large = F.concat(F.substring(F.rpad(digits, F.greatest(power + 1, n), "0"), F.lit(1), power + 1), rest(power + 1, ".0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        exponent = F.concat(F.when(power > 0, "e+").otherwise("e-"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(sign, F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(F.concat(F.substring(digits, 1, 1), rest(F.lit(1), ""), exponent)))

    # Java writes an exponent below 1e-3 and from 1e7 on.
    s = c.cast("string")
    out = F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16) & (c % 1 == 0), F.concat(c.cast("long").cast("string"), F.lit(".0")))
    out = out.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
    return out.when(F.contains(s, F.lit("E")), bound(s, written)).otherwise(s)


def text(v: Value) -> Column:
    """As Python's str() shows it; null stays null but for plain columns."""
    c = v.column
    if v.shown is not None:
        return v.shown
    if v.kind == "bool":
        out = F.initcap(c.cast("string"))
    elif v.kind == "none":
        return F.lit("None")
    elif v.kind in ("struct", "map"):
        out = F.to_json(c)
    elif v.kind == "list":
        shown = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'")) if v.of == "str" else text(Value(x, v.of)))
        out = F.concat(F.lit("["), F.array_join(shown, ", ", "None"), F.lit("]"))
    elif v.kind == "float":
        out = float_text(c)
    elif v.kind == "str" and v.plain:
        out = F.when(c == "true", "True").when(c == "false", "False").when(c == "null", "None").otherwise(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("None")) if v.plain else out


def texts(v: Value) -> Column:
    """A list's elements as texts."""
    return F.transform(v.column, float_text) if v.of == "float" else v.column.cast("array<string>")


def number(v: Value) -> Column:
    if v.kind in ("int", "float"):
        return v.column
    if v.kind == "bool":
        return v.column.cast("long")
    return v.column.try_cast("double")


def whole_power(x: Column, y: Column) -> Column:
    """A power of whole numbers without going through doubles, which hold 53 bits; null beyond 64 bits, as products are, and for exponents below 0."""
    # Beyond 64 only powers of -1, 0 and 1 fit, which go by the exponent's last bit.
    times = F.when(y <= 64, y).when(y > 64, 64 + F.pmod(y, F.lit(2)))
    return F.when(y >= 0, F.aggregate(F.array_repeat(x, times.cast("int")), F.lit(1).cast("long"), F.try_multiply))


def whole_division(x: Column, y: Column) -> dict[str, Column]:
    """Quotient and remainder of whole numbers, down for negative ones as in Python, without going through doubles; null for a divisor of 0."""
    y = F.nullif(y, F.lit(0).cast("long"))
    least = F.try_subtract(F.lit(0).cast("long"), x)  # -2^63 by -1 has no quotient
    cut, left = F.when(y == -1, least).otherwise(F.call_function("div", x, y)), F.when(y == -1, F.lit(0).cast("long")).otherwise(x % y)
    down = (left != 0) & ((left < 0) != (y < 0))
    return {"//": F.when(down, cut - 1).otherwise(cut), "%": F.when(down, left + y).otherwise(left)}


def truth(v: Value) -> Column:
    c = v.column
    if v.kind == "bool":
        out = c
    elif v.kind in ("int", "float"):
        out = c != 0
    elif v.kind in ("str", "json"):
        out = (c != "") & ~c.isin("false", "null", "0", "[]", "{}") if v.plain or v.kind == "json" else c != ""
    elif v.kind in ("list", "map"):
        out = F.size(c) > 0
    elif v.kind == "struct":
        out = c.isNotNull()
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False)) if v.plain or v.kind == "none" else out


class Compiler:
    def __init__(self, schema: T.StructType, seed: int = 0, row: Column | None = None) -> None:
        self.fields, self.seed, self.row = {f.name: f.dataType for f in schema.fields}, seed, row
        self.bound: dict[str, Value] = {}
        self.draws = 0

    # -- templates

    def render(self, template: str) -> Column:
        tree = parse(template)
        out = self.body(tree)
        limited = lambda x: F.when(F.length(x) <= MAX_CHARS, x)
        return bound(out, limited) if any(n.kind == "filter" and n.value == "jsonpath" for n in walk(tree)) else limited(out)

    def body(self, node: Node) -> Column:
        parts = [self.part(p) for p in node.parts]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")

    def part(self, node: Node) -> Column:
        if node.kind == "text":
            return F.lit(node.value)
        if node.kind == "out":
            return text(self.value(node.parts[0]))
        if node.kind == "if":
            tests, bodies = node.parts[::2], node.parts[1::2]
            out = F.lit("")
            for test, inner in reversed(list(zip(tests, bodies, strict=True))):
                out = F.when(truth(self.value(test)), self.body(inner)).otherwise(out)
            return out
        over = self.value(node.parts[0])
        if over.kind != "list":
            over = Value(F.from_json(over.column, "array<string>"), "list")

        def each(x: Column, i: Column) -> Column:
            kept = dict(self.bound)
            loop = {"index": i + 1, "index0": i, "first": i == 0, "last": i == F.size(over.column) - 1, "length": F.size(over.column)}
            self.bound |= {node.value: Value(x, over.of, type=over.type.elementType if isinstance(over.type, T.ArrayType) else None), "loop": Value(F.lit(None), "loop", type=loop)}
            out = self.body(node.parts[1])
            self.bound = kept
            return out

        return F.array_join(F.transform(over.column, each), "")

    def condition(self, template: str) -> Column:
        """Truth of a template that is one expression, without going through text."""
        stripped = template.strip()
        if stripped.startswith("{{") and stripped.endswith("}}") and stripped.count("{{") == 1:
            stripped = stripped[2:-2]
        elif "{{" in stripped or "{%" in stripped:
            return truth(Value(self.render(template), "str", plain=True))
        return truth(self.value(Parser(stripped).whole()))

    # -- expressions

    def value(self, n: Node) -> Value:
        return getattr(self, f"on_{n.kind.replace(' ', '_')}")(n)

    def on_lit(self, n: Node) -> Value:
        v = n.value
        if v is None:
            return Value(F.lit(None).cast("string"), "none")
        return Value(F.lit(v), {bool: "bool", int: "int", float: "float", str: "str"}[type(v)])

    def on_name(self, n: Node) -> Value:
        if n.value in self.bound:
            return self.bound[n.value]
        if n.value not in self.fields:
            raise TemplateError(f"no column is named {n.value!r}")
        v = value_of(F.col(f"`{n.value}`"), self.fields[n.value], plain=True)
        return replace(v, document=F.col(f"`{DOCUMENT}{n.value}`")) if f"{DOCUMENT}{n.value}" in self.fields else v

    def on_item(self, n: Node) -> Value:
        over, key = self.value(n.parts[0]), n.parts[1]
        if over.kind == "loop":
            return Value(over.type[key.value], "bool" if key.value in ("first", "last") else "int")
        if over.kind == "struct" and key.kind == "lit" and isinstance(over.type, T.StructType):
            if key.value not in over.type.fieldNames():
                raise TemplateError(f"no field is named {key.value!r}")
            return value_of(over.column.getField(key.value), over.type[key.value].dataType)
        if over.kind == "map":
            t = over.type.valueType if isinstance(over.type, T.MapType) else T.StringType()
            return value_of(F.try_element_at(over.column, self.value(key).column), t)
        if over.kind == "list":
            at = self.value(key).column.cast("int")
            t = over.type.elementType if isinstance(over.type, T.ArrayType) else None
            got = F.try_element_at(over.column, F.when(at < 0, at).otherwise(at + 1))
            return value_of(got, t) if t is not None else Value(got, over.of)
        if key.kind == "lit":
            path = f"[{key.value}]" if isinstance(key.value, int) else f"['{key.value}']"
            return Value(F.get_json_object(over.column, f"${path}"), "json")
        raise TemplateError("JSON text is looked into by fixed keys only")

    def on_slice(self, n: Node) -> Value:
        over = self.value(n.parts[0])
        size = F.size(over.column) if over.kind == "list" else F.length(text(over))
        place = lambda p, end: end if p is None else F.greatest(F.lit(0), F.when(self.value(p).column < 0, size + self.value(p).column).otherwise(F.least(self.value(p).column.cast("int"), size)))
        start, stop = place(n.parts[1], F.lit(0)), place(n.parts[2], size)
        long = F.greatest(F.lit(0), stop - start)
        if over.kind == "list":
            return Value(F.slice(over.column, start + 1, long), "list", over.of, type=over.type)
        return Value(F.substring(text(over), start + 1, long), "str")

    def on_list(self, n: Node) -> Value:
        held = [self.value(p) for p in n.parts]
        kinds = {v.kind for v in held}
        kind = "str" if not held or len(kinds) > 1 and not kinds <= {"int", "float"} else "float" if len(kinds) > 1 else held[0].kind
        columns = [text(v) if kind == "str" else v.column.cast("double") if kind == "float" else v.column for v in held]
        return Value(F.array(*columns) if columns else F.array().cast("array<string>"), "list", kind)

    def on_dict(self, n: Node) -> Value:
        held = [self.value(p) for p in n.parts]
        kinds = {v.kind for v in held[1::2]}
        same = len(kinds) == 1
        return Value(F.create_map(*(x for k, v in zip(held[::2], held[1::2], strict=True) for x in (text(k), v.column if same else text(v)))), "map", type=None)

    def on_sign(self, n: Node) -> Value:
        v = self.value(n.parts[0])
        return Value(-number(v) if n.value == "-" else number(v), v.kind if v.kind in ("int", "float") else "float")

    def on_binary(self, n: Node) -> Value:
        a, b = (self.value(p) for p in n.parts)
        op = n.value
        if op == "~" or op == "+" and a.kind in ("str", "json") and b.kind in ("str", "json"):
            return Value(F.concat(text(a), text(b)), "str")
        if op == "+" and a.kind == b.kind == "list":
            return Value(F.concat(a.column, b.column), "list", a.of, type=a.type)
        if op == "*" and a.kind == "str" and b.kind == "int":
            return Value(F.repeat(a.column, b.column.cast("int")), "str")
        whole = a.kind in ("int", "bool") and b.kind in ("int", "bool")
        x, y = number(a), number(b)
        if op == "/":
            return Value(F.try_divide(x.cast("double"), y.cast("double")), "float")
        if op in ("//", "%") and whole:
            return Value(whole_division(x.cast("long"), y.cast("long"))[op], "int")
        if op == "//":
            q = F.floor(F.try_divide(x.cast("double"), y.cast("double")))
            return Value(q.cast("double"), "float")
        if op == "%":
            r = x - y * F.floor(F.try_divide(x.cast("double"), y.cast("double")))
            return Value(r, "float")
        if op == "**":
            return Value(whole_power(x.cast("long"), y.cast("long")) if whole else F.pow(x, y), "int" if whole else "float")
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x if whole else x.cast("double"), y if whole else y.cast("double"))
        return Value(out, "int" if whole else "float")

    def on_compare(self, n: Node) -> Value:
        a, b = (self.value(p) for p in n.parts)
        op = n.value
        if op in ("in", "not in"):
            if b.kind == "list":
                out = F.array_contains(b.column, text(a) if b.of in ("str", "json") else number(a))
            elif b.kind == "map":
                out = F.map_contains_key(b.column, text(a))
            else:
                out = F.contains(text(b), text(a))
            out = F.coalesce(out, F.lit(False))
            return Value(out if op == "in" else ~out, "bool")
        if "none" in (a.kind, b.kind):
            same = a.column.isNull() if b.kind == "none" else b.column.isNull()
            return Value(same if op == "==" else ~same, "bool")
        digits = {"int", "float", "bool"}
        if a.kind in digits or b.kind in digits:
            x, y = number(a), number(b)
        else:
            x, y = (v.column if v.kind == "str" else text(v) for v in (a, b))
        if op == "==":
            return Value(F.coalesce(x == y, F.lit(False)), "bool")
        if op == "!=":
            return Value(F.coalesce(x != y, F.lit(True)), "bool")
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")

    def _chosen(self, test: Column, a: Value, b: Value) -> Value:
        if a.kind == b.kind:
            return Value(F.when(test, a.column).otherwise(b.column), a.kind, a.of, a.plain and b.plain, a.type)
        if {a.kind, b.kind} <= {"int", "float"}:
            return Value(F.when(test, a.column.cast("double")).otherwise(b.column.cast("double")), "float")
        return Value(F.when(test, text(a)).otherwise(text(b)), "str")

    def on_and(self, n: Node) -> Value:
        a, b = (self.value(p) for p in n.parts)
        return Value(truth(a) & truth(b), "bool") if a.kind == b.kind == "bool" else self._chosen(truth(a), b, a)

    def on_or(self, n: Node) -> Value:
        a, b = (self.value(p) for p in n.parts)
        return Value(truth(a) | truth(b), "bool") if a.kind == b.kind == "bool" else self._chosen(truth(a), a, b)

    def on_not(self, n: Node) -> Value:
        return Value(~truth(self.value(n.parts[0])), "bool")

    def on_cond(self, n: Node) -> Value:
        test, a, b = (self.value(p) for p in n.parts)
        return self._chosen(truth(test), a, b)

    def on_is(self, n: Node) -> Value:
        v, name = self.value(n.parts[0]), n.value
        fixed = {"string": v.kind in ("str", "json"), "number": v.kind in ("int", "float"), "integer": v.kind == "int", "float": v.kind == "float", "boolean": v.kind == "bool", "mapping": v.kind in ("map", "struct"), "sequence": v.kind in ("list", "str"), "iterable": v.kind in ("list", "str", "map")}
        if name in fixed:
            return Value(F.lit(fixed[name]), "bool")
        tests = {"defined": lambda: v.column.isNotNull(), "undefined": lambda: v.column.isNull(), "none": lambda: v.column.isNull(), "even": lambda: number(v) % 2 == 0, "odd": lambda: F.abs(number(v) % 2) == 1, "true": lambda: truth(v), "false": lambda: ~truth(v), "lower": lambda: text(v) == F.lower(text(v)), "upper": lambda: text(v) == F.upper(text(v))}
        if name not in tests:
            raise TemplateError(f"no test is named {name!r}")
        return Value(tests[name](), "bool")

    def on_is_not(self, n: Node) -> Value:
        return Value(~self.on_is(Node("is", n.value, n.parts)).column, "bool")

    def on_method(self, n: Node) -> Value:
        v = self.value(n.parts[0])
        args = [self.value(p) for p in n.parts[1:]]
        s = text(v)
        one = args[0].column if args else None
        methods: dict[str, Callable[[], Value]] = {
            "upper": lambda: Value(F.upper(s), "str"), "lower": lambda: Value(F.lower(s), "str"), "strip": lambda: Value(F.trim(s), "str"),
            "title": lambda: Value(F.initcap(F.lower(s)), "str"), "capitalize": lambda: self.f_capitalize(v, [], {}),
            "startswith": lambda: Value(F.startswith(s, one), "bool"), "endswith": lambda: Value(F.endswith(s, one), "bool"),
            "replace": lambda: Value(F.replace(s, one, args[1].column), "str"), "split": lambda: Value(F.split(s, F.concat(F.lit("\\Q"), one, F.lit("\\E"))) if args else F.filter(F.split(s, "\\s+"), lambda x: x != ""), "list", "str"),
            "join": lambda: Value(F.array_join(texts(args[0]), s), "str"), "get": lambda: self.on_item(Node("item", None, (n.parts[0], n.parts[1]))),
        }
        if n.value not in methods:
            raise TemplateError(f"the method {n.value!r} isn't allowed")
        return methods[n.value]()

    def on_filter(self, n: Node) -> Value:
        if not hasattr(self, f"f_{n.value}"):
            raise TemplateError(f"no filter is named {n.value!r}")
        v = self.value(n.parts[0])
        args = [p for p in n.parts[1:] if p.kind != "named"]
        named = {p.value: p.parts[0] for p in n.parts[1:] if p.kind == "named"}
        return getattr(self, f"f_{n.value}")(v, args, named)

    def _fixed(self, args: list[Node], named: dict[str, Node], place: int, name: str, default: Any) -> Any:
        node = args[place] if place < len(args) else named.get(name)
        if node is None:
            return default
        if node.kind == "sign" and node.parts[0].kind == "lit":
            return -node.parts[0].value
        if node.kind != "lit":
            raise TemplateError(f"{name} must be a literal")
        return node.value

    # -- filters

    def f_abs(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.abs(number(v)), v.kind if v.kind == "int" else "float")

    def f_capitalize(self, v: Value, a: list, k: dict) -> Value:
        s = text(v)
        return Value(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, MAX_CHARS))), "str")

    def f_escape(self, v: Value, a: list, k: dict) -> Value:
        s = text(v)
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
            s = F.replace(s, F.lit(old), F.lit(new))
        return Value(s, "str")

    f_forceescape = f_escape

    def f_first(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.try_element_at(v.column, F.lit(1)), v.of) if v.kind == "list" else Value(F.nullif(F.substring(text(v), 1, 1), F.lit("")), "str")

    def f_last(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.try_element_at(v.column, F.lit(-1)), v.of) if v.kind == "list" else Value(F.nullif(F.right(text(v), F.lit(1)), F.lit("")), "str")

    def f_float(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.coalesce(number(v).cast("double"), F.lit(float(self._fixed(a, k, 0, "default", 0.0)))), "float")

    def f_int(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.coalesce(number(v).cast("double").try_cast("long"), F.lit(int(self._fixed(a, k, 0, "default", 0))).cast("long")), "int")

    def f_items(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.map_entries(v.column), "list", "struct")

    def f_length(self, v: Value, a: list, k: dict) -> Value:
        return Value((F.size(v.column if v.found is None else v.found) if v.kind in ("list", "map") else F.length(text(v))).cast("long"), "int")

    f_count = f_length

    def f_list(self, v: Value, a: list, k: dict) -> Value:
        return v if v.kind == "list" else Value(F.filter(F.split(text(v), ""), lambda x: x != ""), "list", "str")

    def f_lower(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.lower(text(v)), "str")

    def f_upper(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.upper(text(v)), "str")

    def f_max(self, v: Value, a: list, k: dict) -> Value:
        return self._extreme(v, F.array_max)

    def f_min(self, v: Value, a: list, k: dict) -> Value:
        return self._extreme(v, F.array_min)

    def _extreme(self, v: Value, of: Callable[[Column], Column]) -> Value:
        if v.of != "json":
            return Value(of(v.column), v.of)
        return Value(of(F.transform(v.column, lambda x: F.struct(x.try_cast("double").alias("n"), x.alias("v"))))["v"], "json")

    def f_random(self, v: Value, a: list, k: dict) -> Value:
        if self.row is None:
            raise TemplateError("random needs a row id")
        self.draws += 1
        held = self.f_list(v, [], {}) if v.kind != "list" else v
        u = uniform(self.seed, "template", self.row, self.draws)
        return Value(F.try_element_at(held.column, F.floor(u * F.size(held.column)).cast("int") + 1), held.of)

    def f_replace(self, v: Value, a: list, k: dict) -> Value:
        old, new, count = self.value(a[0]), self.value(a[1]), self._fixed(a, k, 2, "count", None)
        if count is None:
            return Value(F.replace(text(v), text(old), text(new)), "str")
        parts = F.split(text(v), F.concat(F.lit("\\Q"), text(old), F.lit("\\E")), count + 1)
        return Value(F.array_join(parts, str(a[1].value)), "str") if a[1].kind == "lit" else Value(F.aggregate(parts, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, text(new), x))), "str")

    def f_reverse(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.reverse(v.column if v.kind == "list" else text(v)), v.kind if v.kind == "list" else "str", v.of)

    def f_round(self, v: Value, a: list, k: dict) -> Value:
        places, method, x = int(self._fixed(a, k, 0, "precision", 0)), self._fixed(a, k, 1, "method", "common"), number(v).cast("double")
        scale = F.lit(float(10**places))
        out = {"common": lambda: F.bround(x, places), "ceil": lambda: F.ceil(x * scale).cast("double") / scale, "floor": lambda: F.floor(x * scale).cast("double") / scale}[method]()
        return Value(out, "float")

    def f_sort(self, v: Value, a: list, k: dict) -> Value:
        down = bool(self._fixed(a, k, 0, "reverse", False))
        key = (lambda x: F.lower(x)) if v.of == "str" else (lambda x: F.struct(x.try_cast("double"), x)) if v.of == "json" else (lambda x: x)
        sign = -1 if down else 1
        return Value(F.array_sort(v.column, lambda x, y: F.when(key(x) < key(y), -sign).when(key(x) > key(y), sign).otherwise(0)), "list", v.of)

    def f_string(self, v: Value, a: list, k: dict) -> Value:
        return Value(text(v), "str")

    def f_title(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.initcap(F.lower(text(v))), "str")

    def f_trim(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.regexp_replace(text(v), "^\\s+|\\s+$", ""), "str")

    def f_truncate(self, v: Value, a: list, k: dict) -> Value:
        n, kill = int(self._fixed(a, k, 0, "length", 255)), bool(self._fixed(a, k, 1, "killwords", False))
        end, leeway = self._fixed(a, k, 2, "end", "..."), int(self._fixed(a, k, 3, "leeway", 5))
        s = text(v)
        head = F.substring(s, 1, max(0, n - len(end)))
        cut = head if kill else F.regexp_replace(head, "(?s)^(.*) .*$", "$1")
        return Value(F.when(F.length(s) <= n + leeway, s).otherwise(F.concat(cut, F.lit(end))), "str")

    def f_unique(self, v: Value, a: list, k: dict) -> Value:
        if v.of != "str":
            return Value(F.array_distinct(v.column), "list", v.of)
        seen = F.transform(v.column, lambda x: F.lower(x))
        return Value(F.filter(v.column, lambda x, i: F.array_position(seen, F.lower(x)) == i + 1), "list", v.of)

    def f_urlencode(self, v: Value, a: list, k: dict) -> Value:
        s = F.url_encode(text(v))
        for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
            s = F.replace(s, F.lit(old), F.lit(new))
        return Value(s, "str")

    def f_default(self, v: Value, a: list, k: dict) -> Value:
        return self._chosen(v.column.isNotNull(), v, self.value(a[0]) if a else Value(F.lit(""), "str"))

    def f_join(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.array_join(texts(v), self._fixed(a, k, 0, "d", "")), "str")

    def f_tojson(self, v: Value, a: list, k: dict) -> Value:
        return Value(F.to_json(v.column) if v.kind in ("list", "map", "struct") else text(v), "str")

    def f_jsonpath(self, v: Value, a: list, k: dict) -> Value:
        """A list of all matches in a structured value, in document order; of anything else null, which fails the row."""
        try:
            segments = jsonpath.parse(self._fixed(a, k, 0, "expression", "$"))
        except jsonpath.PathError as e:
            raise TemplateError(str(e)) from None
        held = F.to_json(v.column) if v.kind in ("struct", "map") else v.column.cast("string")
        within = jsonpath.matches(v.document, segments) if v.document is not None else bound(F.try_parse_json(held), lambda x: jsonpath.matches(x, segments))
        found = F.when(F.startswith(F.ltrim(held), F.lit("{")), within)
        return Value(F.transform(found, lambda x: bound(F.to_json(x), jsonpath.plain)), "list", "json", shown=jsonpath.listed(found), found=found)


def render(template: str, schema: T.StructType, seed: int = 0, row: Column | None = None) -> Column:
    return Compiler(schema, seed, row).render(template)


def with_documents(df: DataFrame, templates: list[str]) -> DataFrame:
    """``df`` with texts parsed beside them where several JSON paths look into them, so that a document is parsed once."""
    looked = [n.parts[0].value for t in templates for n in walk(parse(t)) if n.kind == "filter" and n.value == "jsonpath" and n.parts[0].kind == "name"]
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and looked.count(f.name) > 1]
    return df.select("*", *(F.try_parse_json(F.col(f"`{c}`")).alias(f"{DOCUMENT}{c}") for c in names)) if names else df


def json_escaped(c: Column) -> Column:
    """Text as it stands inside a JSON string."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), '^\\{"v":"', ""), '"\\}$', "")


def deserialize(text_value: str) -> Any:
    """A string cell read as JSON where it parses."""
    try:
        return json.loads(text_value)
    except ValueError:
        return text_value

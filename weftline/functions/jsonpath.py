"""JSON paths compiled to native VARIANT expressions.

A path is a row of segments after ``$``, each with one or more selectors: names,
places, slices, wildcards and filters, and ``..`` before a segment looks at all
descendants too. It compiles to one Column that holds the matches of a document
as an array of variants: names and places in a row are one ``variant_get``; every
other segment is a ``transform`` over the nodes so far, and takes the names and
places after it along. Nothing leaves the JVM.

Descendants come in document order, each before its own. The expression reaches
``DEEPEST`` levels; a document that goes deeper gives null, as a cell that fails
does, rather than some of its matches. Members of objects come in order of their
names, as variants hold them. Filters compare numbers with numbers and texts with
texts; a missing value equals only a missing one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.draws import bound

DEEPEST = 24  # levels below a node that ".." reaches
TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_\u0080-\U0010FFFF][\w\-\u0080-\U0010FFFF]*)"
    r"|(?P<mark>\.\.|==|!=|<=|>=|&&|\|\||[$@.\[\]()*,:?<>!]))"
)


class PathError(ValueError):
    """A path that can't be read."""


Names = tuple[tuple[str, Any], ...]  #: selectors, where they stand in a row mostly of names and places


@dataclass(frozen=True)
class Segment:
    """Selectors of nodes: (kind, value) pairs, of the nodes themselves or, if ``deep``, of all their descendants too."""

    selectors: Names
    deep: bool = False

    @property
    def single(self) -> bool:
        """Whether it chooses one value at most by a fixed key."""
        return not self.deep and len(self.selectors) == 1 and (self.selectors[0][0] == "name" or self.selectors[0][0] == "index" and self.selectors[0][1] >= 0)


class Reader:
    def __init__(self, path: str) -> None:
        self.path, self.tokens, at = path, [], 0
        while path[at:].strip():
            m = TOKEN.match(path, at)
            if not m:
                raise PathError(f"{path!r} can't be read at {path[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *marks: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] in [("mark", m) for m in marks]

    def take(self, *marks: str) -> str | None:
        if self.peek(*marks):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise PathError(f"{self.path!r} lacks a {mark!r}")

    def next(self, *kinds: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise PathError(f"{self.path!r} lacks a {' or '.join(kinds)}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple[Segment, ...]:
        self.need("$")
        out = self.segments()
        if self.at < len(self.tokens):
            raise PathError(f"{self.path!r} has {self.tokens[self.at][1]!r} too many")
        return out

    def segments(self) -> tuple[Segment, ...]:
        out = []
        while mark := self.take(".", "..", "["):
            deep = mark == ".."
            if mark == "[" or deep and self.take("["):
                out.append(Segment(self.bracket(), deep))
            elif self.take("*"):
                out.append(Segment((("wild", None),), deep))
            else:
                out.append(Segment((("name", self.next("name")[1]),), deep))
        return tuple(out)

    def bracket(self) -> Names:
        out = [self.selector()]
        while self.take(","):
            out.append(self.selector())
        self.need("]")
        return tuple(out)

    def selector(self) -> tuple[str, Any]:
        if self.take("*"):
            return "wild", None
        if self.take("?"):
            return "filter", self.either()
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            return "name", unquoted(self.next("text")[1])
        bounds: list[int | None] = [self.whole_number()]
        while self.take(":"):
            bounds.append(self.whole_number())
        if len(bounds) == 1:
            if bounds[0] is None:
                raise PathError(f"{self.path!r} has an empty selector")
            return "index", bounds[0]
        if len(bounds) > 3 or bounds[2:] == [0]:
            raise PathError(f"{self.path!r} has a slice that can't be read")
        return "slice", (*bounds, None)[:3]

    def whole_number(self) -> int | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            text = self.next("number")[1]
            if not re.fullmatch(r"-?\d+", text):
                raise PathError(f"{text!r} is no place")
            return int(text)
        return None

    # -- filters

    def either(self) -> tuple:
        out = self.both()
        while self.take("||"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.test()
        while self.take("&&"):
            out = ("and", out, self.test())
        return out

    def test(self) -> tuple:
        if self.take("!"):
            return "not", self.test()
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        left = self.operand()
        if op := self.take("==", "!=", "<=", ">=", "<", ">"):
            return "compare", op, left, self.operand()
        if left[0] in ("path", "match", "search"):
            return "holds", left
        raise PathError(f"{self.path!r} has a test that compares nothing")

    def operand(self) -> tuple:
        if root := self.take("@", "$"):
            return "path", root, self.segments()
        kind, text = self.next("text", "number", "name")
        if kind == "text":
            return "literal", unquoted(text)
        if kind == "number":
            return "literal", float(text) if re.search(r"[.eE]", text) else int(text)
        if text in ("true", "false", "null"):
            return "literal", {"true": True, "false": False, "null": None}[text]
        if text in ("length", "match", "search"):
            self.need("(")
            parts = [self.operand()]
            while self.take(","):
                parts.append(self.operand())
            self.need(")")
            if len(parts) != (1 if text == "length" else 2):
                raise PathError(f"{text!r} takes other arguments")
            return text, *parts
        raise PathError(f"{self.path!r} has the unknown word {text!r}")


def unquoted(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), text[1:-1])


def parse(path: str) -> tuple[Segment, ...]:
    return Reader(path).whole()


# ---- compilation


def got(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, F.lit(path), kind)


def nothing() -> Column:
    return F.array().cast("array<variant>")


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def reached(v: Column, at: Names, kind: str = "variant") -> Column:
    """What a row of names and places leads to. Names go by a struct's fields, as Spark throws and catches an exception where a path isn't there."""
    if any(k != "name" for k, _ in at):
        return got(v, "$" + path_of(at), kind)
    return led_in(got(v, "$", shape({at}, kind)), at)


def elements(v: Column, at: Names = ()) -> Column:
    """An array's elements; of anything else none."""
    return F.coalesce(reached(v, at, "array<variant>"), nothing())


def children(v: Column, at: Names = ()) -> Column:
    """Elements of an array, values of an object by name."""
    return F.coalesce(reached(v, at, "array<variant>"), F.map_values(reached(v, at, "map<string,variant>")), nothing())


def spread(nodes: Column, each: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(nodes, each))


def joined(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def container(v: Column) -> Column:
    return got(v, "$", "struct<>").isNotNull() | got(v, "$", "array<struct<>>").isNotNull()


def descended(v: Column, each: Callable[[Column], Column], levels: int = DEEPEST) -> Column:
    """What ``each`` gives of a node and of all its descendants, each before its own; null where they go deeper than ``levels``.
    Only arrays and objects are walked to, as nothing is chosen from other values."""
    if levels == 0:
        return F.when(F.size(children(v)) == 0, each(v))
    within = spread(children(v), lambda c: F.when(container(c), descended(c, each, levels - 1)).otherwise(nothing()))
    return joined([each(v), within])


def place(selector: tuple[str, Any]) -> str | None:
    """A name or place as a path's step; None for other selectors and names that paths can't hold."""
    kind, value = selector
    if kind == "index" and value >= 0:
        return f"[{value}]"
    return f"['{value}']" if kind == "name" and "'" not in value and "\\" not in value else None


def led(segments: tuple[Segment, ...]) -> tuple[Names, tuple[Segment, ...]]:
    """The names and places that a path begins with, and the segments after them."""
    n = 0
    while n < len(segments) and segments[n].single and place(segments[n].selectors[0]):
        n += 1
    return tuple(s.selectors[0] for s in segments[:n]), segments[n:]


def path_of(selectors: Names) -> str:
    return "".join(map(place, selectors))


def after(nodes: Column, tail: Names) -> Column:
    """What a row of names and places leads to from each node."""
    return present(F.transform(nodes, lambda x: reached(x, tail))) if tail else nodes




def shape(rows: set[Names], kind: str = "variant") -> str | None:
    """A struct's type that holds what rows of names lead to; None where one leads into what another asks for whole."""
    if () in rows:
        return kind if len(rows) == 1 else None
    first = sorted({r[0][1] for r in rows})
    inner = [shape({r[1:] for r in rows if r[0][1] == name}, kind) for name in first]
    if None in inner or len({n.lower() for n in first}) < len(first):
        return None
    return f"struct<{', '.join(f'`{n.replace('`', '``')}`:{t}' for n, t in zip(first, inner, strict=True))}>"


def led_in(v: Column, names: Names) -> Column:
    for _, name in names:
        v = v.getField(name)
    return v


def fields(v: Column, at: Names, names: Names) -> Column:
    """What a row of names leads to from each element of an array, null where nothing is there; null where there is no array."""
    return led_in(reached(v, at, f"array<{shape({names})}>"), names)


@dataclass(frozen=True)
class Shaped:
    """An element of which only some members are taken."""

    held: Column


def asked(tree: Any) -> set[Names] | None:
    """The rows of names that a filter asks of an element; None if it asks for anything else."""
    if not isinstance(tree, tuple) or tree[:1] == ("literal",):
        return set()
    if tree[0] == "path":
        names, rest = led(tree[2])
        return set() if tree[1] == "$" else {names} if names and not rest and all(k == "name" for k, _ in names) else None
    parts = [asked(t) for t in tree[1:]]
    return None if None in parts else set().union(*parts)


def filtered(v: Column, at: Names, test: tuple, tail: Names, root: Column) -> Column:
    """Children that pass a test, and what the tail leads to from them. Where only names are asked of them, no more than those members is taken."""
    rows = asked(test)
    kind = shape({*rows, tail}) if rows is not None and tail and all(k == "name" for k, _ in tail) else None
    if not kind:
        return after(F.filter(children(v, at), lambda x: holds(test, x, root)), tail)
    members = F.coalesce(reached(v, at, f"array<{kind}>"), F.map_values(reached(v, at, f"map<string,{kind}>")))
    kept = F.filter(members, lambda x: led_in(x, tail).isNotNull() & holds(test, Shaped(x), root))
    return F.coalesce(led_in(kept, tail), nothing())


def sliced(held: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    """A slice of an array as Python takes it."""
    step = 1 if step is None else step

    def taken(held: Column) -> Column:
        n = F.size(held)
        at = lambda p, least, most: F.least(F.greatest(n + p if p < 0 else F.lit(p), least), most)
        if step > 0:
            a = at(start, F.lit(0), n) if start is not None else F.lit(0)
            b = at(stop, F.lit(0), n) if stop is not None else n
            if step == 1:
                return F.slice(held, a + 1, F.greatest(b - a, F.lit(0)))
            return F.filter(held, lambda x, i: (i >= a) & (i < b) & ((i - a) % step == 0))
        a = at(start, F.lit(-1), n - 1) if start is not None else n - 1
        b = at(stop, F.lit(-1), n - 1) if stop is not None else F.lit(-1)
        return F.reverse(F.filter(held, lambda x, i: (i <= a) & (i > b) & ((a - i) % -step == 0)))

    return bound(held, taken)


def chosen(v: Column, at: Names, selector: tuple[str, Any], tail: Names, root: Column) -> Column:
    """A selector's matches at a path from a node, and what the tail leads to from them."""
    kind, value = selector
    by_name = tail and all(k == "name" for k, _ in tail)
    if kind == "name":
        return after(present(F.array(F.try_element_at(reached(v, at, "map<string,variant>"), F.lit(value)))), tail)
    if kind == "index":
        held = fields(v, at, tail) if by_name else elements(v, at)
        one = present(F.array(F.try_element_at(held, F.lit(value if value < 0 else value + 1))))
        return one if by_name else after(one, tail)
    if kind == "slice":
        return present(sliced(F.coalesce(fields(v, at, tail), nothing()), *value)) if by_name else after(sliced(elements(v, at), *value), tail)
    if kind == "wild":
        return F.coalesce(present(fields(v, at, tail)), after(F.map_values(reached(v, at, "map<string,variant>")), tail), nothing()) if by_name else after(children(v, at), tail)
    return filtered(v, at, value, tail, root)


def located(v: Column, at: Names, selectors: Names, tail: Names, root: Column) -> Column:
    """Matches of a segment's selectors at a path from a node, and what the tail leads to from them."""
    parts = [present(F.array(reached(v, (*at, s, *tail)))) if place(s) and (s[0] == "name" or not tail) else chosen(v, at, s, tail, root) for s in selectors]
    return joined(parts)


def matches(v: Column, segments: tuple[Segment, ...], root: Column | None = None) -> Column:
    """All matches of a path from a node, as an array of variants. Names and places in a row are one step, with the segment before them."""
    root = v if root is None else root
    first, rest = led(segments)
    nodes = None
    if not rest:
        return present(F.array(reached(v, first)))
    while rest:
        segment, (tail, rest) = rest[0], led(rest[1:])

        def each(x: Column, at: Names, segment: Segment = segment, tail: Names = tail) -> Column:
            if segment.deep:
                return descended(reached(x, at), lambda y: located(y, (), segment.selectors, tail, root))
            return located(x, at, segment.selectors, tail, root)

        nodes = each(v, first) if nodes is None else spread(nodes, lambda x: each(x, ()))  # noqa: B023
    return nodes


def single_match(v: Column | Shaped, segments: tuple[Segment, ...], root: Column) -> Column:
    """A path's first match; null if there is none."""
    first, rest = led(segments)
    if isinstance(v, Shaped):
        return led_in(v.held, first)
    return F.try_element_at(matches(v, segments, root), F.lit(1)) if rest else reached(v, first)


# ---- filters


def number_of(text: Column) -> Column:
    """A number from a value's JSON, which begins with a digit or a minus; null if it is no number."""
    return F.when((text >= "-") & (text < ":"), text.try_cast("double"))


def operand(tree: tuple, v: Column | Shaped, root: Column) -> Column:
    """A comparable value as a variant; null where it is missing."""
    if tree[0] == "literal":
        return F.try_parse_json(F.lit(json.dumps(tree[1])))
    if tree[0] == "path":
        return single_match(v if tree[1] == "@" else root, tree[2], root)
    if tree[0] == "length":
        inner = operand(tree[1], v, root)
        known = F.to_json(inner)
        long = F.when(F.startswith(known, F.lit('"')), F.length(inner.cast("string"))).when(known.rlike(r"^[\[{]"), F.size(children(inner)))
        return F.try_parse_json(long.cast("string"))
    raise PathError(f"{tree[0]!r} gives no value")


def holds(tree: tuple, v: Column | Shaped, root: Column) -> Column:
    kind = tree[0]
    if kind in ("and", "or"):
        a, b = holds(tree[1], v, root), holds(tree[2], v, root)
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~holds(tree[1], v, root)
    if kind == "holds":
        if tree[1][0] == "path":
            if isinstance(v, Shaped) and tree[1][1] == "@":
                return single_match(v, tree[1][2], root).isNotNull()
            return F.size(matches(v if tree[1][1] == "@" else root, tree[1][2], root)) > 0
        name, of, pattern = tree[1]
        if pattern[0] != "literal" or not isinstance(pattern[1], str):
            raise PathError("a pattern must be a text")
        held = operand(of, v, root)
        found = held.cast("string").rlike(f"^(?:{pattern[1]})$" if name == "match" else pattern[1])
        return F.coalesce(F.startswith(F.to_json(held), F.lit('"')) & found, F.lit(False))
    _, op, left, right = tree
    if left[0] == "literal" and right[0] != "literal":
        op, left, right = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), right, left
    a, b = operand(left, v, root), operand(right, v, root)
    fixed = json.dumps(right[1]) if right[0] == "literal" and (not isinstance(right[1], str) or right[1].isascii() and right[1].isprintable()) else None
    numeric = fixed is not None and isinstance(right[1], (int, float)) and not isinstance(right[1], bool)
    if op in ("==", "!=") and fixed is not None and not numeric:
        same = F.coalesce(F.to_json(a) == F.lit(fixed), F.lit(False))
        return same if op == "==" else ~same
    if numeric:  # only numbers compare with a number
        y = F.lit(float(right[1]))
        held = {"==": lambda x: x == y, "!=": lambda x: x != y, "<": lambda x: x < y, ">": lambda x: x > y, "<=": lambda x: x <= y, ">=": lambda x: x >= y}[op]
        return F.coalesce(bound(F.to_json(a), lambda t: held(number_of(t))), F.lit(op == "!="))
    both = F.struct(F.to_json(a).alias("x"), (F.lit(fixed) if fixed is not None else F.to_json(b)).alias("y"))

    def told(s: Column) -> Column:
        x, y = number_of(s["x"]), number_of(s["y"])
        texts = F.startswith(s["x"], F.lit('"')) & F.startswith(s["y"], F.lit('"'))
        same = F.coalesce(x == y, s["x"].eqNullSafe(s["y"]))
        less = F.coalesce(x < y, texts & (a.cast("string") < b.cast("string")), F.lit(False))
        more = F.coalesce(x > y, texts & (a.cast("string") > b.cast("string")), F.lit(False))
        return {"==": same, "!=": ~same, "<": less, ">": more, "<=": less | same, ">=": more | same}[op]

    return bound(both, told)


# ---- what templates show


def unescaped(t: Column) -> Column:
    """What a JSON string holds."""
    easy = F.substring(t, F.lit(2), F.length(t) - 2)
    return F.when(F.contains(t, F.lit("\\")), F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]).otherwise(easy)


def plain(t: Column) -> Column:
    """A match as text: texts as they are, else JSON."""
    return F.when(F.startswith(t, F.lit('"')), unescaped(t)).otherwise(t)


TOKENS = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+'


def word(t: Column) -> Column:
    """One token of JSON as Python shows it."""

    def quoted(held: Column) -> Column:
        held = F.replace(held, F.lit("\\"), F.lit("\\\\"))
        for old, new in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            held = F.replace(held, F.lit(old), F.lit(new))
        double = F.contains(held, F.lit("'")) & ~F.contains(held, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), held, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(held, F.lit("'"), F.lit("\\'")), F.lit("'")))

    easy = F.concat(F.lit("'"), F.substring(t, F.lit(2), F.length(t) - 2), F.lit("'"))
    words = F.when(t == ",", ", ").when(t == ":", ": ").when(t == "true", "True").when(t == "false", "False").when(t == "null", "None")
    text = F.when(t.rlike(r"[\\']"), bound(unescaped(t), quoted)).otherwise(easy)
    return F.when(F.startswith(t, F.lit('"')), text).otherwise(F.coalesce(words, t))


def shown(t: Column) -> Column:
    """A match as Python shows the value within a list."""
    parts = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(TOKENS), F.lit(0)), lambda x: word(x)), "")
    return F.when(t.rlike(r"^[\[{]"), parts).otherwise(word(t))


#: A JSON list of numbers and of texts without commas, quotes and escapes, which Python shows with other quotes and spaces alone.
EASY = r"^\[(?:(?:\"[^\"\\',]*+\"|-?+[0-9.]++),?+)*+\]$"


def listed(found: Column) -> Column:
    """Matches as Python shows a list of them."""
    easy = lambda t: F.replace(F.replace(t, F.lit('"'), F.lit("'")), F.lit(","), F.lit(", "))
    hard = lambda f: F.concat(F.lit("["), F.array_join(F.transform(f, lambda v: bound(F.to_json(v), shown)), ", "), F.lit("]"))
    return bound(found, lambda f: bound(F.to_json(f), lambda t: F.when(t.rlike(EASY), easy(t)).otherwise(hard(f))))

"""Random draws as pure functions of (seed, column, draw, row).

A draw never depends on how rows are dealt to tasks, on retries or on what was
made before, so a dataset can be made in any order, in parts, and again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2**31 - 1


def salts(seed: int, column: str, draw: int | str = 0) -> tuple[int, int, int]:
    digest = hashlib.sha256(f"{seed}|{column}|{draw}".encode()).digest()
    return tuple(int.from_bytes(digest[8 * i : 8 * i + 8], "big") % MODULUS for i in range(3))


def uniform(seed: int, column: str, row: Column | str, draw: int | str = 0) -> Column:
    """A double in (0, 1) for each row: four rounds of multiplying and folding modulo 2^31 - 1, all within codegen."""
    return mixed(row, *(F.lit(s).cast("long") for s in salts(seed, column, draw)))


def mixed(row: Column | str, s0: Column, s1: Column, s2: Column, bound: bool = False) -> Column:
    """The same by salts that are columns. Each fold reads its value twice, which generated code computes once; within a lambda,
    which is interpreted, ``bound`` holds it so that it isn't computed again."""
    row = F.col(row) if isinstance(row, str) else row
    m = F.lit(MODULUS).cast("long")

    def fold(h: Column, bits: int) -> Column:
        mix = lambda x: x.bitwiseXOR(F.shiftright(x, bits))
        return F.get(F.transform(F.array(h), mix), F.lit(0)) if bound else mix(h)

    row = row.cast("long")
    far = F.floor(row / m).cast("long") % m  # rows beyond the modulus get other salts
    h = ((row % m) * F.lit(48271).cast("long") + s0 + far * F.lit(7919).cast("long")) % m
    h = (fold(h, 13) * F.lit(69621).cast("long") + s1) % m
    h = (fold(h, 16) * F.lit(1664525).cast("long") + s2) % m
    h = (fold(h, 15) * F.lit(39373).cast("long")) % m
    return (h + F.lit(0.5)) / F.lit(float(MODULUS))


def index(u: Column, n: int) -> Column:
    """A uniform place from 0 to n - 1."""
    return F.floor(u * F.lit(float(n))).cast("int")


def rank_key(seed: int, name: str, *parts: Column) -> Column:
    """A text key whose order is a random order of the rows."""
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), *(p.cast("string") for p in parts)))


def bound(of: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once. Within lambdas nothing else keeps it from being worked out at each use, and
    elsewhere it keeps expressions from growing by all their uses."""
    return F.get(F.transform(F.array(of), lambda x: then(x)), F.lit(0))


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """Walker's tables: for each place the chance to stay there, and where to go else. One draw of any weights is then one look-up."""
    n, total = len(weights), float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be 0 or more and not all 0")
    left = [w * n / total for w in weights]
    stay, other = [1.0] * n, list(range(n))
    small, large = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    while small and large:
        a, b = small.pop(), large[-1]
        stay[a], other[a] = left[a], b
        left[b] -= 1 - left[a]
        if left[b] < 1:
            small.append(large.pop())
    return stay, other


class Conditional:
    """Values with weights by a key, each key's as Walker's tables in one map literal of bounded size; other keys give null."""

    def __init__(self, groups: dict[str, dict[str, float]]) -> None:
        self.groups = {}
        for key, weights in groups.items():
            values = list(weights)
            stay, other = alias_table(list(weights.values()))
            self.groups[key] = values, stay, [values[i] for i in other]

    def column(self, key: Column, u: Column) -> Column:
        told = json.dumps({k: dict(zip(("value", "stay", "other"), held, strict=True)) for k, held in self.groups.items()})
        held = F.from_json(F.lit(told), "map<string, struct<value: array<string>, stay: array<double>, other: array<string>>>")  # folded to one literal

        def drawn(t: Column) -> Column:
            x = u * F.size(t["value"])
            i = F.floor(x).cast("int")
            return F.when(x - i < F.get(t["stay"], i), F.get(t["value"], i)).otherwise(F.get(t["other"], i))

        return bound(F.try_element_at(held, key), drawn)

    def sql(self, key: str, u: str) -> str:
        text = lambda x: "'" + x.replace("'", "''") + "'"
        row = lambda v, s, o: f"{{'value': [{', '.join(map(text, v))}], 'stay': [{', '.join(f'{x!r}::DOUBLE' for x in s)}], 'other': [{', '.join(map(text, o))}]}}"
        held = f"MAP {{{', '.join(f'{text(k)}: {row(*x)}' for k, x in self.groups.items())}}}[{key}]"
        at = lambda part: f"list_extract(t.{part}, CAST(floor(x) AS INT) + 1)"
        return f"(SELECT CASE WHEN x - floor(x) < {at('stay')} THEN {at('value')} ELSE {at('other')} END FROM (SELECT t, ({u}) * len(t.value) AS x FROM (SELECT {held} AS t)))"

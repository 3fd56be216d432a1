"""The samplers: each turns parameters into one native column over a row id.

Every sampler is a pure projection. Distributions are computed from one uniform
draw by their inverse, closed or from a table (``functions.laws``); discrete ones by
their cumulative array; a Gaussian from two draws. Two named distributions without
either are drawn by numpy in an Arrow function seeded by the row id.

Values within constraints are drawn again and again as the sampler does and, where
those all fail, once from what the constraints leave of the distribution, so however
little they leave no row is without a value.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import laws
from weftline.functions.draws import MODULUS, index, mixed, salts, uniform

UNITS = {"Y": "YEAR", "M": "MONTH", "D": "DAY", "h": "HOUR", "m": "MINUTE", "s": "SECOND"}


@dataclass(frozen=True)
class Draw:
    """Where a sampler draws from: the seed, the column's name, the row id and the number of the try."""

    seed: int
    column: str
    row: Column
    attempt: int = 0

    def u(self, part: str = "") -> Column:
        return uniform(self.seed, self.column, self.row, f"{self.attempt}{part}" if self.attempt or part else 0)


@dataclass(frozen=True)
class Tried(Draw):
    """One of several tries, whose place among ``attempts`` is a column; it draws what ``Draw`` does of that try."""

    attempts: tuple[int, ...] = ()
    place: Column | None = None

    def u(self, part: str = "") -> Column:
        held = zip(*(salts(self.seed, self.column, f"{k}{part}" if k or part else 0) for k in self.attempts), strict=True)
        return mixed(self.row, *(F.get(F.array(*(F.lit(s).cast("long") for s in some)), self.place) for some in held), bound=True)


Sampler = Callable[[dict[str, Any], Draw], Column]
SAMPLERS: dict[str, Sampler] = {}


class SamplerError(ValueError):
    pass


def sampler(name: str, needs: tuple[str, ...] = ()) -> Callable[[Sampler], Sampler]:
    def add(f: Sampler) -> Sampler:
        def made(params: dict[str, Any], draw: Draw) -> Column:
            if missing := [p for p in needs if params.get(p) is None]:
                raise SamplerError(f"sampler {name!r} needs {', '.join(missing)}")
            return f(params, draw)

        SAMPLERS[name] = made
        return made

    return add


def literals(values: list) -> Column:
    """An array of the values; mixed kinds become text, as one column has one type."""
    kinds = {type(v) for v in values}
    if kinds <= {int, float} and len(kinds) > 1:
        values = [float(v) for v in values]
    elif len(kinds) > 1:
        values = [str(v) for v in values]
    return F.array(*map(F.lit, values))


def cumulative(weights: list[float]) -> list[float]:
    total, run, out = float(sum(weights)), 0.0, []
    if total <= 0 or any(w < 0 for w in weights):
        raise SamplerError("weights must be 0 or more and not all 0")
    for w in weights:
        run += w / total
        out.append(run)
    return out


def pick(u: Column, values: list, weights: list[float] | None) -> Column:
    if not values:
        raise SamplerError("there must be a value to pick")
    held = literals(values)
    if weights is None:
        return F.element_at(held, index(u, len(values)) + 1)
    if len(weights) != len(values):
        raise SamplerError("there must be as many weights as values")
    out = F.element_at(held, len(values))
    for i, edge in reversed(list(enumerate(cumulative(weights)[:-1]))):
        out = F.when(u < edge, F.element_at(held, i + 1)).otherwise(out)
    return out


def by_cdf(u: Column, cdf: list[float]) -> Column:
    """How many of the ascending cumulative chances are at most u: a discrete inverse."""
    return F.size(F.filter(F.array(*map(F.lit, cdf)), lambda c: c <= u)).cast("long")


@sampler("category", ("values",))
def category(p: dict[str, Any], d: Draw) -> Column:
    return pick(d.u(), p["values"], p.get("weights"))


@sampler("subcategory", ("category", "values"))
def subcategory(p: dict[str, Any], d: Draw) -> Column:
    if any(not v for v in p["values"].values()):
        raise SamplerError("each value of the parent needs subcategories")
    held = F.create_map(*(x for k, v in p["values"].items() for x in (F.lit(k), literals(v))))
    some = F.try_element_at(held, F.col(p["category"]))
    return F.try_element_at(some, F.floor(d.u() * F.size(some)).cast("int") + 1)


@sampler("uniform", ("low", "high"))
def uniform_(p: dict[str, Any], d: Draw) -> Column:
    return F.lit(float(p["low"])) + F.lit(float(p["high"]) - float(p["low"])) * d.u()


def normal(d: Draw) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(d.u())) * F.cos(F.lit(2 * math.pi) * d.u("b"))


@sampler("gaussian", ("mean", "stddev"))
def gaussian(p: dict[str, Any], d: Draw) -> Column:
    return F.lit(float(p["mean"])) + F.lit(float(p["stddev"])) * normal(d)


def chance(p: Any) -> float:
    if not 0 <= float(p) <= 1:
        raise SamplerError("p must lie between 0 and 1")
    return float(p)


@sampler("bernoulli", ("p",))
def bernoulli(p: dict[str, Any], d: Draw) -> Column:
    return (d.u() < chance(p["p"])).cast("long")


@sampler("bernoulli_mixture", ("p", "dist_name"))
def bernoulli_mixture(p: dict[str, Any], d: Draw) -> Column:
    inner = distribution(p["dist_name"], p.get("dist_params") or {}, Draw(d.seed, f"{d.column}|mixture", d.row, d.attempt))
    return F.when(d.u() < chance(p["p"]), inner.cast("double")).otherwise(F.lit(0.0))


def binomial_cdf(n: int, p: float) -> list[float]:
    out, run = [], 0.0
    for k in range(n):
        run += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        out.append(run)
    return out


@sampler("binomial", ("n", "p"))
def binomial(p: dict[str, Any], d: Draw) -> Column:
    return by_cdf(d.u(), binomial_cdf(int(p["n"]), chance(p["p"])))


def poisson_cdf(mean: float) -> list[float]:
    out, run, term = [], 0.0, math.exp(-mean)
    for k in range(int(mean + 12 * math.sqrt(mean) + 20)):
        run += term
        out.append(run)
        term *= mean / (k + 1)
    return out


@sampler("poisson", ("mean",))
def poisson(p: dict[str, Any], d: Draw) -> Column:
    return by_cdf(d.u(), poisson_cdf(float(p["mean"])))


#: Inverse distribution functions of scipy's names, standard form (shapes as named there).
INVERSE: dict[str, Callable[[Draw, dict[str, Any]], Column]] = {
    "uniform": lambda d, s: d.u(),
    "expon": lambda d, s: -F.log(d.u()),
    "norm": lambda d, s: normal(d),
    "logistic": lambda d, s: F.log(d.u() / (1 - d.u())),
    "laplace": lambda d, s: F.when(d.u() < 0.5, F.log(2 * d.u())).otherwise(-F.log(2 - 2 * d.u())),
    "cauchy": lambda d, s: F.tan(F.lit(math.pi) * (d.u() - 0.5)),
    "gumbel_r": lambda d, s: -F.log(-F.log(d.u())),
    "gumbel_l": lambda d, s: F.log(-F.log(d.u())),
    "rayleigh": lambda d, s: F.sqrt(F.lit(-2.0) * F.log(d.u())),
    "weibull_min": lambda d, s: F.pow(-F.log(d.u()), F.lit(1 / s["c"])),
    "pareto": lambda d, s: F.pow(d.u(), F.lit(-1 / s["b"])),
    "lognorm": lambda d, s: F.exp(F.lit(float(s["s"])) * normal(d)),
    "powerlaw": lambda d, s: F.pow(d.u(), F.lit(1 / s["a"])),
    "triang": lambda d, s: F.when(d.u() < s["c"], F.sqrt(d.u() * s["c"])).otherwise(1 - F.sqrt((1 - d.u()) * (1 - s["c"]))),
}
#: Shapes that numpy's generator takes, by scipy's names.
NUMPY_NAMES = {"vonmises": ("vonmises", ("loc", "kappa")), "zipf": ("zipf", ("a",))}


def cumulated(chances: list[float]) -> list[float]:
    """Cumulative chances without the last, which is 1."""
    out, run = [], 0.0
    for c in chances[:-1]:
        run += c
        out.append(run)
    return out


def nbinom_cdf(n: float, p: float) -> list[float]:
    """Failures before ``n`` successes, to where less than 1e-12 is left or 20,000."""
    out, run, k = [], 0.0, 0
    while run < 1 - 1e-12 and k < 20_000:
        run += math.exp(math.lgamma(n + k) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + (k * math.log1p(-p) if k else 0.0))
        out.append(run)
        k += 1
    return out


def hypergeom_cdf(total: int, marked: int, drawn: int) -> list[float]:
    """Marked ones among ``drawn`` of ``total``."""
    few, many = max(0, drawn - (total - marked)), min(drawn, marked)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return [0.0] * few + cumulated([math.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn)) for k in range(few, many + 1)])


#: Cumulative chances of discrete distributions from 0 on, by scipy's names and shapes.
DISCRETE: dict[str, Callable[[dict[str, Any]], list[float]]] = {
    "bernoulli": lambda s: [1 - chance(s["p"])],
    "binom": lambda s: binomial_cdf(int(s["n"]), chance(s["p"])),
    "poisson": lambda s: poisson_cdf(float(s["mu"])),
    "nbinom": lambda s: nbinom_cdf(float(s["n"]), chance(s["p"])),
    "hypergeom": lambda s: hypergeom_cdf(int(s["M"]), int(s["n"]), int(s["N"])),
}


def parted(params: dict[str, Any]) -> tuple[dict[str, Any], float, float]:
    """Shapes, location and scale."""
    return {k: v for k, v in params.items() if k not in ("loc", "scale")}, float(params.get("loc", 0)), float(params.get("scale", 1))


def distribution(name: str, params: dict[str, Any], d: Draw) -> Column:
    shapes, loc, scale = parted(params)
    if name == "geom":
        return (F.ceil(F.log(d.u()) / F.lit(math.log(1 - shapes["p"]))) + F.lit(int(loc))).cast("long")
    if name == "randint":
        return (F.floor(d.u() * F.lit(float(shapes["high"] - shapes["low"]))) + F.lit(int(shapes["low"] + loc))).cast("long")
    if name == "bernoulli":
        return (d.u() < chance(shapes["p"])).cast("long")
    if name in DISCRETE:
        return by_cdf(d.u(), DISCRETE[name](shapes))
    if name in INVERSE:
        return F.lit(loc) + F.lit(scale) * INVERSE[name](d, shapes)
    if name in NUMPY_NAMES:
        return F.lit(loc) + F.lit(scale) * numpy_draw(name, shapes, d)
    try:
        return F.lit(loc) + F.lit(scale) * laws.law(name, shapes).quantile(laws.logit(d.u()))
    except laws.LawError as e:
        raise SamplerError(str(e)) from None


def numpy_draw(name: str, shapes: dict[str, Any], d: Draw) -> Column:
    method, order = NUMPY_NAMES[name]
    args, seed = [float(shapes[k]) for k in order], salts(d.seed, d.column, d.attempt)[0]

    @F.pandas_udf(T.DoubleType())
    def drawn(rows: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([float(getattr(np.random.Generator(np.random.PCG64([seed, int(r)])), method)(*args)) for r in rows])

    return drawn(d.row)


@sampler("scipy", ("dist_name",))
def scipy(p: dict[str, Any], d: Draw) -> Column:
    return distribution(p["dist_name"], p.get("dist_params") or {}, d)


@sampler("uuid")
def uuid(p: dict[str, Any], d: Draw) -> Column:
    text = F.md5(F.concat_ws("|", F.lit(f"{d.seed}|{d.column}|{d.attempt}"), d.row.cast("string")))
    if p.get("short_form"):
        text = F.substring(text, 1, 8)
    if p.get("uppercase"):
        text = F.upper(text)
    return F.concat(F.lit(p["prefix"]), text) if p.get("prefix") else text


def seconds_of(value: Any) -> int:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return int((value if value.tzinfo else value.replace(tzinfo=dt.UTC)).timestamp())


@sampler("datetime", ("start", "end"))
def datetime_(p: dict[str, Any], d: Draw) -> Column:
    start, end = seconds_of(p["start"]), seconds_of(p["end"])
    if end <= start:
        raise SamplerError("the end must come after the start")
    at = F.timestamp_seconds(F.lit(start) + F.floor(d.u() * F.lit(float(end - start))).cast("long"))
    return F.date_trunc(UNITS[p.get("unit", "D")], at)


@sampler("timedelta", ("dt_min", "dt_max", "reference_column_name"))
def timedelta(p: dict[str, Any], d: Draw) -> Column:
    low, high = int(p["dt_min"]), int(p["dt_max"])
    if low >= high:
        raise SamplerError("dt_min must be less than dt_max")
    unit = {"D": 86400, "h": 3600, "m": 60, "s": 1}[p.get("unit", "D")]
    step = (F.lit(low) + F.floor(d.u() * F.lit(float(high - low))).cast("long")) * F.lit(unit)
    ref = F.col(p["reference_column_name"]).cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(ref) + step)


# strftime's directives and Spark's patterns. Fixed values.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD", "f": "SSSSSS", "%": "%"}


def date_pattern(strftime: str) -> str:
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            code = strftime[i + 1]
            if code not in STRFTIME:
                raise SamplerError(f"the directive %{code} has no Spark pattern")
            out += STRFTIME[code]
            i += 2
        else:
            c = strftime[i]
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return out


def converted(column: Column, kind: str, to: str | None) -> Column:
    """``convert_to``: numbers to int (rounded half to even), float or str; dates to text, ISO unless a format is given."""
    if kind in ("datetime", "timedelta"):
        return F.date_format(column, date_pattern(to) if to else "yyyy-MM-dd'T'HH:mm:ss")
    if to is None:
        return column
    if to == "int":
        return F.rint(column.cast("double")).cast("long")
    return column.cast({"float": "double", "str": "string"}[to])


@dataclass
class SamplerSpec:
    """A sampler column: its kind and parameters, further parameters by condition, conversion and rounding."""

    name: str
    kind: str
    params: dict[str, Any]
    conditional_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    convert_to: str | None = None

    @property
    def by_numpy(self) -> bool:
        """Whether Arrow functions draw it, which can't stand within a lambda."""
        return any(p.get("dist_name") in NUMPY_NAMES for p in (self.params, *self.conditional_params.values()))

    def one(self, params: dict[str, Any], draw: Draw) -> Column:
        if self.kind not in SAMPLERS:
            raise SamplerError(f"no sampler is named {self.kind!r}")
        return SAMPLERS[self.kind](params, draw)

    def column(self, draw: Draw, condition: Callable[[str], Column]) -> Column:
        """Drawn by the parameters of the last condition that holds, or the default ones."""
        out = self.one(self.params, draw)
        for text, params in self.conditional_params.items():  # a later one overrides
            out = F.when(condition(text), self.one(params, draw)).otherwise(out)
        return out

    def finished(self, column: Column) -> Column:
        """Rounding comes last, after constraints were checked on what was drawn."""
        out = converted(column, self.kind, self.convert_to)
        places = self.params.get("decimal_places")
        return F.bround(out.cast("double"), int(places)) if places is not None and self.convert_to != "str" else out


# ---- constraints

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
TRIES = 32
#: The first draw is generated code; rows that it fails make the others in groups, each only if those before all fail. They stand in
#: lambdas, as code for each of 32 draws is more than the JVM compiles.
GROUPS = ((1, 3), (3, 8), (8, TRIES))
#: Kinds whose draws are functions of uniform draws alone, so that tries may stand in lambdas.
BY_UNIFORM = ("category", "subcategory", "uniform", "gaussian", "bernoulli", "bernoulli_mixture", "binomial", "poisson", "scipy", "datetime", "timedelta")
#: Further draws of rows that are left, in stages; only rows that failed all earlier ones make them.
FURTHER = (1 << 10, 1 << 16)
#: Kinds that make structs of people, by another module.
SEEDLESS_KINDS = ("person", "person_from_faker")


@dataclass(frozen=True)
class Constraint:
    """``target`` compared with a number, or with another sampler column."""

    target: str
    operator: str
    rhs: float | str

    @property
    def scalar(self) -> float | None:
        try:
            x = float(self.rhs)
        except ValueError:
            return None
        return x if math.isfinite(x) else None

    def holds(self, value: Column) -> Column:
        rhs = F.lit(self.scalar) if self.scalar is not None else F.col(str(self.rhs))
        return OPERATORS[self.operator](value, rhs)


def constrained(draws: Callable[[int], Column], constraints: list[Constraint], tries: int = TRIES, further: Callable[[Column], Column] | None = None, exact: list[Column] = (), tried: Callable[[tuple[int, ...], Column], Column] | None = None, as_checked: Callable[[Column], Column] = lambda x: x) -> Column:
    """The first of ``tries`` draws that meets all constraints, then of ``FURTHER`` ones, whose number is a column, then of ``exact``,
    draws of the distribution within the constraints where that is known; null if none does.

    ``tried`` gives a draw of several tries by its place among them, a column. Later groups of draws are made only for rows whose
    earlier ones all failed. ``as_checked`` is what a draw is when it is held against the constraints.
    """
    if not constraints:
        return draws(0)

    def good(x: Column) -> Column:
        return met(as_checked(x), constraints)

    def group(start: int, stop: int) -> Column:
        if tried is None:
            return F.array(*(draws(k) for k in range(start, stop)))
        return F.transform(F.sequence(F.lit(0), F.lit(stop - start - 1)), lambda i: tried(tuple(range(start, stop)), i))

    held, at = [group(a, min(b, tries)) for a, b in GROUPS if a < tries], 1
    for n in FURTHER if further else ():
        held.append(F.transform(F.sequence(F.lit(at).cast("long"), F.lit(at + n - 1).cast("long")), lambda k: further(k)))
        at += n
    first = draws(0)
    last = [F.try_element_at(F.filter(F.array(*exact), good), F.lit(1))] if exact else []
    return F.coalesce(F.when(good(first), first), *(F.try_element_at(F.filter(x, good), F.lit(1)) for x in held), *last)


def met(value: Column, constraints: list[Constraint]) -> Column:
    out = F.lit(True)
    for c in constraints:
        out = out & c.holds(value)
    return out


def redrawn(spec: SamplerSpec, draw: Draw, constraints: list[Constraint], condition: Callable[[str], Column]) -> Column:
    """A sampler's column within its constraints, by all the ways that its kind allows. Whole numbers are rounded before they are
    held against constraints, other rounding comes after."""
    one = lambda d: spec.column(d, condition)
    at = lambda k: Draw(draw.seed, draw.column, draw.row, k)
    as_checked = (lambda x: F.rint(x.cast("double"))) if spec.convert_to == "int" and spec.kind not in ("datetime", "timedelta") else (lambda x: x)
    if spec.by_numpy:  # Arrow functions can't stand within a lambda
        return constrained(lambda k: one(at(k)), constraints, as_checked=as_checked)
    tried = (lambda attempts, i: one(Tried(draw.seed, draw.column, draw.row, 0, attempts, i))) if spec.kind in BY_UNIFORM else None
    exact = truncated(spec, at(TRIES), constraints, condition) if constraints else None
    further = None if exact else lambda k: one(Draw(draw.seed, draw.column, draw.row + k * F.lit(MODULUS).cast("long"), TRIES))
    return constrained(lambda k: one(at(k)), constraints, further=further, exact=exact or [], tried=tried, as_checked=as_checked)


# ---- draws from what constraints leave


@dataclass(frozen=True)
class Limits:
    """What constraints say of a value: the greatest lower and the least upper bound, null columns where there is none."""

    constraints: list[Constraint]

    def most(self, operators: tuple[str, str], of: dict[str, Callable[[Column], Column]], pick: Callable[..., Column]) -> Column | None:
        held = [of[c.operator](F.lit(c.scalar) if c.scalar is not None else F.col(str(c.rhs)).cast("double")) for c in self.constraints if c.operator in operators]
        return None if not held else held[0] if len(held) == 1 else pick(*held)

    @property
    def low(self) -> Column | None:
        return self.most(("gt", "ge"), {"gt": lambda x: x, "ge": lambda x: x}, F.greatest)

    @property
    def high(self) -> Column | None:
        return self.most(("lt", "le"), {"lt": lambda x: x, "le": lambda x: x}, F.least)

    @property
    def least(self) -> Column | None:
        """The least whole number within."""
        return self.most(("gt", "ge"), {"gt": lambda x: F.floor(x) + 1.0, "ge": lambda x: F.ceil(x).cast("double")}, F.greatest)

    @property
    def greatest(self) -> Column | None:
        return self.most(("lt", "le"), {"lt": lambda x: F.ceil(x) - 1.0, "le": lambda x: F.floor(x).cast("double")}, F.least)


def continuous(of: laws.Law, loc: float, scale: float, limits: Limits, whole: bool, u: Column) -> list[Column]:
    """Within the limits, or, if ``whole``, rounding to a whole number within them."""
    low, high = (limits.least, limits.greatest) if whole else (limits.low, limits.high)
    if whole:  # half a unit either way, less what a tie might round away
        low, high = None if low is None else low - 0.4999999, None if high is None else high + 0.4999999
    inner = [None if x is None else (x - F.lit(loc)) / F.lit(scale) for x in ((low, high) if scale > 0 else (high, low))]
    out = F.lit(loc) + F.lit(scale) * laws.between(of, *inner, u)
    kept = F.least(F.greatest(out, low) if low is not None else out, high) if high is not None else F.greatest(out, low)
    # Where rounding leaves a draw at an open bound, a value beside it.
    ends = [x for x in (low, high, (low + high) / 2 if low is not None and high is not None else None) if x is not None]
    beside = [y for x in ends for y in (x, x + F.abs(x) * 2.0**-50 + 1e-300, x - F.abs(x) * 2.0**-50 - 1e-300)]
    feasible = laws.reaches(of, *inner) if low is None or high is None else (low <= high) & laws.reaches(of, *inner)
    return [F.when(feasible, x) for x in (kept, *beside)]


#: Discrete distributions without an end, whose chances are told up to some number only.
ENDLESS = ("poisson", "nbinom")


def whole_numbers(cdf: list[float], limits: Limits, u: Column, endless: bool = False) -> list[Column]:
    """Of a discrete distribution from 0 on. Of one that is ``endless``, where no chance that is told lies within the limits, the
    least number within them."""
    held, n = F.array(*map(F.lit, cdf)), len(cdf)

    def below(k: Column) -> Column:
        return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).otherwise(F.get(held, F.least(k, F.lit(float(n))).cast("int")))

    low = F.greatest(limits.least, F.lit(0.0)) if limits.least is not None else F.lit(0.0)
    high = F.least(limits.greatest, F.lit(float(n))) if limits.greatest is not None else F.lit(float(n))
    p, q = below(low - 1), below(high)
    k = by_cdf(p + (q - p) * u, cdf).cast("double")
    out = [F.when((low <= high) & (q > p), F.least(F.greatest(k, low), high)).cast("long")]
    return [*out, F.when(q <= p, low).cast("long")] if endless else out


def kept_values(values: list, weights: list[float] | None, constraints: list[Constraint], u: Column) -> list[Column] | None:
    """Of a list of numbers with weights, one of those that fit."""
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return None
    held = literals(values)
    rows = F.filter(F.arrays_zip(held.alias("v"), F.array(*(F.lit(float(w)) for w in weights or [1.0] * len(values))).alias("w")), lambda x: met(x["v"], constraints) & (x["w"] > 0))
    total = F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["w"])
    v = F.get(held, F.lit(0))
    start = F.struct((u * total).alias("left"), F.nullif(v, v).alias("v"))
    picked = F.aggregate(rows, start, lambda s, x: F.struct((s["left"] - x["w"]).alias("left"), F.coalesce(s["v"], F.when(s["left"] <= x["w"], x["v"])).alias("v")))
    return [picked["v"], F.try_element_at(rows, F.lit(-1))["v"]]


def moments_of(unit: str, constraints: list[Constraint], start: int, end: int, u: Column) -> list[Column]:
    """A moment, cut to its unit, from the seconds whose cut moments fit."""
    low, high = [F.lit(start).cast("long")], [F.lit(end).cast("long")]
    for c in constraints:
        at = F.col(str(c.rhs)).cast("timestamp")
        floor = F.date_trunc(unit, at)
        after = floor + F.expr(f"INTERVAL 1 {unit}")
        bound = after if c.operator in ("gt", "le") else F.when(floor == at, at).otherwise(after)
        (low if c.operator in ("gt", "ge") else high).append(F.unix_timestamp(bound))
    a, b = F.greatest(*low) if len(low) > 1 else low[0], F.least(*high) if len(high) > 1 else high[0]
    return [F.when(a < b, F.date_trunc(unit, F.timestamp_seconds(a + F.floor(u * (b - a).cast("double")).cast("long"))))]


def steps_of(p: dict[str, Any], constraints: list[Constraint], u: Column) -> list[Column]:
    """A moment some steps after another one, of the steps that fit."""
    unit = {"D": 86400, "h": 3600, "m": 60, "s": 1}[p.get("unit", "D")]
    ref = F.unix_timestamp(F.col(p["reference_column_name"]).cast("timestamp"))
    low, high = [F.lit(int(p["dt_min"])).cast("double")], [F.lit(int(p["dt_max"]) - 1).cast("double")]
    for c in constraints:
        k = (F.col(str(c.rhs)).cast("timestamp").cast("double") - ref) / F.lit(float(unit))
        (low if c.operator in ("gt", "ge") else high).append({"gt": lambda k: F.floor(k) + 1.0, "ge": lambda k: F.ceil(k).cast("double"), "lt": lambda k: F.ceil(k) - 1.0, "le": lambda k: F.floor(k).cast("double")}[c.operator](k))
    a, b = F.greatest(*low) if len(low) > 1 else low[0], F.least(*high) if len(high) > 1 else high[0]
    return [F.when(a <= b, F.timestamp_seconds(ref + (a + F.floor(u * (b - a + 1))).cast("long") * F.lit(unit)))]


def named_within(name: str, params: dict[str, Any], limits: Limits, whole: bool, u: Column) -> list[Column] | None:
    """Draws of a named distribution within the limits."""
    shapes, loc, scale = parted(params)
    if name in DISCRETE:
        return whole_numbers(DISCRETE[name](shapes), limits, u, name in ENDLESS)
    if name in ("geom", "randint"):
        low, high = limits.least, limits.greatest
        low = F.lit(-1e300) if low is None else low - int(loc)
        if name == "randint":
            a, b = F.greatest(low, F.lit(float(shapes["low"]))), F.lit(float(shapes["high"] - 1))
            b = b if high is None else F.least(high - int(loc), b)
            return [F.when(a <= b, a + F.floor(u * (b - a + 1)) + int(loc)).cast("long")]
        rate = math.log(1 - shapes["p"])
        a = F.greatest(low, F.lit(1.0))
        left = F.lit(1.0) if high is None else -F.expm1(rate * (high - int(loc) - a + 1))  # of what lies from a on
        k = a + F.greatest(F.ceil(F.log1p(-u * left) / rate) - 1, F.lit(0))
        k = k if high is None else F.when(a <= high - int(loc), F.least(k, high - int(loc)))
        return [(k + int(loc)).cast("long")]
    if name in NUMPY_NAMES or scale == 0:
        return None
    return continuous(laws.law(name, shapes), loc, scale, limits, whole, u)


def within(kind: str, p: dict[str, Any], constraints: list[Constraint], whole: bool, draw: Draw) -> list[Column] | None:
    """Candidates, the likely one first, from what the constraints leave of a sampler's distribution; null where that isn't known."""
    limits, u = Limits(constraints), draw.u("truncated")
    if kind == "uniform":
        width = float(p["high"]) - float(p["low"])
        return continuous(laws.law("uniform", {}), float(p["low"]), width, limits, whole, u) if width else None
    if kind == "gaussian":
        return continuous(laws.norm(), float(p["mean"]), float(p["stddev"]), limits, whole, u) if p["stddev"] else None
    if kind == "scipy":
        return named_within(p["dist_name"], p.get("dist_params") or {}, limits, whole, u)
    if kind in ("bernoulli", "binomial", "poisson"):
        name = {"bernoulli": "bernoulli", "binomial": "binom", "poisson": "poisson"}[kind]
        return whole_numbers(DISCRETE[name](p | {"mu": p.get("mean")}), limits, u, name in ENDLESS)
    if kind == "bernoulli_mixture":
        return mixture_within(p, constraints, limits, whole, draw)
    if kind == "category":
        return kept_values(p["values"], p.get("weights"), constraints, u)
    if kind in ("datetime", "timedelta") and all(c.scalar is None for c in constraints):
        return moments_of(UNITS[p.get("unit", "D")], constraints, seconds_of(p["start"]), seconds_of(p["end"]), u) if kind == "datetime" else steps_of(p, constraints, u)
    return None


def mixture_within(p: dict[str, Any], constraints: list[Constraint], limits: Limits, whole: bool, draw: Draw) -> list[Column] | None:
    """Zero, or a draw of the inner distribution, by what the constraints leave of either."""
    name, params = p["dist_name"], p.get("dist_params") or {}
    shapes, loc, scale = parted(params)
    inner = named_within(name, params, limits, whole, draw.u("truncated"))
    if inner is None:
        return None
    zero = F.lit(0.0)
    if name not in laws.LAWS:  # no chance of a range is told: zero where it may be, else the inner draw
        return [F.when(met(zero, constraints), zero), *(x.cast("double") for x in inner)]
    low, high = (limits.least, limits.greatest) if whole else (limits.low, limits.high)
    ends = [None if x is None else (x - F.lit(loc)) / F.lit(scale) for x in ((low, high) if scale > 0 else (high, low))]
    ones = chance(p["p"]) * laws.mass(laws.law(name, shapes), *ends)
    nothing = F.when(met(zero, constraints), F.lit(1 - chance(p["p"]))).otherwise(zero)
    return [F.when(draw.u("which") * (ones + nothing) < nothing, zero).otherwise(inner[0]), *inner, zero]


def truncated(spec: SamplerSpec, draw: Draw, constraints: list[Constraint], condition: Callable[[str], Column]) -> list[Column] | None:
    """The candidates of ``within`` by the parameters that each row's conditions choose; null if they aren't known for all."""
    whole = spec.convert_to == "int"
    try:
        out = within(spec.kind, spec.params, constraints, whole, draw)
        for text, params in spec.conditional_params.items():
            held = within(spec.kind, params, constraints, whole, draw)
            if out is None or held is None:
                return None
            holds, n = condition(text), max(len(out), len(held))
            out = [F.when(holds, held[min(i, len(held) - 1)]).otherwise(out[min(i, len(out) - 1)]) for i in range(n)]
    except laws.LawError:
        return None
    return out

"""Distribution functions of continuous laws and their inverses, as native columns.

Everything goes by the log-odds of the distribution function, ``z = ln(F / (1 - F))``,
which tells both tails apart to the last digit. Laws with a closed form are written
down. Others (normal, gamma, beta, Student's t, inverse Gaussian) come from tables: the
driver works out the quantiles of ``CELLS`` equal steps of z from -37 to 37, which is
every chance that a double tells from 0 and 1, in coordinates where they are smooth
(logarithms for positive laws, log-odds for those on (0, 1)), with their slopes; tasks
find the cell by arithmetic and take its cubic, which is monotone as the slopes are the
law's own. Beyond the table the last slope goes on, as the logarithm of a power law's
tail does. The distance from the exact quantile is measured in the middle of every cell
when a table is made; it is ``Table.error``, of the coordinate, and lies below
``MOST_ERROR`` or there is no table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.draws import bound

CELLS, FAR = 1024, 37.0
MOST_ERROR = 1e-6
STEPS = 80  # halvings that find a quantile on the driver


class LawError(ValueError):
    """A law that isn't known or whose shapes don't fit."""


# ---- distribution functions on the driver, as (ln F, ln(1 - F), ln density)


def _complement(log_p: np.ndarray) -> np.ndarray:
    """ln(1 - p) from ln p."""
    p = np.minimum(log_p, -1e-300)
    return np.where(p > -0.7, np.log(-np.expm1(p)), np.log1p(-np.exp(np.minimum(p, -0.69))))


def _lentz(terms: Callable[[int], tuple[np.ndarray, np.ndarray]], b0: np.ndarray, most: int = 20_000) -> np.ndarray:
    """A continued fraction b0 + a1 / (b1 + a2 / (b2 + ...)), by its convergents."""
    tiny = 1e-290
    f = np.where(b0 == 0, tiny, b0)
    c, d = f.copy(), np.zeros_like(f)
    for n in range(1, most):
        a, b = terms(n)
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        f = f * c * d
        if np.all(np.abs(c * d - 1) < 4e-16):
            return f
    return f


def gamma_tails(a: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a gamma law at exp(y); the density is that of y."""
    x = np.exp(np.clip(y, -745, 709))
    head = a * y - x - math.lgamma(a)
    low = x < a + 1
    some = np.where(low, x, 0.0)
    total = term = np.full_like(x, 1 / a)
    n = 0
    while np.any(term > total * 1e-17):
        n += 1
        term = term * some / (a + n)
        total = total + term
    under = head + np.log(total)
    far = np.where(low, a + 2, x)
    over = head - np.log(_lentz(lambda n: (-n * (n - a), far + 2 * n + 1 - a), far + 1 - a))
    log_p = np.where(low, under, _complement(over))
    log_q = np.where(low, _complement(under), over)
    return log_p, log_q, head


def beta_tails(a: float, b: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a beta law at the log-odds y; the density is that of y."""
    log_x, log_r = -np.logaddexp(0, -y), -np.logaddexp(0, y)
    head = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * log_x + b * log_r
    x, r = np.exp(log_x), np.exp(log_r)
    low = x < (a + 1) / (a + b + 2)

    def part(a: float, b: float, x: np.ndarray) -> np.ndarray:
        def term(n: int) -> tuple[np.ndarray, np.ndarray]:
            m = n // 2
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return t, np.ones_like(x)

        return -np.log(_lentz(term, np.ones_like(x))) - math.log(a)

    under = head + part(a, b, np.where(low, x, 0.0))
    over = head + part(b, a, np.where(low, 0.0, r))
    return np.where(low, under, _complement(over)), np.where(low, _complement(under), over), head


def norm_tails(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    half = lambda x: np.log(np.maximum(0.5 * np.vectorize(math.erfc)(x / math.sqrt(2)), 1e-320))
    return half(-y), half(y), -y * y / 2 - 0.5 * math.log(2 * math.pi)


def t_tails(df: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Student's t at sinh(y); the density is that of y."""
    t = np.abs(np.sinh(np.clip(y, -340, 340)))
    log_t = np.log(np.maximum(t, 1e-300))
    out, inner, _ = beta_tails(df / 2, 0.5, math.log(df) - 2 * log_t)
    far = out - math.log(2)
    near = np.log1p(np.exp(inner)) - math.log(2)
    density = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(t * t / df) + np.log(np.cosh(np.clip(y, -340, 340)))
    up = y > 0
    return np.where(up, near, far), np.where(up, far, near), density


def invgauss_tails(mu: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an inverse Gaussian law of scale 1 at exp(y); the density is that of y."""
    x = np.exp(y)
    a, b = (x / mu - 1) / np.sqrt(x), -(x / mu + 1) / np.sqrt(x)
    (low, high, _), (more, _, _) = norm_tails(a), norm_tails(b)
    log_p = np.logaddexp(low, 2 / mu + more)
    log_q = high + np.log1p(-np.exp(np.minimum(2 / mu + more - high, -1e-12)))
    density = -0.5 * math.log(2 * math.pi) - y / 2 - (x - mu) ** 2 / (2 * mu * mu * x)
    return log_p, log_q, density


# ---- tables


@dataclass(frozen=True)
class Table:
    """A cubic for each cell of equal steps: four coefficients of the place within the cell, from ``start`` on by ``step``."""

    start: float
    step: float
    coefficients: tuple[float, ...]
    error: float
    slopes: tuple[float, float]  # of the ends, by step

    def sql(self, at: str) -> str:
        """The same in SQL, for the cells themselves (not beyond them)."""
        n = len(self.coefficients) // 4
        place = f"(({at} - ({self.start!r})) / {self.step!r})"
        cell = f"CAST(least(greatest(floor({place}), 0), {n - 1}) AS INT)"
        held = "[" + ",".join(f"{c!r}::DOUBLE" for c in self.coefficients) + "]"
        c = [f"list_extract({held}, {cell} * 4 + {k + 1})" for k in range(4)]
        t = f"least(greatest({place} - {cell}, 0.0), 1.0)"
        return f"({c[0]} + {t} * ({c[1]} + {t} * ({c[2]} + {t} * {c[3]})))"

    def column(self, at: Column) -> Column:
        n = len(self.coefficients) // 4
        place = (at - F.lit(self.start)) / F.lit(self.step)
        cell = F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(n - 1.0))).cast("int")
        held = literal(self.coefficients)
        t = F.least(F.greatest(place - cell, F.lit(0.0)), F.lit(1.0))
        c = [F.get(held, cell * 4 + k) for k in range(4)]
        inner = c[0] + t * (c[1] + t * (c[2] + t * c[3]))
        first, last = self.slopes
        return inner + F.when(place < 0, place * F.lit(first)).when(place > n, (place - n) * F.lit(last)).otherwise(F.lit(0.0))


def literal(values: tuple[float, ...]) -> Column:
    """An array literal of any length, handed over as bytes; an expression for each of thousands of numbers takes seconds to plan."""
    sc = SparkContext._active_spark_context
    held = sc._gateway.new_array(sc._jvm.double, len(values))
    sc._jvm.java.nio.ByteBuffer.wrap(bytearray(np.array(values, ">f8").tobytes())).asDoubleBuffer().get(held)
    return Column(sc._jvm.org.apache.spark.sql.functions.lit(held))


def cubics(values: np.ndarray, slopes: np.ndarray, start: float, step: float, error: float) -> Table:
    """Hermite cubics through the knots; slopes are held within what keeps them monotone."""
    rise = np.diff(values)
    m = slopes * step
    limit = 3 * np.minimum(np.append(rise, rise[-1]), np.insert(rise, 0, rise[0]))
    m = np.minimum(np.maximum(m, 0), limit)
    a, b = m[:-1], m[1:]
    held = np.stack([values[:-1], a, 3 * rise - 2 * a - b, a + b - 2 * rise], axis=1)
    return Table(start, step, tuple(held.ravel().tolist()), error, (float(m[0]), float(m[-1])))


def solved(tails: Callable[[np.ndarray], tuple], z: np.ndarray) -> np.ndarray:
    """Coordinates y with log-odds z."""
    odds = lambda y: (lambda p, q, _: p - q)(*tails(y))
    low, high = np.full_like(z, -1.0), np.full_like(z, 1.0)
    for _ in range(60):
        wide = odds(low) > z
        if not wide.any():
            break
        low = np.where(wide, low * 2, low)
    for _ in range(60):
        wide = odds(high) < z
        if not wide.any():
            break
        high = np.where(wide, high * 2, high)
    for _ in range(STEPS):
        middle = (low + high) / 2
        up = odds(middle) < z
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all(high - low <= 1e-15 * np.maximum(1, np.abs(low))):
            break
    return (low + high) / 2


@functools.lru_cache(maxsize=128)
def tables(kind: str, shapes: tuple[float, ...]) -> tuple[Table, Table]:
    """From log-odds to the coordinate, and back."""
    tails = functools.partial(TAILS[kind], *shapes)
    z = np.linspace(-FAR, FAR, 2 * CELLS + 1)
    with np.errstate(all="ignore"):
        y = solved(tails, z)
        p, q, density = tails(y)
        slope = np.exp(p + q - density)
        step = 2 * FAR / CELLS
        there = cubics(y[::2], slope[::2], -FAR, step, 0.0)
        c = np.array(there.coefficients).reshape(-1, 4)
        error = float(np.max(np.abs(c @ [1, 0.5, 0.25, 0.125] - y[1::2]) / np.maximum(1, np.abs(y[1::2]))))
        grid = np.linspace(y[0], y[-1], CELLS + 1)
        p, q, density = tails(grid)
        back = cubics(p - q, np.exp(density - p - q), float(grid[0]), float(grid[1] - grid[0]), 0.0)
    if not error <= MOST_ERROR:
        raise LawError(f"{kind} with shapes {shapes} is too steep for a table: {error:.1e}")
    return Table(there.start, there.step, there.coefficients, error, there.slopes), back


TAILS: dict[str, Callable] = {"norm": norm_tails, "gamma": gamma_tails, "beta": beta_tails, "t": t_tails, "invgauss": invgauss_tails}


# ---- laws


OUTSIDE = 1e9  # log-odds of what lies beyond a law's range, or -1e9


@dataclass(frozen=True)
class Law:
    """A standard law: its quantile by log-odds, and the log-odds of a value, ``OUTSIDE`` or its negative beyond its range."""

    quantile: Callable[[Column], Column]
    odds: Callable[[Column], Column]


def logit(u: Column) -> Column:
    return F.log(u / (1 - u))


def chance_of(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def from_tables(kind: str, shapes: tuple[float, ...], of: Callable[[Column], Column], to: Callable[[Column], Column]) -> Law:
    """``of`` makes a value from its coordinate, ``to`` the coordinate of a value."""
    return Law(lambda z: of(tables(kind, shapes)[0].column(z)), lambda x: tables(kind, shapes)[1].column(to(x)))


def closed(quantile: Callable[[Column, Column], Column], tails: Callable[[Column], tuple[Column, Column]]) -> Law:
    """From the chances below and above; ``tails`` gives both of a value within the law's range or beyond."""

    def odds(x: Column) -> Column:
        p, q = tails(x)
        return F.when(p <= 0, F.lit(-OUTSIDE)).when(q <= 0, F.lit(OUTSIDE)).otherwise(F.log(p) - F.log(q))

    return Law(lambda z: quantile(chance_of(z), chance_of(-z)), odds)


def mapped(law: Law, up: Callable[[Column], Column], down: Callable[[Column], Column], falling: bool = False) -> Law:
    """A monotone function of a law's value; ``down`` undoes it."""
    sign = (lambda z: -z) if falling else (lambda z: z)
    return Law(lambda z: up(law.quantile(sign(z))), lambda x: sign(law.odds(down(x))))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def survival(s: Column) -> tuple[Column, Column]:
    s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return 1 - s, s


def under(p: Column) -> tuple[Column, Column]:
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return p, 1 - p


def above_zero(law: Law) -> Law:
    return Law(law.quantile, lambda x: F.when(x <= 0, F.lit(-OUTSIDE)).otherwise(law.odds(x)))


def norm() -> Law:
    return from_tables("norm", (), lambda y: y, lambda x: x)


def gamma(a: float) -> Law:
    return above_zero(from_tables("gamma", (float(a),), F.exp, lambda x: F.log(F.greatest(x, F.lit(1e-300)))))


def beta(a: float, b: float) -> Law:
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-300)), F.lit(1 - 2.0**-53))
    law = above_zero(from_tables("beta", (float(a), float(b)), chance_of, lambda x: logit(inside(x))))
    return Law(law.quantile, lambda x: F.when(x >= 1, F.lit(OUTSIDE)).otherwise(law.odds(x)))


def power(law: Law, k: float, scale: float = 1.0) -> Law:
    """(scale * value) ** k of a positive law."""
    return above_zero(mapped(law, lambda x: F.pow(F.lit(scale) * x, F.lit(k)), lambda x: F.pow(F.greatest(x, F.lit(1e-300)), F.lit(1 / k)) / F.lit(scale), k < 0))


def scaled(law: Law, k: float) -> Law:
    return mapped(law, lambda x: F.lit(float(k)) * x, lambda x: x / F.lit(float(k)))


def f_law(n: float, d: float) -> Law:
    # n / d times the value is the odds of a beta law.
    return above_zero(from_tables("beta", (n / 2, d / 2), lambda y: F.lit(d / n) * F.exp(y), lambda x: F.log(F.greatest(x * F.lit(n / d), F.lit(1e-300)))))


def half(law: Law) -> Law:
    """The absolute value of a law that is even: its own chance lies in the upper half."""

    def odds(x: Column) -> Column:
        above = chance_of(-law.odds(positive(x)))
        return F.when(x <= 0, F.lit(-OUTSIDE)).otherwise(F.log((1 - 2 * above) / (2 * above)))

    return Law(lambda z: law.quantile(F.log((1 + chance_of(z)) / chance_of(-z))), odds)


def triangle(c: float) -> Law:
    def tails(x: Column) -> tuple[Column, Column]:
        x = F.least(positive(x), F.lit(1.0))
        rising = x * x / F.lit(c) if c else F.lit(0.0)
        left = (1 - x) * (1 - x) / F.lit(1 - c) if c < 1 else F.lit(0.0)
        return F.when(x < c, rising).otherwise(1 - left), F.when(x < c, 1 - rising).otherwise(left)

    return closed(lambda p, q: F.when(p < c, F.sqrt(p * c)).otherwise(1 - F.sqrt(q * F.lit(1 - c))), tails)


PI = math.pi
#: Standard laws by scipy's names and shapes.
LAWS: dict[str, Callable[..., Law]] = {
    "uniform": lambda: closed(lambda p, q: p, under),
    "expon": lambda: closed(lambda p, q: -F.log(q), lambda x: (-F.expm1(-positive(x)), F.exp(-positive(x)))),
    "norm": norm,
    "halfnorm": lambda: half(norm()),
    "lognorm": lambda s: above_zero(mapped(norm(), lambda x: F.exp(F.lit(float(s)) * x), lambda x: F.log(F.greatest(x, F.lit(1e-300))) / F.lit(float(s)))),
    "logistic": lambda: Law(lambda z: z, lambda x: x),
    "halflogistic": lambda: half(Law(lambda z: z, lambda x: x)),
    "fisk": lambda c: above_zero(mapped(Law(lambda z: z, lambda x: x), lambda x: F.exp(x / c), lambda x: F.log(F.greatest(x, F.lit(1e-300))) * c)),
    "laplace": lambda: closed(lambda p, q: F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 * q)), lambda x: (F.when(x < 0, F.exp(x) / 2).otherwise(1 - F.exp(-x) / 2), F.when(x < 0, 1 - F.exp(x) / 2).otherwise(F.exp(-x) / 2))),
    "cauchy": lambda: closed(lambda p, q: F.when(p < 0.5, -1 / F.tan(PI * p)).otherwise(1 / F.tan(PI * q)), lambda x: (F.atan2(F.lit(1.0), -x) / PI, F.atan2(F.lit(1.0), x) / PI)),
    "halfcauchy": lambda: closed(lambda p, q: 1 / F.tan(PI / 2 * q), lambda x: (2 / PI * F.atan(positive(x)), 2 / PI * F.atan2(F.lit(1.0), positive(x)))),
    "gumbel_r": lambda: closed(lambda p, q: -F.log(-F.log1p(-q)), lambda x: (F.exp(-F.exp(-x)), -F.expm1(-F.exp(-x)))),
    "gumbel_l": lambda: closed(lambda p, q: F.log(-F.log1p(-p)), lambda x: (-F.expm1(-F.exp(x)), F.exp(-F.exp(x)))),
    "rayleigh": lambda: closed(lambda p, q: F.sqrt(-2 * F.log(q)), lambda x: (-F.expm1(-positive(x) * positive(x) / 2), F.exp(-positive(x) * positive(x) / 2))),
    "weibull_min": lambda c: closed(lambda p, q: F.pow(-F.log(q), F.lit(1 / c)), lambda x: (-F.expm1(-F.pow(positive(x), F.lit(c))), F.exp(-F.pow(positive(x), F.lit(c))))),
    "weibull_max": lambda c: closed(lambda p, q: -F.pow(-F.log(p), F.lit(1 / c)), lambda x: (F.exp(-F.pow(positive(-x), F.lit(c))), -F.expm1(-F.pow(positive(-x), F.lit(c))))),
    "invweibull": lambda c: closed(lambda p, q: F.pow(-F.log1p(-q), F.lit(-1 / c)), lambda x: (F.exp(-F.pow(F.greatest(x, F.lit(1e-300)), F.lit(-c))), -F.expm1(-F.pow(F.greatest(x, F.lit(1e-300)), F.lit(-c))))),
    "pareto": lambda b: closed(lambda p, q: F.pow(q, F.lit(-1 / b)), lambda x: survival(F.pow(F.greatest(x, F.lit(1.0)), F.lit(-b)))),
    "lomax": lambda c: closed(lambda p, q: F.pow(q, F.lit(-1 / c)) - 1, lambda x: survival(F.pow(1 + positive(x), F.lit(-c)))),
    "genpareto": lambda c: LAWS["expon"]() if c == 0 else closed(lambda p, q: F.expm1(-c * F.log(q)) / c, lambda x: survival(F.pow(F.greatest(1 + c * positive(x), F.lit(0.0 if c < 0 else 1.0)), F.lit(-1 / c)))),
    "powerlaw": lambda a: closed(lambda p, q: F.pow(p, F.lit(1 / a)), lambda x: under(F.pow(positive(x), F.lit(a)))),
    "loguniform": lambda a, b: closed(lambda p, q: F.lit(float(a)) * F.exp(F.lit(math.log(b / a)) * p), lambda x: under(F.log(F.greatest(x, F.lit(float(a))) / a) / math.log(b / a))),
    "triang": triangle,
    "arcsine": lambda: closed(lambda p, q: F.pow(F.sin(PI / 2 * p), F.lit(2.0)), lambda x: under(2 / PI * F.asin(F.sqrt(F.least(positive(x), F.lit(1.0)))))),
    "burr": lambda c, d: closed(lambda p, q: F.pow(F.pow(p, F.lit(-1 / d)) - 1, F.lit(-1 / c)), lambda x: under(F.pow(1 + F.pow(F.greatest(x, F.lit(1e-300)), F.lit(-c)), F.lit(-d)))),
    "burr12": lambda c, d: closed(lambda p, q: F.pow(F.pow(q, F.lit(-1 / d)) - 1, F.lit(1 / c)), lambda x: survival(F.pow(1 + F.pow(positive(x), F.lit(c)), F.lit(-d)))),
    "bradford": lambda c: closed(lambda p, q: F.expm1(F.lit(math.log1p(c)) * p) / c, lambda x: under(F.log1p(c * positive(x)) / math.log1p(c))),
    "gompertz": lambda c: closed(lambda p, q: F.log1p(-F.log(q) / c), lambda x: survival(F.exp(-c * F.expm1(positive(x))))),
    "truncexpon": lambda b: closed(lambda p, q: -F.log1p(p * math.expm1(-b)), lambda x: under(F.expm1(-positive(x)) / math.expm1(-b))),
    "hypsecant": lambda: closed(lambda p, q: F.log(F.tan(PI / 2 * p)), lambda x: (2 / PI * F.atan(F.exp(x)), 2 / PI * F.atan(F.exp(-x)))),
    "gamma": gamma,
    "erlang": gamma,
    "chi2": lambda df: scaled(gamma(df / 2), 2),
    "chi": lambda df: power(gamma(df / 2), 0.5, 2.0),
    "maxwell": lambda: power(gamma(1.5), 0.5, 2.0),
    "nakagami": lambda nu: power(gamma(nu), 0.5, 1 / nu),
    "invgamma": lambda a: power(gamma(a), -1.0),
    "gengamma": lambda a, c: power(gamma(a), 1 / c),
    "beta": beta,
    "betaprime": lambda a, b: scaled(f_law(2 * a, 2 * b), a / b),
    "f": lambda dfn, dfd: f_law(float(dfn), float(dfd)),
    "t": lambda df: from_tables("t", (float(df),), F.sinh, F.asinh),
    "invgauss": lambda mu: above_zero(from_tables("invgauss", (float(mu),), F.exp, lambda x: F.log(F.greatest(x, F.lit(1e-300))))),
    "wald": lambda: LAWS["invgauss"](1.0),
}


def law(name: str, shapes: dict[str, Any]) -> Law:
    if name not in LAWS:
        raise LawError(f"no law is named {name!r}")
    try:
        return LAWS[name](**{k: float(v) for k, v in shapes.items()})
    except TypeError:
        raise LawError(f"the law {name!r} takes other shapes than {sorted(shapes)}") from None
    except (ValueError, ZeroDivisionError, OverflowError) as e:
        raise LawError(f"the law {name!r} can't have the shapes {shapes}: {e}") from None


def between(of: Law, low: Column | None, high: Column | None, u: Column) -> Column:
    """A draw of a law from what lies between two values. Worked out in the tail that the lower value stands in, so that ranges far
    out keep their digits."""
    ends = F.struct((of.odds(low) if low is not None else F.lit(-OUTSIDE)).alias("a"), (of.odds(high) if high is not None else F.lit(OUTSIDE)).alias("b"))

    def drawn(e: Column) -> Column:
        upper = e["a"] > 0
        s, t = F.when(upper, chance_of(-e["b"])).otherwise(chance_of(e["a"])), F.when(upper, chance_of(-e["a"])).otherwise(chance_of(e["b"]))
        return bound(s + (t - s) * u, lambda p: F.when(upper, F.log1p(-p) - F.log(p)).otherwise(F.log(p) - F.log1p(-p)))

    return bound(bound(ends, drawn), of.quantile)


def reaches(of: Law, low: Column | None, high: Column | None) -> Column:
    """Whether any of a law's range lies between two values."""
    out = F.lit(True)
    for x, beyond in ((low, lambda z: z >= OUTSIDE), (high, lambda z: z <= -OUTSIDE)):
        out = out if x is None else out & ~bound(of.odds(x), beyond)
    return out


def mass(of: Law, low: Column | None, high: Column | None) -> Column:
    """The chance of what lies between two values."""
    ends = F.struct((of.odds(low) if low is not None else F.lit(-OUTSIDE)).alias("a"), (of.odds(high) if high is not None else F.lit(OUTSIDE)).alias("b"))
    told = lambda e: F.when(e["a"] > 0, chance_of(-e["a"]) - chance_of(-e["b"])).otherwise(chance_of(e["b"]) - chance_of(e["a"]))
    return F.greatest(bound(ends, told), F.lit(0.0))

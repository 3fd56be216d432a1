"""Distributions against numpy's generators and exact sums; draws within constraints."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import laws
from weftline.functions.template import Compiler
from weftline.operators.samplers import Constraint, Draw, SamplerSpec, hypergeom_cdf, nbinom_cdf, redrawn
from weftline.plans.config import Builder
from weftline.plans.planner import Planner


def apart(a, b):
    """Kolmogorov's distance of two samples."""
    both = np.sort(np.concatenate([a, b]))
    return float(np.max(np.abs(np.searchsorted(np.sort(a), both, "right") / len(a) - np.searchsorted(np.sort(b), both, "right") / len(b))))


N = 40_000
KINDS = {
    "gamma": ({"a": 0.7}, lambda r: r.gamma(0.7, size=N)),
    "beta": ({"a": 0.5, "b": 3}, lambda r: r.beta(0.5, 3, size=N)),
    "chi2": ({"df": 5}, lambda r: r.chisquare(5, size=N)),
    "t": ({"df": 2.5}, lambda r: r.standard_t(2.5, size=N)),
    "f": ({"dfn": 4, "dfd": 7}, lambda r: r.f(4, 7, size=N)),
    "invgauss": ({"mu": 0.8}, lambda r: r.wald(0.8, 1, size=N)),
    "invgamma": ({"a": 3}, lambda r: 1 / r.gamma(3, size=N)),
    "maxwell": ({}, lambda r: np.sqrt((r.normal(size=(N, 3)) ** 2).sum(axis=1))),
    "halfnorm": ({}, lambda r: np.abs(r.normal(size=N))),
    "lomax": ({"c": 2}, lambda r: r.pareto(2, size=N)),
    "burr12": ({"c": 2, "d": 3}, lambda r: (r.pareto(3, size=N)) ** 0.5),
    "betaprime": ({"a": 2, "b": 3}, lambda r: (lambda x: x / (1 - x))(r.beta(2, 3, size=N))),
    "halfcauchy": ({}, lambda r: np.abs(r.standard_cauchy(size=N))),
    "arcsine": ({}, lambda r: r.beta(0.5, 0.5, size=N)),
    "nbinom": ({"n": 3, "p": 0.4}, lambda r: r.negative_binomial(3, 0.4, size=N)),
    "hypergeom": ({"M": 20, "n": 7, "N": 12}, lambda r: r.hypergeometric(7, 13, 12, size=N)),
}


def test_named_distributions_are_numpy_s(spark):
    rows = spark.range(N)
    made = rows.select(*(SamplerSpec("v", "scipy", {"dist_name": k, "dist_params": shapes}).column(Draw(5, k, F.col("id")), None).cast("double").alias(k) for k, (shapes, _) in KINDS.items()))
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
    held = made.toPandas()
    r = np.random.default_rng(1)
    for k, (_, drawn) in KINDS.items():
        assert apart(held[k].to_numpy(), drawn(r).astype(float)) < 1.95 * math.sqrt(2 / N), k  # one in a thousand


def test_odds_undo_quantiles(spark):
    """All laws, from odds of 1e-10 to 1e10."""
    shapes = {"lognorm": (0.7,), "fisk": (2.0,), "weibull_min": (1.5,), "weibull_max": (1.5,), "invweibull": (2.0,), "pareto": (2.5,), "lomax": (2.0,), "genpareto": (0.3,), "powerlaw": (2.0,), "loguniform": (1.0, 9.0), "triang": (0.3,), "burr": (2.0, 1.5), "burr12": (2.0, 1.5), "bradford": (2.0,), "gompertz": (1.5,), "truncexpon": (3.0,), "gamma": (2.0,), "erlang": (3.0,), "chi2": (3.0,), "chi": (3.0,), "nakagami": (1.5,), "invgamma": (2.0,), "gengamma": (2.0, 1.5), "beta": (2.0, 3.0), "betaprime": (2.0, 3.0), "f": (3.0, 5.0), "t": (4.0,), "invgauss": (1.2,)}
    z = [-20.0, -6.0, -1.0, -0.1, 0.0, 0.3, 2.0, 7.0, 20.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for name, made in laws.LAWS.items():
        law = made(*shapes.get(name, ()))
        for row in df.select("z", law.odds(law.quantile(F.col("z"))).alias("w")).collect():
            assert abs(row.w - row.z) <= 2e-4 * max(1, abs(row.z)) or abs(row.z) == 20 and abs(row.w) > 14, (name, row)


@pytest.mark.parametrize(("kind", "shapes"), [("gamma", (0.05,)), ("gamma", (2000.0,)), ("beta", (0.05, 30.0)), ("t", (0.5,)), ("invgauss", (5.0,)), ("norm", ())])
def test_tables_state_their_error(kind, shapes):
    assert laws.tables(kind, shapes)[0].error < 1e-6


def test_discrete_sums():
    assert sum(np.diff([0, *hypergeom_cdf(20, 7, 12), 1])) == pytest.approx(1)
    assert hypergeom_cdf(10, 9, 5)[:4] == [0, 0, 0, 0]
    assert nbinom_cdf(1, 0.5)[:3] == pytest.approx([0.5, 0.75, 0.875])


# ---- constraints that leave next to nothing


def within(spark, kind, params, constraints, n=300, **more):
    df = spark.range(n).withColumns({"low": F.col("id") % 7 + 3.0, "at": F.timestamp_seconds(F.col("id") * 3600 + 1_600_000_000), "kind": F.when(F.col("id") % 2 == 0, "x").otherwise("y")})
    spec = SamplerSpec("v", kind, params, **more)
    v = redrawn(spec, Draw(7, "v", F.col("id")), constraints, Compiler(df.schema).condition)
    return [(r.low, r.v) for r in df.select("low", spec.finished(v).alias("v")).collect()]


FAR = [
    ("uniform", {"low": 0, "high": 1e9}, [Constraint("v", "lt", 1.0)]),
    ("uniform", {"low": 0, "high": 1e9}, [Constraint("v", "lt", 11), Constraint("v", "gt", "low")]),
    ("gaussian", {"mean": 0, "stddev": 1}, [Constraint("v", "gt", 6)]),
    ("gaussian", {"mean": 0, "stddev": 1}, [Constraint("v", "gt", "low"), Constraint("v", "le", 12)]),
    ("gaussian", {"mean": 100, "stddev": 2}, [Constraint("v", "ge", "low"), Constraint("v", "lt", 80)]),
    ("scipy", {"dist_name": "gamma", "dist_params": {"a": 2}}, [Constraint("v", "gt", 25)]),
    ("scipy", {"dist_name": "beta", "dist_params": {"a": 2, "b": 50}}, [Constraint("v", "gt", 0.5)]),
    ("scipy", {"dist_name": "expon", "dist_params": {"scale": -1.0}}, [Constraint("v", "lt", -25)]),
    ("scipy", {"dist_name": "t", "dist_params": {"df": 9}}, [Constraint("v", "lt", -12)]),
    ("scipy", {"dist_name": "geom", "dist_params": {"p": 0.5}}, [Constraint("v", "gt", 30), Constraint("v", "le", 40)]),
    ("scipy", {"dist_name": "randint", "dist_params": {"low": 0, "high": 1_000_000_000}}, [Constraint("v", "ge", 4), Constraint("v", "lt", 7)]),
    ("poisson", {"mean": 3}, [Constraint("v", "gt", 15)]),
    ("poisson", {"mean": 3}, [Constraint("v", "gt", 60)]),
    ("binomial", {"n": 40, "p": 0.5}, [Constraint("v", "ge", 38)]),
    ("bernoulli", {"p": 1e-9}, [Constraint("v", "gt", 0)]),
    ("bernoulli_mixture", {"p": 1e-6, "dist_name": "expon", "dist_params": {}}, [Constraint("v", "gt", 3)]),
    ("category", {"values": [1, 2, 30], "weights": [1, 1, 1e-9]}, [Constraint("v", "gt", "low")]),
]


@pytest.mark.parametrize(("kind", "params", "constraints"), FAR)
def test_no_acceptance_is_too_small(spark, kind, params, constraints):
    held = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
    got = within(spark, kind, params, constraints)
    for low, v in got:
        assert v is not None and all(held[c.operator](v, c.scalar if c.scalar is not None else low) for c in constraints), (low, v)
    if kind in ("uniform", "gaussian"):
        assert len({v for _, v in got}) > 290


def test_what_constraints_leave_keeps_its_shape(spark):
    """A tail of a normal law, and of a category, has the chances that it has in the whole."""
    got = np.array([v for _, v in within(spark, "gaussian", {"mean": 0, "stddev": 1}, [Constraint("v", "gt", 4.0)], 20_000)])
    tail = lambda x: math.erfc(x / math.sqrt(2))
    for x in (4.1, 4.3, 4.6):
        assert abs(np.mean(got > x) - tail(x) / tail(4.0)) < 0.015
    kept = collections.Counter(v for _, v in within(spark, "category", {"values": [0, 5, 6], "weights": [1e9, 1, 3]}, [Constraint("v", "gt", 1)], 20_000))
    assert set(kept) == {5, 6} and abs(kept[6] / 20_000 - 0.75) < 0.015
    whole = collections.Counter(v for _, v in within(spark, "gaussian", {"mean": 0, "stddev": 1}, [Constraint("v", "gt", 4), Constraint("v", "le", 6)], 20_000, convert_to="int"))
    want = {k: tail(k - 0.5) - tail(k + 0.5) for k in (5, 6)}
    assert set(whole) <= set(want) and abs(whole[5] / 20_000 - want[5] / sum(want.values())) < 0.015


def test_rounding_comes_before_constraints(spark):
    got = [v for _, v in within(spark, "uniform", {"low": 0, "high": 10}, [Constraint("v", "lt", 5)], 3000, convert_to="int")]
    assert set(got) == {0, 1, 2, 3, 4}


def test_moments_within(spark):
    b = Builder(3).add_column(name="a", kind="sampler", sampler_type="datetime", params={"start": "2020-01-01", "end": "2021-01-01", "unit": "D"})
    b.add_column(name="b", kind="sampler", sampler_type="datetime", params={"start": "1970-01-01", "end": "2021-01-02", "unit": "D"}).add_constraint("b", "gt", "a")
    b.add_column(name="c", kind="sampler", sampler_type="timedelta", params={"dt_min": 0, "dt_max": 40_000, "reference_column_name": "a"}).add_constraint("c", "le", "b")
    rows = Planner(spark, b.build()).plan(400).collect()
    assert len(rows) == 400 and all(r.a < r.b and r.a <= r.c <= r.b for r in rows)


def test_conditions_within(spark):
    got = within(spark, "gaussian", {"mean": 0, "stddev": 1}, [Constraint("v", "gt", 7)], conditional_params={"kind == 'x'": {"mean": 7, "stddev": 0.1}})
    assert all(v is not None and v > 7 for _, v in got)


NEVER = [
    ("uniform", {"low": 0, "high": 1}, [Constraint("v", "gt", 1), Constraint("v", "lt", 0)]),
    ("uniform", {"low": 0, "high": 1}, [Constraint("v", "gt", 1.0000001)]),
    ("uniform", {"low": 0, "high": 1}, [Constraint("v", "lt", "below")]),
    ("scipy", {"dist_name": "gamma", "dist_params": {"a": 2}}, [Constraint("v", "lt", -1e-9)]),
    ("scipy", {"dist_name": "gamma", "dist_params": {"a": 2, "scale": -1}}, [Constraint("v", "gt", 0.5)]),
    ("scipy", {"dist_name": "beta", "dist_params": {"a": 2, "b": 3}}, [Constraint("v", "gt", 1)]),
    ("scipy", {"dist_name": "invgamma", "dist_params": {"a": 2}}, [Constraint("v", "le", -3)]),
    ("scipy", {"dist_name": "lognorm", "dist_params": {"s": 2}}, [Constraint("v", "le", -3)]),
    ("scipy", {"dist_name": "pareto", "dist_params": {"b": 2}}, [Constraint("v", "lt", 0.9)]),
    ("scipy", {"dist_name": "randint", "dist_params": {"low": 0, "high": 9}}, [Constraint("v", "gt", 9)]),
    ("scipy", {"dist_name": "geom", "dist_params": {"p": 0.3}}, [Constraint("v", "lt", 1)]),
    ("binomial", {"n": 4, "p": 0.5}, [Constraint("v", "gt", 4)]),
    ("poisson", {"mean": 4}, [Constraint("v", "lt", 0)]),
    ("bernoulli", {"p": 0.5}, [Constraint("v", "gt", 1)]),
    ("category", {"values": [1, 2]}, [Constraint("v", "gt", 2)]),
]


@pytest.mark.parametrize(("kind", "params", "constraints"), NEVER)
def test_what_can_t_be_fails(spark, kind, params, constraints):
    df = spark.range(5).withColumn("below", F.lit(-1.0))
    spec = SamplerSpec("v", kind, params)
    assert [r.v for r in df.select(redrawn(spec, Draw(7, "v", F.col("id")), constraints, Compiler(df.schema).condition).alias("v")).collect()] == [None] * 5

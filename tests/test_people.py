"""Conditional weights, and what is derived for people."""

import collections
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions.draws import Conditional, alias_table, uniform
from weftline.operators import people as pe
from weftline.operators.samplers import Draw
from weftline.plans.config import Builder
from weftline.plans.planner import Planner, Resources


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 0, 1], [0.1, 710, 300, 50], list(range(1, 40))])
def test_alias_tables_keep_the_weights(weights):
    stay, other = alias_table(weights)
    n, got = len(weights), collections.Counter()
    for i in range(n):
        got[i] += stay[i] / n
        got[other[i]] += (1 - stay[i]) / n
    assert all(got[i] == pytest.approx(w / sum(weights)) for i, w in enumerate(weights))


def test_alias_tables_of_no_weight():
    for weights in ([0, 0], [1, -1]):
        with pytest.raises(ValueError, match="weights"):
            alias_table(weights)


def test_conditional_draws(spark):
    c = Conditional({"a": {"x": 1.0, "y": 3.0}, "b": {"it's": 1.0}})
    rows = spark.range(40_000).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3).cast("int") + 1).alias("k"), "id")
    got = collections.Counter((r.k, r.v) for r in rows.select("k", c.column(F.col("k"), uniform(1, "c", F.col("id"))).alias("v")).collect())
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "it's"), ("c", None)}
    assert abs(got["a", "y"] / (got["a", "x"] + got["a", "y"]) - 0.75) < 0.015


def test_contacts(spark):
    n = 20_000
    born = F.date_add(F.lit("2011-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    d = Draw(3, "p", F.col("id"))
    df = spark.range(n).select("id", born.alias("born"), pe.phone(F.lit(30), F.lit("80202"), d).alias("phone"), pe.national_id(F.lit("WY"), born, d).alias("wy"), pe.national_id(F.lit("LA"), born, d).alias("la"), pe.national_id(F.lit("XX"), born, d).alias("other"), pe.email(F.lit("Zoë"), F.lit("O'Neil"), F.lit(20), born, d, F.when(F.col("id") % 2 == 0, "Mae")).alias("mail"), pe.email(F.lit("A"), F.lit("B"), F.lit(17), born, d).alias("child"), pe.phone(F.lit(17), F.lit("80202"), d).alias("minor"), pe.phone(F.lit(30), F.lit(None).cast("string"), d).alias("nowhere"), pe.phone(F.lit(30), F.lit("80299"), d, "international").alias("near"))
    rows = df.collect()
    areas = collections.Counter(r.phone[:3] for r in rows)
    denver = {p[3]: p[4] for p in pe.PLACES if p[2].startswith("802")}
    assert set(denver) == {"303"} and abs(areas["303"] / n - (0.9 + 0.1 * sum(p[4] for p in pe.PLACES if p[3] == "303") / sum(p[4] for p in pe.PLACES))) < 0.01
    assert all(re.fullmatch(r"\d{3}-[2-9]\d\d-\d{4}", r.phone) and re.fullmatch(r"001 \d{3} [2-9]\d\d \d{4}", r.near) for r in rows)
    assert all(r.child is None and r.minor is None and r.nowhere is None for r in rows)
    cutoff = dt.date(2011, 6, 25)
    assert {r.wy[:3] for r in rows if r.born < cutoff} == {"520"} and len({r.wy[:3] for r in rows if r.born >= cutoff}) > 800
    assert {int(r.la[:3]) for r in rows if r.born < cutoff} == set(range(433, 440))
    assert {int(r.other[:3]) for r in rows} == set(range(1, 900)) - {666}
    names = collections.Counter(re.match(r"[a-z._]+", r.mail)[0] for r in rows)
    assert set(names) == {"zoe.oneil", "zoeoneil", "zoneil", "zoe_oneil", "oneilz", "zoeo", "zoemae", "zoemoneil", "zoemaeoneil"}
    ends = collections.Counter(re.match(r"[a-z._]+(\d*)@", r.mail)[1] for r in rows)
    assert abs(ends[""] / n - 0.4) < 0.02 and {"2011"} <= set(ends)
    with pytest.raises(ValueError, match="style"):
        pe.phone(F.lit(1), F.lit("1"), d, "smoke")


def test_managed_people_get_what_is_derived(spark):
    held = spark.createDataFrame([(f"u{i}", "Ann", "Lee", 20 + i % 50, "98101", "WA", "kept@example.org" if i % 2 else None) for i in range(60)], "uuid string, first_name string, last_name string, age long, postcode string, region string, email_address string")
    b = Builder(1).add_column(name="p", kind="sampler", sampler_type="person", params={}).add_column(name="v", kind="expression", expr="{{ p.phone_number }} {{ p.national_id }} {{ p.birth_date }}")
    rows = Planner(spark, b.build(), Resources(people={"en_US": held.drop("email_address")})).plan(40).collect()
    assert all(re.fullmatch(r"\d{3}-\d{3}-\d{4} \d{3}-\d\d-\d{4} \d{4}-\d\d-\d\d", r.v) and r.p.email_address.count("@") == 1 and 531 <= int(r.p.national_id[:3]) <= 539 for r in rows)
    rows = Planner(spark, b.build(), Resources(people={"en_US": held})).plan(40).collect()
    assert {r.p.email_address for r in rows} <= {None, "kept@example.org"}

"""Registered queries of JSON paths, constraints, statistics from sketches and hydrated seeds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.laws import tables
from weftline.functions.template import Compiler
from weftline.operators import samplers as sm
from weftline.operators.sketches import merged, sketched
from weftline.operators.validate import json_block
from weftline.plans.config import Builder
from weftline.plans.planner import ROW, Planner
from weftline.queries import SEED, query, table, templated, u
from weftline.sources.seeds import HydratedSource, IndexRange

#: Lines of an order in a fixed order, as SQL and as a column.
LINES = "list({'flag': l_returnflag, 'n': l_linenumber, 'part': {'key': l_partkey, 'supp': l_suppkey}, 'qty': CAST(l_quantity AS INT)} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON documents, with their lines below them."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))
    shown = lambda x: F.struct(x["l_returnflag"].alias("flag"), x["l_linenumber"].alias("n"), F.struct(x["l_partkey"].alias("key"), x["l_suppkey"].alias("supp")).alias("part"), x["l_quantity"].cast("int").alias("qty"))
    held = held.select("l_orderkey", F.transform("x", shown).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("key"))
    joined = orders.join(held, orders.o_orderkey == held.l_orderkey)
    return joined.select("o_orderkey", F.to_json(F.struct(F.struct("key").alias("customer"), "lines", F.col("o_orderstatus").alias("status"))).alias("j"))


def shown_sql(values: str, quoted: bool = False) -> str:
    """A list as Python shows it."""
    mark = "''''" if quoted else "''"
    return f"'[' || array_to_string(list_transform({values}, lambda x: {mark} || x || {mark}), ', ') || ']'"


@query(f"""
WITH l AS (SELECT l_orderkey, {LINES} AS x FROM lineitem GROUP BY 1),
 d AS (SELECT o_orderkey, x, to_json({{'customer': {{'key': o_custkey}}, 'lines': x, 'status': o_orderstatus}}) AS j FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, {shown_sql("json_extract_string(j, '$.lines[*].flag')", True)} AS flags, {shown_sql("json_extract(j, ['$.lines[#-1].n'])")} AS last, {shown_sql("list_transform(x[:2], lambda y: y.part.key)")} AS two,
 {shown_sql("list_transform(list_reverse(list_filter(x, lambda y, i: (len(x) - i) % 2 = 0)), lambda y: y.n)")} AS back, {shown_sql("list_filter(json_extract(j, ['$.lines[2].n', '$.lines[0].n']), lambda y: y IS NOT NULL)")} AS picks,
 {shown_sql("list_transform(list_filter(x, lambda y: y.qty > 30 AND y.flag <> 'R' OR y.part.supp = 7), lambda y: y.n)")} AS big, {shown_sql("list_prepend(json_extract(j, '$.customer.key'), json_extract(j, '$.lines[*].part.key'))")} AS keys,
 CAST(len(x) AS VARCHAR) AS n, CAST(list_max(list_transform(x, lambda y: y.qty)) AS VARCHAR) AS most
FROM d
""")
def jsonpath_orders(spark, d):
    """Wildcards, places, slices, unions, filters and descent over nested documents, all in native expressions."""
    paths = {"flags": "$.lines[*].flag", "last": "$.lines[-1].n", "two": "$.lines[:2].part.key", "back": "$.lines[::-2].n", "picks": "$.lines[2,0].n", "big": "$.lines[?(@.qty > 30 && @.flag != 'R' || @.part.supp == 7)].n", "keys": "$..key"}
    shown = {name: f"{{{{ j|jsonpath({path!r}) }}}}" for name, path in paths.items()}
    return templated(nested(spark, d), ["o_orderkey"], shown | {"n": "{{ j|jsonpath('$.lines[*]')|length }}", "most": "{{ j|jsonpath('$.lines[*].qty')|max }}"})


# ---- draws from what constraints leave

#: A value within constraints that the 32 tries don't meet is drawn by the part of the draw that is named so.
LAST = f"{sm.TRIES}truncated"


@query(f"SELECT o_orderkey, round_even((o_custkey % 7 + 1) * {u('v', LAST)}, 6) AS v FROM orders")
def constraint_far(spark, d):
    """One draw in a few hundred million fits; each row has its value all the same."""
    df = table(spark, d, "orders").withColumn("most", F.col("o_custkey") % 7 + 1)
    spec = sm.SamplerSpec("v", "uniform", {"low": 0, "high": 1e9})
    value = sm.redrawn(spec, sm.Draw(SEED, "v", F.col("o_orderkey")), [sm.Constraint("v", "lt", "most"), sm.Constraint("v", "ge", 0)], Compiler(df.schema).condition)
    return df.select("o_orderkey", F.bround(value, 6).alias("v"))


def tail_sql() -> str:
    """Of a normal law, what lies beyond a bound, by the law's two tables."""
    there, back = tables("norm", ())
    parts = [t.sql(at) for t, at in ((back, "(low / 10)"), (there, "z"))]
    cells = [p.split("list_extract(")[1].split("], ")[0] + "]" for p in parts]
    odds, value = (p.replace(c, n) for p, c, n in zip(parts, cells, "ab", strict=True))
    drawn = f"SELECT *, 1 / (1 + exp({odds})) * {u('v', LAST)} AS p FROM (SELECT o_orderkey, o_custkey % 5 + 60.0 AS low, {cells[0]} AS a, {cells[1]} AS b FROM orders)"
    return f"SELECT o_orderkey, round_even(10 * {value}, 6) AS v FROM (SELECT *, ln(1 - p) - ln(p) AS z FROM ({drawn}))"


@query(tail_sql())
def constraint_tail(spark, d):
    """A normal law's values of more than six deviations, by a bound of each row."""
    df = table(spark, d, "orders").withColumn("low", F.col("o_custkey") % 5 + 60.0)
    spec = sm.SamplerSpec("v", "gaussian", {"mean": 0, "stddev": 10})
    value = sm.redrawn(spec, sm.Draw(SEED, "v", F.col("o_orderkey")), [sm.Constraint("v", "gt", "low")], Compiler(df.schema).condition)
    return df.select("o_orderkey", F.bround(value, 6).alias("v"))


# ---- statistics from sketches


@query("""SELECT *, true AS unique_within, true AS median_within FROM (
 SELECT 'l_quantity' AS column_name, count(*) AS num_records, count(*) - count(l_quantity) AS num_null, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS stddev FROM lineitem UNION ALL
 SELECT 'l_extendedprice', count(*), count(*) - count(l_extendedprice), min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6) FROM lineitem UNION ALL
 SELECT 'l_partkey', count(*), count(*) - count(l_partkey), min(l_partkey), max(l_partkey), round(avg(l_partkey), 6), round(stddev_samp(l_partkey), 6) FROM lineitem)""")
def statistics_sketches(spark, d):
    """Sketches of parts of a table, merged, against what the whole table says: counts and moments are exact, distinct values and
    medians lie within the sketches' bounds."""
    names = ["l_quantity", "l_extendedprice", "l_partkey"]
    df = table(spark, d, "lineitem").select("l_orderkey", *names)
    told = merged(sketched(df.withColumn("block", F.pmod(F.xxhash64("l_orderkey"), F.lit(16))).drop("l_orderkey"), "block"))
    told = told.withColumn("of", F.struct("num_unique", "median")).select("column_name", "num_records", "num_null", F.col("min").alias("least"), F.col("max").alias("most"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "of")
    at = {r["column_name"]: r["of"] for r in told.select("column_name", "of").collect()}
    checks = [x for c in names for x in (F.count_distinct(c).alias(f"n_{c}"), F.avg((F.col(c) < at[c]["median"]).cast("double")).alias(f"below_{c}"), F.avg((F.col(c) <= at[c]["median"]).cast("double")).alias(f"to_{c}"))]
    true = df.agg(*checks).first()
    rows = [(c, abs(at[c]["num_unique"] - true[f"n_{c}"]) <= 0.05 * true[f"n_{c}"], true[f"below_{c}"] - 0.02 <= 0.5 <= true[f"to_{c}"] + 0.02) for c in names]
    return told.drop("of").join(spark.createDataFrame(rows, "column_name string, unique_within boolean, median_within boolean"), "column_name")


# ---- hydrated seeds


@query(f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY n_nationkey, k) - 1 AS place, count(*) OVER () AS size FROM (SELECT n_nationkey, n_name, unnest(range(n_regionkey + 1)) AS k FROM nation WHERE n_nationkey BETWEEN 3 AND 20))
 SELECT r, n_nationkey, n_name || '/' || k AS v FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) JOIN h ON r % size = place""")
def seed_hydrated(spark, d):
    """A config seeded by a manifest of nations: the range is of the manifest, and hydrated rows are cycled through."""
    source = HydratedSource(table(spark, d, "nation"), lambda r: [{"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], "k": k} for k in range(r["n_regionkey"] + 1)], "n_nationkey int, n_name string, k long")
    b = Builder(SEED).with_seed(source, selection=IndexRange(3, 20), order_by=["n_nationkey"]).add_column(name="v", kind="expression", expr="{{ n_name }}/{{ k }}")
    return Planner(spark, b.build()).plan(table(spark, d, "customer").count()).select(F.col(ROW).alias("r"), "n_nationkey", "v")


# ---- JSON that breaks off


@query("""SELECT p_partkey, p_partkey AS k, CASE WHEN p_size % 6 IN (0, 3) THEN NULL ELSE p_name END AS name, CAST(CASE WHEN p_size % 6 IN (0, 3) THEN p_size + 1 ELSE NULL END AS BIGINT) AS total FROM part""")
def extract_json_repaired(spark, d):
    """Texts that break off, with single quotes, bare names, a missing bracket, missing commas and colons, and a block that isn't closed."""
    k, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")
    texts = [
        F.concat(F.lit('Here it is: {"k": '), k, F.lit(', "sizes": [1, '), size),
        F.concat(F.lit("{'k': "), k, F.lit(", 'name': '"), name, F.lit("'} as asked")),
        F.concat(F.lit("{k: "), k, F.lit(", name: "), name, F.lit(",}")),
        F.concat(F.lit('```json\n{"k": '), k, F.lit(', "sizes": [1, '), size, F.lit("}\n```")),
        F.concat(F.lit('{"k" '), k, F.lit(' "name": "'), name, F.lit('"}')),
        F.concat(F.lit('So:\n```json\n{"name": "'), name, F.lit('", "k": '), k),
    ]
    text = F.element_at(F.array(*texts), (F.col("p_size") % 6).cast("int") + 1)
    got = json_block(text, "k bigint, name string, sizes array<bigint>")
    return table(spark, d, "part").select("p_partkey", got.alias("j")).select("p_partkey", "j.k", "j.name", F.aggregate("j.sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))

"""Registered queries of the engine's operators, each with SQL that gives the same rows.

Driver tables stand in for generated ones: a table's key is the row id that
draws depend on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.draws import MODULUS, salts
from weftline.functions.laws import tables
from weftline.functions.template import Compiler, with_documents
from weftline.operators import expressions as ex
from weftline.operators import profile as pr
from weftline.operators import samplers as sm
from weftline.operators.generate import approximate_tokens
from weftline.operators.people import person, sample_people
from weftline.operators.rollouts import from_turns
from weftline.operators.samplers import Constraint, Draw, SamplerSpec, redrawn
from weftline.operators.validate import code_block, json_block, sql_valid
from weftline.plans.config import Builder, ProcessorConfig, Skip
from weftline.plans.engine import Engine
from weftline.plans.planner import ROW, Planner
from weftline.sources.seeds import INDEX, IndexRange, PartitionBlock, attach, indexed, selected

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEED = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def u(column: str, draw: int | str = 0, row: str = "o_orderkey", seed: int = SEED) -> str:
    """A uniform draw in SQL."""
    s0, s1, s2 = salts(seed, column, draw)
    m, row = MODULUS, f"CAST({row} AS BIGINT)"
    h1 = f"((({row} % {m}) * 48271 + {s0} + (({row} // {m}) % {m}) * 7919) % {m})"
    h2 = f"((xor({h1}, {h1} >> 13) * 69621 + {s1}) % {m})"
    h3 = f"((xor({h2}, {h2} >> 16) * 1664525 + {s2}) % {m})"
    return f"((((xor({h3}, {h3} >> 15) * 39373) % {m}) + 0.5::DOUBLE) / {m}.0::DOUBLE)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def drawn(df: DataFrame, kind: str, params: dict[str, Any], name: str = "v", key: str = "o_orderkey", **more: Any) -> DataFrame:
    """The key and one sampler's column, finished."""
    spec = SamplerSpec(name, kind, params, **more)
    compiler = Compiler(df.schema, SEED, F.col(key))
    out = df.withColumn(name, spec.column(Draw(SEED, name, F.col(key)), compiler.condition))
    return out.select(key, spec.finished(F.col(name)).alias(name))


# ---- samplers

COLOURS = ["red", "green", "blue", "grey"]


@query(f"SELECT o_orderkey, list_extract(['red','green','blue','grey'], CAST(floor({u('v')} * 4) AS INT) + 1) AS v FROM orders")
def sample_category(spark, d):
    return drawn(orders(spark, d), "category", {"values": COLOURS})


@query(f"SELECT o_orderkey, CASE WHEN {u('v')} < 0.5 THEN 'red' WHEN {u('v')} < 0.75 THEN 'green' WHEN {u('v')} < 0.875 THEN 'blue' ELSE 'grey' END AS v FROM orders")
def sample_category_weighted(spark, d):
    return drawn(orders(spark, d), "category", {"values": COLOURS, "weights": [4, 2, 1, 1]})


@query(f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN list_extract(['fast','final'], CAST(floor({u('v')} * 2) AS INT) + 1)
 WHEN 'O' THEN list_extract(['open','over','off'], CAST(floor({u('v')} * 3) AS INT) + 1) WHEN 'P' THEN 'part' END AS v FROM orders""")
def sample_subcategory(spark, d):
    return drawn(orders(spark, d), "subcategory", {"category": "o_orderstatus", "values": {"F": ["fast", "final"], "O": ["open", "over", "off"], "P": ["part"]}})


@query(f"SELECT o_orderkey, round_even(-5.0 + 15.0 * {u('v')}, 3) + 0.0 AS v FROM orders")
def sample_uniform(spark, d):
    return drawn(orders(spark, d), "uniform", {"low": -5, "high": 10, "decimal_places": 3})


NORMAL = f"sqrt(-2.0 * ln({u('v')})) * cos(2 * pi() * {u('v', '0b')})"


@query(f"SELECT o_orderkey, round_even(50.0 + 10.0 * {NORMAL}, 3) AS v FROM orders")
def sample_gaussian(spark, d):
    return drawn(orders(spark, d), "gaussian", {"mean": 50, "stddev": 10, "decimal_places": 3})


@query(f"SELECT o_orderkey, CAST({u('v')} < 0.3 AS BIGINT) AS v FROM orders")
def sample_bernoulli(spark, d):
    return drawn(orders(spark, d), "bernoulli", {"p": 0.3})


@query(f"SELECT o_orderkey, round_even(CASE WHEN {u('v')} < 0.4 THEN 2.0 * -ln({u('v|mixture')}) ELSE 0.0 END, 4) AS v FROM orders")
def sample_bernoulli_mixture(spark, d):
    return drawn(orders(spark, d), "bernoulli_mixture", {"p": 0.4, "dist_name": "expon", "dist_params": {"scale": 2.0}, "decimal_places": 4})


@query("SELECT o_orderkey, CAST(len(list_filter([" + ", ".join(repr(x) for x in sm.binomial_cdf(6, 0.35)) + f"], lambda c: c <= {u('v')})) AS BIGINT) AS v FROM orders")
def sample_binomial(spark, d):
    return drawn(orders(spark, d), "binomial", {"n": 6, "p": 0.35})


@query("SELECT o_orderkey, CAST(len(list_filter([" + ", ".join(repr(x) for x in sm.poisson_cdf(3.5)) + f"], lambda c: c <= {u('v')})) AS BIGINT) AS v FROM orders")
def sample_poisson(spark, d):
    return drawn(orders(spark, d), "poisson", {"mean": 3.5})


@query(f"SELECT o_orderkey, round_even(1.0 + 3.0 * -ln({u('v')}), 4) AS v FROM orders")
def sample_expon(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "expon", "dist_params": {"loc": 1, "scale": 3}, "decimal_places": 4})


@query(f"SELECT o_orderkey, round_even(0.0 + 1.0 * ln({u('v')} / (1 - {u('v')})), 4) AS v FROM orders")
def sample_logistic(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "logistic", "decimal_places": 4})


@query(f"SELECT o_orderkey, round_even(0.0 + 1.0 * pow(-ln({u('v')}), 1/1.5), 4) AS v FROM orders")
def sample_weibull(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "weibull_min", "dist_params": {"c": 1.5}, "decimal_places": 4})


@query(f"SELECT o_orderkey, CAST(floor({u('v')} * 90.0) + 10 AS BIGINT) AS v FROM orders")
def sample_randint(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "randint", "dist_params": {"low": 10, "high": 100}})


def logit_sql(column: str = "v", draw: int | str = 0) -> str:
    return f"ln({u(column, draw)} / (1 - {u(column, draw)}))"


def table_sql(kind: str, *shapes: float) -> str:
    """A law's coordinate by its table, of each order's draw. The table is a row of its own, so that it is read once."""
    held = tables(kind, tuple(map(float, shapes)))[0]
    cells, at = held.sql("z").split("list_extract(")[1].split("], ")[0] + "]", held.sql("z")
    return f"(SELECT o_orderkey, {at.replace(cells, 'c')} AS y FROM (SELECT o_orderkey, {logit_sql()} AS z, {cells} AS c FROM orders))"


@query(f"SELECT o_orderkey, round_even(exp(y), 4) AS v FROM {table_sql('gamma', 2)}")
def sample_gamma(spark, d):
    """By a table of quantiles, as are the next three."""
    return drawn(orders(spark, d), "scipy", {"dist_name": "gamma", "dist_params": {"a": 2.0}, "decimal_places": 4})


@query(f"SELECT o_orderkey, round_even(1 / (1 + exp(-y)), 4) AS v FROM {table_sql('beta', 2, 5)}")
def sample_beta(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "beta", "dist_params": {"a": 2.0, "b": 5.0}, "decimal_places": 4})


@query(f"SELECT o_orderkey, round_even(10 + 0.5 * 2 * exp(y), 4) AS v FROM {table_sql('gamma', 1.5)}")
def sample_chi2(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "chi2", "dist_params": {"df": 3, "loc": 10, "scale": 0.5}, "decimal_places": 4})


@query(f"SELECT o_orderkey, round_even((exp(y) - exp(-y)) / 2, 4) AS v FROM {table_sql('t', 4)}")
def sample_t(spark, d):
    return drawn(orders(spark, d), "scipy", {"dist_name": "t", "dist_params": {"df": 4}, "decimal_places": 4})


@query(f"SELECT o_orderkey, concat('ID-', upper(substr(md5(concat_ws('|', '{SEED}|v|0', CAST(o_orderkey AS VARCHAR))), 1, 8))) AS v FROM orders")
def sample_uuid(spark, d):
    return drawn(orders(spark, d), "uuid", {"prefix": "ID-", "short_form": True, "uppercase": True})


@query(f"SELECT o_orderkey, strftime(date_trunc('hour', TIMESTAMP '2020-01-01' + to_seconds(CAST(floor({u('v')} * 94694400.0) AS BIGINT))), '%Y-%m-%dT%H:%M:%S') AS v FROM orders")
def sample_datetime(spark, d):
    return drawn(orders(spark, d), "datetime", {"start": "2020-01-01", "end": "2023-01-01", "unit": "h"})


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds((3 + CAST(floor({u('v')} * 27.0) AS BIGINT)) * 86400), '%d/%m/%Y') AS v FROM orders")
def sample_timedelta(spark, d):
    return drawn(orders(spark, d), "timedelta", {"dt_min": 3, "dt_max": 30, "unit": "D", "reference_column_name": "o_orderdate"}, convert_to="%d/%m/%Y")


@query(f"SELECT o_orderkey, CAST(round_even(100.0 * {u('v')}, 0) AS BIGINT) AS v FROM orders")
def sample_convert_int(spark, d):
    return drawn(orders(spark, d), "uniform", {"low": 0, "high": 100}, convert_to="int")


@query(f"""SELECT o_orderkey, round_even(CASE WHEN o_totalprice > 250000 THEN 10.0 + 10.0 * {u('v')} WHEN o_orderstatus = 'F' THEN 2.0 + 3.0 * {u('v')} ELSE 0.0 + 1.0 * {u('v')} END, 4) AS v FROM orders""")
def sample_conditional(spark, d):
    """Where two conditions hold, the later one's parameters are used."""
    return drawn(orders(spark, d), "uniform", {"low": 0, "high": 1, "decimal_places": 4}, conditional_params={"o_orderstatus == 'F'": {"low": 2, "high": 5}, "o_totalprice > 250000": {"low": 10, "high": 20}})


def tries_sql(n: int) -> str:
    return "[" + ", ".join(f"0.0 + 100.0 * {u('v', k)}" for k in range(n)) + "]"


def tried(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """As in production: 32 draws, further ones for rows that they all fail, then a draw from what the constraints leave."""
    spec = SamplerSpec("v", "uniform", {"low": 0, "high": 100})
    value = redrawn(spec, Draw(SEED, "v", F.col("o_orderkey")), constraints, Compiler(df.schema).condition)
    return df.select("o_orderkey", F.bround(value, 4).alias("v"))


@query(f"SELECT o_orderkey, round_even(list_filter({tries_sql(32)}, lambda x: x < 65 AND x >= 20)[1], 4) AS v FROM orders")
def constraint_scalar(spark, d):
    return tried(orders(spark, d), [Constraint("v", "lt", 65), Constraint("v", "ge", "20")])


@query(f"SELECT o_orderkey, round_even(list_filter({tries_sql(32)}, lambda x: x > o_custkey % 50)[1], 4) AS v FROM orders")
def constraint_column(spark, d):
    df = orders(spark, d).withColumn("low", F.col("o_custkey") % 50)
    return tried(df, [Constraint("v", "gt", "low")])


@query()
def sample_person(spark, d):
    """People drawn from small pools, with derived fields."""
    return orders(spark, d).select("o_orderkey", person({"age_range": [10, 80]}, Draw(SEED, "p", F.col("o_orderkey"))).alias("p")).select("o_orderkey", "p.*")


@query("""WITH fits AS (SELECT c_custkey, c_mktsegment, 18 + c_custkey % 60 AS age FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND 18 + c_custkey % 60 BETWEEN 25 AND 60),
 r AS (SELECT *, row_number() OVER (ORDER BY md5('11|p|' || c_custkey), c_custkey) - 1 AS place FROM fits), n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation)
 SELECT n_nationkey, c_custkey, c_mktsegment AS city, CAST(age AS BIGINT) AS age FROM n JOIN r USING (place)""")
def person_from_dataset(spark, d):
    people = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("city"), (F.lit(18) + F.col("c_custkey") % 60).alias("age"))
    rows = table(spark, d, "nation").select("n_nationkey")
    out = sample_people(people, rows, {"city": ["BUILDING", "MACHINERY"], "age_range": [25, 60]}, SEED, "p", "c_custkey", "n_nationkey")
    return out.select("n_nationkey", "p.c_custkey", "p.city", F.col("p.age").cast("long").alias("age"))


# ---- seeds


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    seeds = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return indexed(seeds, ["p_partkey"]), seeds.count()


P = "p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)"


@query(f"WITH {P}, z AS (SELECT max(n) AS n FROM p), o AS (SELECT o_orderkey, o_orderkey % z.n AS i FROM orders, z) SELECT o_orderkey, p_partkey, p_brand FROM o JOIN p USING (i)")
def seed_ordered_cycle(spark, d):
    seeds, size = parts(spark, d)
    return attach(orders(spark, d).select("o_orderkey"), seeds, size, row="o_orderkey")


@query(f"""WITH {P}, z AS (SELECT max(n) AS n FROM p), o AS (SELECT o_orderkey, o_orderkey // z.n AS c, o_orderkey % z.n AS place FROM orders, z),
 c AS (SELECT DISTINCT c FROM o), s AS (SELECT c, p_partkey, p_brand, row_number() OVER (PARTITION BY c ORDER BY md5('{SEED}|shuffle|' || c || '|' || i), i) - 1 AS place FROM p, c)
 SELECT o_orderkey, p_partkey, p_brand FROM o JOIN s USING (c, place)""")
def seed_shuffle(spark, d):
    seeds, size = parts(spark, d)
    return attach(orders(spark, d).select("o_orderkey"), seeds, size, "shuffle", SEED, "o_orderkey")


@query(f"WITH {P} SELECT p_partkey, p_brand, i - 10 AS place FROM p WHERE i BETWEEN 10 AND 109")
def seed_index_range(spark, d):
    seeds, size = parts(spark, d)
    return selected(seeds, IndexRange(10, 109), size)[0].withColumnRenamed(INDEX, "place")


@query(f"WITH {P} SELECT p_partkey, p_brand, i - 6 * (n // 7) AS place FROM p WHERE i >= 6 * (n // 7)")
def seed_partition_block(spark, d):
    """The last of seven blocks has what is left over too."""
    seeds, size = parts(spark, d)
    return selected(seeds, PartitionBlock(6, 7), size)[0].withColumnRenamed(INDEX, "place")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag || l_linestatus END AS l_shipmode FROM lineitem")
def batches_concatenated(spark, d):
    """Batches of different columns by name; what a batch lacks is null."""
    li = table(spark, d, "lineitem")
    one = li.where("l_linenumber % 2 = 1").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"))
    return one.unionByName(li.where("l_linenumber % 2 = 0").select("l_orderkey", "l_linenumber"), allowMissingColumns=True)


@query("SELECT n_nationkey, n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS j FROM region) ON i = j")
def frames_side_by_side(spark, d):
    left = indexed(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    right = indexed(table(spark, d, "region"), ["r_regionkey"]).select("r_name", INDEX)
    return left.join(right, INDEX).drop(INDEX)


# ---- templates, casts, drops, skips


def templated(df: DataFrame, keys: list[str], templates: dict[str, str]) -> DataFrame:
    df = with_documents(df, list(templates.values()))
    compiler = Compiler(df.schema, SEED, F.col(keys[0]))
    return df.select(*keys, *(compiler.render(t).alias(n) for n, t in templates.items()))


@query("SELECT o_orderkey, o_orderstatus || '-' || o_custkey || ': ' || CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS v FROM orders")
def expr_text(spark, d):
    return templated(orders(spark, d), ["o_orderkey"], {"v": "{{ o_orderstatus }}-{{ o_custkey }}: {% if o_totalprice > 200000 %}big{% elif o_totalprice > 100000 %}mid{% else %}small{% endif %}"})


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS v FROM events WHERE value IS NOT NULL")
def expr_cast_int(spark, d):
    """Rows without a value give text that is no number, and are dropped."""
    return ex.drop_marked(ex.expression(table(spark, d, "events"), "v", "{{ value }}", "int")).select("event_id", "v")


@query("SELECT o_orderkey, (o_orderkey % 3 <> 0) AS v, (o_orderstatus = 'F') AS w FROM orders")
def expr_bool(spark, d):
    df = ex.expression(orders(spark, d), "v", "{{ o_orderkey % 3 }}", "bool")
    return ex.drop_marked(ex.expression(df, "w", "{{ o_orderstatus == 'F' }}", "bool")).select("o_orderkey", "v", "w")


@query("SELECT o_orderkey, CAST(100 AS DOUBLE) / (o_orderkey % 4) AS v FROM orders WHERE o_orderkey % 4 <> 0")
def expr_row_drop(spark, d):
    """Division by 0 fails, and the row is dropped."""
    return ex.drop_marked(ex.expression(orders(spark, d), "v", "{{ 100 / (o_orderkey % 4) }}", "float")).select("o_orderkey", "v")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'v:render' WHEN o_orderkey % 4 = 1 THEN 'v:empty' WHEN o_orderkey % 4 = 2 THEN 'v:cast' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason")
def expr_drop_reasons(spark, d):
    template = "{% if o_orderkey % 4 == 0 %}{{ 1 / 0 }}{% elif o_orderkey % 4 == 1 %}  {% elif o_orderkey % 4 == 2 %}abc{% else %}7{% endif %}"
    return ex.drop_counts(ex.expression(orders(spark, d), "v", template, "int"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 + 1 AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def expr_json_path(spark, d):
    """Text that holds JSON is looked into by keys; rows without the key are dropped."""
    return ex.drop_marked(ex.expression(table(spark, d, "events"), "v", "{{ props.k * 2 + 1 }}", "int")).select("event_id", "v")


@query("""SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS cap, CAST(length(c_name) AS VARCHAR) AS len,
 replace(c_name, '#', ' no ') AS rep, reverse(c_mktsegment) AS rev, substr(c_name, 1, 1) AS fst, right(c_name, 1) AS lst, substr(c_name, 3, 4) AS sli, CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'y' ELSE 'n' END AS inn FROM customer""")
def filter_text(spark, d):
    t = {"up": "{{ c_mktsegment|upper }}", "low": "{{ c_mktsegment|lower }}", "cap": "{{ c_mktsegment|capitalize }}", "len": "{{ c_name|length }}", "rep": "{{ c_name|replace('#', ' no ') }}", "rev": "{{ c_mktsegment|reverse }}"}
    t |= {"fst": "{{ c_name|first }}", "lst": "{{ c_name|last }}", "sli": "{{ c_name[2:6] }}", "inn": "{{ 'y' if 'BUILD' in c_mktsegment else 'n' }}"}
    return templated(table(spark, d, "customer"), ["c_custkey"], t)


@query("""SELECT c_custkey, CAST(abs(c_custkey - 700) AS VARCHAR) AS a, CAST(CAST(round_even(c_acctbal, 1) AS DOUBLE) AS VARCHAR) AS r, CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS i,
 CAST(CAST(floor((c_custkey - 700) / 7) AS BIGINT) AS VARCHAR) AS q, CAST(c_custkey - 700 - 7 * CAST(floor((c_custkey - 700) / 7) AS BIGINT) AS VARCHAR) AS m, CAST(c_custkey * c_custkey AS VARCHAR) AS p FROM customer""")
def filter_numbers(spark, d):
    """Floor division and remainder go down for negative numbers."""
    t = {"a": "{{ (c_custkey - 700)|abs }}", "r": "{{ c_acctbal|round(1) }}", "i": "{{ c_acctbal|int }}", "q": "{{ (c_custkey - 700) // 7 }}", "m": "{{ (c_custkey - 700) % 7 }}", "p": "{{ c_custkey ** 2 }}"}
    return templated(table(spark, d, "customer"), ["c_custkey"], t)


@query("""SELECT n_nationkey, replace(replace(replace('<' || n_name || ' & co>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e, replace(n_name, ' ', '%20') || '/x' AS q,
 'b,a' AS s, '3' AS mx, CASE WHEN length(n_name) > 9 THEN substr(n_name, 1, 4) || '...' ELSE n_name END AS t FROM nation""")
def filter_escapes(spark, d):
    t = {"e": "{{ ('<' ~ n_name ~ ' & co>')|escape }}", "q": "{{ (n_name ~ '/x')|urlencode }}", "s": "{{ ['a', 'B', 'b', 'A']|unique|sort(true)|join(',')|lower }}", "mx": "{{ [1, 3, 2]|max }}", "t": "{{ n_name|truncate(7, true, '...', 2) }}"}
    return templated(table(spark, d, "nation"), ["n_nationkey"], t)


@query("SELECT n_nationkey, '[1:' || n_name || '][2:x]' AS v, CASE WHEN n_regionkey IN (1, 2) THEN 'True' ELSE 'False' END AS w FROM nation")
def expr_loop(spark, d):
    return templated(table(spark, d, "nation"), ["n_nationkey"], {"v": "{% for x in [n_name, 'x'] %}[{{ loop.index }}:{{ x }}]{% endfor %}", "w": "{{ n_regionkey in [1, 2] }}"})


@query(f"SELECT n_nationkey, list_extract(['x','y','z'], CAST(floor({u('template', 1, 'n_nationkey')} * 3) AS INT) + 1) AS v FROM nation")
def filter_random(spark, d):
    return templated(table(spark, d, "nation"), ["n_nationkey"], {"v": "{{ ['x', 'y', 'z']|random }}"})


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '[]' ELSE '[' || json_extract_string(props, '$.k') || ']' END AS v FROM events")
def filter_jsonpath(spark, d):
    return templated(table(spark, d, "events"), ["event_id"], {"v": "{{ props|jsonpath('$.k') }}"})


def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns: b is skipped for finished orders, c needs b and is skipped with it, e needs b and isn't."""
    b = Builder(SEED)
    b.add_column(name="b", kind="expression", expr="{{ o_custkey }}", dtype="int", skip=Skip("o_orderstatus == 'F'", -1))
    b.add_column(name="c", kind="expression", expr="{{ b + 1 }}", dtype="int")
    b.add_column(name="e", kind="expression", expr="{{ b + 2 }}", dtype="int", propagate_skip=False)
    rows = orders(spark, sf_dir).withColumns({ROW: F.col("o_orderkey"), "_row_group": F.lit(0)})
    return Planner(spark, b.build()).marked(rows)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_custkey END AS b FROM orders")
def skip_gate(spark, d):
    return skipped(spark, d).select("o_orderkey", "b")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey + 1 END AS c, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE o_custkey + 2 END AS e FROM orders")
def skip_propagate(spark, d):
    return skipped(spark, d).select("o_orderkey", "c", "e")


@query("SELECT o_orderkey, o_custkey FROM orders")
def drop_columns_glob(spark, d):
    return ex.drop_columns(orders(spark, d), ["o_order[dsp]*", "*price"])[0]


@query("SELECT '{\"id\":' || '\"' || o_orderkey || '\",\"tags\":[\"' || o_orderstatus || '\",\"x\"]}' AS doc FROM orders")
def schema_transform(spark, d):
    return ex.schema_transform(orders(spark, d), {"doc": {"id": "{{ o_orderkey }}", "tags": ["{{ o_orderstatus }}", "x"]}}).select(F.to_json("doc").alias("doc"))


# ---- profile


@query("""SELECT column_name, n AS num_records, z AS num_null, q AS num_unique, round(100 * z / (n + 1e-8), 2) AS percent_null, round(100 * q / (n + 1e-8), 2) AS percent_unique, t AS simple_dtype FROM (
 SELECT 'l_returnflag' AS column_name, 'string' AS t, count(*) AS n, count(*) FILTER (l_returnflag IS NULL) AS z, count(DISTINCT l_returnflag) AS q FROM lineitem UNION ALL
 SELECT 'l_quantity', 'float', count(*), count(*) FILTER (l_quantity IS NULL), count(DISTINCT l_quantity) FROM lineitem UNION ALL
 SELECT 'l_suppkey', 'int', count(*), count(*) FILTER (l_suppkey IS NULL), count(DISTINCT l_suppkey) FROM lineitem)""")
def profile_general(spark, d):
    return pr.general(table(spark, d, "lineitem"), ["l_returnflag", "l_quantity", "l_suppkey"])


@query("""SELECT * FROM (SELECT 'l_quantity' AS column_name, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS stddev, median(l_quantity) AS median FROM lineitem UNION ALL
 SELECT 'l_discount', min(l_discount), max(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), median(l_discount) FROM lineitem)""")
def profile_numeric(spark, d):
    return pr.numerical(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("""SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INT) AS rank FROM (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL
 SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL)""")
def profile_categorical(spark, d):
    return pr.categorical(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT round(avg(n), 6) AS mean, median(n) AS median, round(stddev_samp(n), 6) AS stddev FROM (SELECT CAST(n_chars AS DOUBLE) AS n FROM documents)")
def profile_output_tokens(spark, d):
    """Over all rows, with n_chars as the count."""
    return pr.output_tokens(table(spark, d, "documents"), F.col("n_chars")).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6), "median": F.col("median").cast("double")})


@query("SELECT round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 6) AS stddev FROM (SELECT CAST(n_chars AS DOUBLE) AS n FROM documents ORDER BY md5('42|tokens|' || doc_id) LIMIT 1000)")
def profile_token_lengths(spark, d):
    """The input side's statistics are over at most 1000 rows by their definition."""
    return pr.input_tokens(table(spark, d, "documents"), F.col("n_chars"), key="doc_id").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6), "median": F.col("median").cast("double")})


@query()
def token_counts(spark, d):
    """Approximate counts where no vocabulary is at hand."""
    return table(spark, d, "documents").select("doc_id", approximate_tokens(F.col("text")).alias("n_tokens"))


@query("SELECT count(*) AS num_records, count(*) FILTER (coalesce(value > 50, false)) AS num_valid, round(100 * count(*) FILTER (coalesce(value > 50, false)) / (count(*) + 1e-8), 2) AS percent_valid FROM events")
def profile_validation(spark, d):
    return pr.valid_counts(table(spark, d, "events").select(F.struct((F.col("value") > 50).alias("is_valid")).alias("v")), "v")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.struct(F.col(c).alias("score"), F.lit("why").alias("reasoning"))
    return table(spark, sf_dir, "labels").select("doc_id", F.struct(one("quality").alias("quality"), one("toxic").alias("toxic")).alias("j"))


@query("SELECT name, score, n, true AS is_numerical FROM (SELECT 'quality' AS name, CAST(quality AS VARCHAR) AS score, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY ALL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels WHERE toxic IS NOT NULL GROUP BY ALL)")
def judge_distribution(spark, d):
    return pr.judge_distribution(pr.judge_scores(judged(spark, d), "j", ["quality", "toxic"]))


@query(f"WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id, quality FROM labels JOIN c USING (quality) ORDER BY -ln({u('stratified', 0, 'doc_id')}) / n, doc_id LIMIT 50")
def judge_stratified_sample(spark, d):
    return pr.stratified(table(spark, d, "labels").select("doc_id", "quality"), 50, SEED, "doc_id", "quality")


# ---- validation, extraction


@query("""SELECT p_partkey, NOT (p_partkey % 3 = 0) AS is_valid FROM part""")
def validate_decimal_ddl(spark, d):
    code = F.when(F.col("p_partkey") % 3 == 0, "CREATE TABLE t (a DECIMAL(10))").when(F.col("p_partkey") % 3 == 1, "CREATE TABLE t (a DECIMAL(10, 2), b TEXT)").otherwise("SELECT 'DECIMAL(5)' FROM t")
    return table(spark, d, "part").select("p_partkey", sql_valid(code)["is_valid"].alias("is_valid"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x = ' || p_partkey END AS code FROM part")
def extract_code_block(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Sure:\n```python\ny = 0\n```\nand\n```python\nx = "), F.col("p_partkey").cast("string"), F.lit("\n```\n"))).otherwise("no code")
    return table(spark, d, "part").select("p_partkey", code_block(text, "python").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN p_partkey END AS k FROM part")
def extract_json_block(spark, d):
    """A fenced block, bare JSON with a trailing comma, and text without JSON."""
    k = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"k": '), k, F.lit("}\n```"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('It is {"k": '), k, F.lit(",} ok"))).otherwise("nothing")
    return table(spark, d, "part").select("p_partkey", json_block(text, "k bigint")["k"].alias("k"))


@query("SELECT conv_id, count(*) AS message_count, arg_max(text, turn) FILTER (role = 'assistant') AS final_assistant_message FROM conversations GROUP BY conv_id")
def rollout_normalize(spark, d):
    return from_turns(table(spark, d, "conversations"))


@query("SELECT vec_id, CAST(1 AS BIGINT) AS num_embeddings, CAST(len(embedding) AS BIGINT) AS dimension FROM embeddings")
def embedding_shape(spark, d):
    e = F.struct(F.array("embedding").alias("embeddings"))
    return table(spark, d, "embeddings").select("vec_id", F.size(e["embeddings"]).cast("long").alias("num_embeddings"), F.size(F.get(e["embeddings"], 0)).cast("long").alias("dimension"))


# ---- runs


#: Orders numbered as a config seeded by them numbers its rows.
NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)"


def seeded(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[Builder, int]:
    """A config seeded by all orders in order of their keys, and how many they are."""
    held = table(spark, sf_dir, "orders")
    return Builder(SEED).with_seed(held.select("o_orderkey", *columns), order_by=["o_orderkey"]), held.count()


@query(f"SELECT r // 1000 AS _row_group, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM {NUMBERED} GROUP BY 1")
def row_group_sizes(spark, d):
    b, n = seeded(spark, d)
    return Planner(spark, b.build(), buffer_size=1000).plan(n).groupBy("_row_group").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query(f"SELECT r, o_orderkey, list_extract(['a','b','c'], CAST(floor({u('k', 0, 'r')} * 3) AS INT) + 1) AS k, round_even(0.0 + 10.0 * {u('x', 0, 'r')}, 3) AS x FROM {NUMBERED} WHERE r // 100 % 2 = 1")
def resume_missing_groups(spark, d):
    """Every second group is missing; its rows are those that the whole run would have made."""
    b, n = seeded(spark, d)
    b.add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b", "c"]})
    b.add_column(name="x", kind="sampler", sampler_type="uniform", params={"low": 0, "high": 10, "decimal_places": 3})
    return Planner(spark, b.build(), buffer_size=100).plan(n, groups=list(range(1, -(-n // 100), 2))).select(F.col(ROW).alias("r"), "o_orderkey", "k", "x")


def flagship_config(orders_df: DataFrame) -> Builder:
    b = Builder(SEED)
    b.with_seed(orders_df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), order_by=["o_orderkey"])
    b.add_column(name="tier", kind="sampler", sampler_type="category", params={"values": ["gold", "silver", "bronze"], "weights": [1, 2, 5]})
    b.add_column(name="score", kind="sampler", sampler_type="gaussian", params={"mean": 50, "stddev": 15, "decimal_places": 2})
    b.add_column(name="discount", kind="sampler", sampler_type="uniform", params={"low": 0, "high": 5, "decimal_places": 2}, conditional_params={"tier == 'gold'": {"low": 10, "high": 20}})
    b.add_column(name="label", kind="expression", expr="{{ tier|upper }}-{{ o_orderkey }}{% if o_totalprice > 200000 %}!{% endif %}")
    b.add_column(name="net", kind="expression", expr="{{ o_totalprice * (100 - discount) / 100 }}", dtype="float", skip=Skip("o_orderstatus == 'P'", None))
    b.add_processor(ProcessorConfig("trim", "drop_columns", ["o_totalprice"]))
    return b


_R = u("tier", 0, "r")
_TIER = f"CASE WHEN {_R} < 0.125 THEN 'gold' WHEN {_R} < 0.375 THEN 'silver' ELSE 'bronze' END"
_D = u("discount", 0, "r")


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), t AS (SELECT *, {_TIER} AS tier FROM o),
 s AS (SELECT *, round_even(CASE WHEN tier = 'gold' THEN 10.0 + 10.0 * {_D} ELSE 0.0 + 5.0 * {_D} END, 2) AS discount, round_even(50.0 + 15.0 * (sqrt(-2.0 * ln({u('score', 0, 'r')})) * cos(2 * pi() * {u('score', '0b', 'r')})), 2) AS score FROM t)
 SELECT o_orderkey, o_custkey, o_orderstatus, tier, score, discount, upper(tier) || '-' || o_orderkey || CASE WHEN o_totalprice > 200000 THEN '!' ELSE '' END AS label, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * (100 - discount) / 100 END AS net FROM s""")
def dataset_flagship(spark, d):
    """A seeded dataset with samplers, conditional parameters, expressions and a dropped column."""
    df = orders(spark, d)
    config = flagship_config(df).build()
    planner = Planner(spark, config)
    made = planner.plan(df.count())
    return Engine(spark).finish(config, made)[0].drop(ROW, "_row_group")


from weftline import queries_more, queries_values  # noqa: E402, F401  register further queries, which use what is above

"""More registered queries: sources, people, generated columns, validation, processors, runs and workflows, each with its SQL.

Runs write to the shared folder of the session and read back what they wrote.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.template import references
from weftline.operators import people as pe
from weftline.operators import profile as pr
from weftline.operators.generate import EchoClient, drawn_parameters, fitted_score, media_format, usage_totals
from weftline.operators.rollouts import MESSAGE, parsed_rollouts
from weftline.operators.samplers import Draw
from weftline.operators.validate import conforms, list_of_text, pruned, validate_code, validate_local, validate_remote
from weftline.plans.config import Builder, ProcessorConfig, Skip, lint
from weftline.plans.engine import GROUP, PROCESSORS, Engine, Folder, Processor, RunConfig, Workflow, register_processor
from weftline.plans.planner import COLUMN_KINDS, ROW, Planner, Resources, register_column_kind
from weftline.queries import NUMBERED, ORACLE, SEED, drawn, indexed, orders, query, seeded, table, templated, u
from weftline.sources.media import IMAGE_MANIFEST
from weftline.sources.seeds import READERS, DirectorySource, FileContentsSource, HubSource, IndexRange, LocalFileSource, hydrate, register_reader, selected
from weftline.sources.shared import shared_root


def folder(spark: SparkSession, what: str) -> str:
    """A new folder for what a query writes, deleted when the process ends."""
    path = f"{shared_root(spark)}/weftline-{what}-{uuid.uuid4().hex}"
    at = Folder(spark, path)
    at.fs.mkdirs(at.jpath(path))
    at.fs.deleteOnExit(at.jpath(path))
    return path


# ---- sources


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_parquet(spark, d):
    return LocalFileSource(f"{d}/nation.parquet").read(spark)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    """Types are inferred from the text."""
    path = folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.mode("overwrite").csv(path, header=True)
    return LocalFileSource(f"{path}/*.csv").read(spark)


@query("SELECT n_nationkey, n_name FROM nation")
def scan_hub(spark, d):
    return HubSource("team/nation.parquet", lambda p: f"{d}/{p.split('/')[-1]}").read(spark).select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region")
def reader_registry(spark, d):
    """A reader of a kind of its own, registered and found by its name."""

    class Regions:
        def __init__(self, path: str) -> None:
            self.path = path

        def read(self, spark: SparkSession) -> DataFrame:
            return spark.read.parquet(f"{self.path}/region.parquet")

    if "regions" not in READERS:
        register_reader("regions", Regions)
    return READERS["regions"](d).read(spark)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT 'directory_file' AS source_kind, t || '.parquet' AS file_name, t || '.parquet' AS relative_path FROM (SELECT unnest([{', '.join(map(repr, TABLES))}]) AS t)")
def directory_listing(spark, d):
    return DirectorySource(d, "*.parquet", recursive=False).read(spark).select("source_kind", "file_name", "relative_path")


@query("SELECT string_agg(r_regionkey || ' ' || r_name || chr(10), '' ORDER BY r_regionkey) AS content, 'file_contents' AS source_kind FROM region")
def file_contents(spark, d):
    path = folder(spark, "contents")
    lines = table(spark, d, "region").orderBy("r_regionkey").select(F.concat_ws(" ", F.col("r_regionkey").cast("string"), "r_name").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
    return FileContentsSource(path, "part-*").read(spark).select("content", "source_kind")


@query("SELECT column_name FROM (DESCRIBE orders)")
def schema_probe(spark, d):
    return spark.createDataFrame([(c,) for c in orders(spark, d).columns], "column_name string")


@query("SELECT n_nationkey, n_name, k FROM (SELECT n_nationkey, n_name, unnest(range(n_regionkey + 1)) AS k FROM nation WHERE n_nationkey BETWEEN 3 AND 20)")
def manifest_hydrate(spark, d):
    """The selection is of the manifest; each of its rows becomes as many as its region's number and one."""
    manifest, _ = selected(indexed(table(spark, d, "nation"), ["n_nationkey"]), IndexRange(3, 20), 25)
    return hydrate(manifest, lambda r: [{"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], "k": k} for k in range(r["n_regionkey"] + 1)], "n_nationkey int, n_name string, k long")


def sessions(spark: SparkSession, sf_dir: str, turn: Column, head: Column | None, ext: str, wrap: tuple[str, str, str] = ("", "\n", "")) -> DataFrame:
    """Every conversation as a file of one of the rollout formats: (path, content)."""
    c = table(spark, sf_dir, "conversations").withColumn("line", turn)
    first = [head] if head is not None else []
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    text = F.concat(F.lit(wrap[0]), F.concat_ws(wrap[1], *first, F.array_join(lines, wrap[1])), F.lit(wrap[2]))
    return c.groupBy("conv_id").agg(text.alias("text")).select(F.concat(F.lit("/s/session_"), F.col("conv_id").cast("string"), F.lit(ext)).alias("path"), F.encode("text", "UTF-8").alias("content"))


def told(df: DataFrame) -> DataFrame:
    return df.select("trace_id", "source_kind", "message_count", "tool_call_count", "final_assistant_message")


def rollout_sql(kind: str, roles: str = "true", more: int = 0) -> str:
    return f"SELECT 'c' || conv_id AS trace_id, '{kind}' AS source_kind, count(*) + {more} AS message_count, CAST(0 AS BIGINT) AS tool_call_count, arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS final_assistant_message FROM conversations WHERE {roles} GROUP BY conv_id"


def session() -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"))


@query(rollout_sql("atif"))
def rollout_atif(spark, d):
    step = F.to_json(F.struct(F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("step_id"), F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("source"), F.col("text").alias("message")))
    files = sessions(spark, d, step, None, ".json", ("[", ",", "]"))
    name = F.concat(F.lit("c"), F.regexp_extract("path", r"(\d+)\.json", 1))
    whole = F.concat(F.lit('{"schema_version":"1","agent":{"name":"a"},"session_id":"'), name, F.lit('","steps":'), F.decode("content", "UTF-8"), F.lit("}"))
    return told(parsed_rollouts(files.withColumn("content", F.encode(whole, "UTF-8")), "atif"))


@query(rollout_sql("claude_code", "role IN ('user', 'assistant')"))
def rollout_claude_code(spark, d):
    """System rows are no messages of this format; the list of sessions tells each one's project."""
    line = F.to_json(F.struct(F.col("role").alias("type"), session().alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    files = sessions(spark, d, line, None, ".jsonl")
    entry = F.struct(session().alias("sessionId"), F.lit("/p").alias("projectPath"))
    listed = table(spark, d, "conversations").select(entry.alias("e")).distinct().agg(F.encode(F.to_json(F.struct(F.collect_list("e").alias("entries"))), "UTF-8").alias("content")).select(F.lit("/s/sessions-index.json").alias("path"), "content")
    return told(parsed_rollouts(files, "claude_code", listed).where("project_path = '/p'"))


@query(rollout_sql("codex"))
def rollout_codex(spark, d):
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.col("text").alias("content")).alias("payload")))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.first(session()).alias("id")).alias("payload")))
    return told(parsed_rollouts(sessions(spark, d, line, head, ".jsonl"), "codex"))


_TALK = """SELECT conv_id, turn, 0 AS part, role, coalesce(text, '') AS content, NULL AS thought, NULL AS call_id, NULL AS arguments FROM conversations WHERE role <> 'assistant'
UNION ALL SELECT conv_id, turn, 0, 'assistant', '', 'why ' || turn || chr(10) || chr(10) || 'aside', 'k' || turn, coalesce(text, '{}') FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 1, 'tool', coalesce(text, ''), NULL, 'k' || turn, NULL FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 2, role, coalesce(text, ''), NULL, NULL, NULL FROM conversations WHERE role = 'assistant'"""


@query(f"SELECT 'c' || conv_id AS trace_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS INT) AS place, role, content, thought, call_id, arguments, strftime(TIMESTAMP '2025-01-01' + to_seconds(CAST(min(turn) OVER (PARTITION BY conv_id) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS started_at FROM ({_TALK})")
def rollout_messages(spark, d):
    """Every message of rollouts in which assistants think, patch a file, see what came of it and answer."""
    said, key = F.col("text"), F.concat(F.lit("k"), F.col("turn").cast("string"))
    when = F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda kind, **p: F.to_json(F.struct(when.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in p.items())).alias("payload")))
    why = F.array(F.struct(F.concat(F.lit("why "), F.col("turn").cast("string")).alias("text")))
    talk = line("response_item", type="message", role=F.col("role"), content=said)
    acts = [line("response_item", type="reasoning", summary=why), line("event_msg", type="agent_reasoning", text="aside"), line("response_item", type="apply_patch_call", call_id=key, name="patch", input=said), line("response_item", type="apply_patch_call_output", call_id=key, output=said), line("event_msg", type="token_count")]
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.first(session()).alias("id")).alias("payload")))
    files = sessions(spark, d, F.when(F.col("role") == "assistant", F.concat_ws("\n", *acts, talk)).otherwise(talk), head, ".jsonl")
    each = parsed_rollouts(files, "codex").select("trace_id", "started_at", F.posexplode(F.from_json("messages", f"array<{MESSAGE}>")).alias("place", "m"))
    call = F.get("m.tool_calls", F.lit(0))
    return each.select("trace_id", "place", "m.role", "m.content", F.col("m.reasoning_content").alias("thought"), F.coalesce(call["id"], F.col("m.tool_call_id")).alias("call_id"), call["function"]["arguments"].alias("arguments"), "started_at")


@query(rollout_sql("hermes_agent", more=1))
def rollout_hermes(spark, d):
    """A session file's system prompt is its first message."""
    files = sessions(spark, d, F.to_json(F.struct("role", F.col("text").alias("content"))), None, ".json", ("[", ",", "]"))
    name = F.concat(F.lit("c"), F.regexp_extract("path", r"(\d+)\.json", 1))
    whole = F.concat(F.lit('{"session_id":"'), name, F.lit('","system_prompt":"s","messages":'), F.decode("content", "UTF-8"), F.lit("}"))
    return told(parsed_rollouts(files.withColumn("content", F.encode(whole, "UTF-8")), "hermes_agent"))


@query(rollout_sql("pi_coding_agent"))
def rollout_pi(spark, d):
    key = F.format_string("%d", F.col("turn"))
    line = F.to_json(F.struct(F.lit("message").alias("type"), key.alias("id"), F.when(F.col("turn") > 0, F.format_string("%d", F.col("turn") - 1)).alias("parentId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.first(session()).alias("id")))
    return told(parsed_rollouts(sessions(spark, d, line, head, ".jsonl"), "pi_coding_agent"))


# ---- people


@query("SELECT o_orderkey, strftime(CAST(start AS DATE) + CAST(floor(" + u("v") + " * (date_diff('day', start, stop) + 1)) AS INT), '%Y-%m-%d') AS v FROM (SELECT o_orderkey, stop, CAST(stop - INTERVAL 12 MONTH AS DATE) + 1 AS start FROM (SELECT o_orderkey, CAST(DATE '2025-01-01' - to_months(CAST(12 * (o_custkey % 80) AS INT)) AS DATE) AS stop FROM orders))")
def person_birth_date(spark, d):
    age = (F.col("o_custkey") % 80).cast("int")
    return orders(spark, d).select("o_orderkey", F.date_format(pe.birth_date(age, Draw(SEED, "v", F.col("o_orderkey")).u(), "2025-01-01"), "yyyy-MM-dd").alias("v"))


def pool(name: str, values: list[str], column: str = "p") -> str:
    return f"list_extract({values!r}, CAST(floor({u(column, '0' + name)} * {len(values)}) AS INT) + 1)"


def email_sql(first: str, last: str, age: str, born: str, column: str, row: str) -> str:
    f, s = (f"regexp_replace(translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g')" for x in (first, last))
    draw = lambda part: u(column, "0" + part, row)
    names = {"first.last": f"{f} || '.' || {s}", "firstlast": f"{f} || {s}", "flast": f"left({f}, 1) || {s}", "first_last": f"{f} || '_' || {s}", "lastf": f"{s} || left({f}, 1)", "firstl": f"{f} || left({s}, 1)"}
    endings = {"none": "''", "number": f"CAST(CAST(1 + floor({draw('mail number')} * 99) AS BIGINT) AS VARCHAR)", "short year": f"strftime({born}, '%y')", "year": f"strftime({born}, '%Y')", "day": f"CAST(day({born}) AS VARCHAR)"}
    choose = lambda kind, of: f"CASE {kind} {' '.join(f'WHEN {k!r} THEN {x}' for k, x in of.items())} END"
    domain = pe.DOMAIN_OF.sql(f"CASE WHEN {age} < 30 THEN '0' WHEN {age} < 50 THEN '30' ELSE '50' END", draw("mail domain"))
    return f"CASE WHEN {age} >= 18 THEN ({choose(pe.NAME_OF.sql(repr('two'), draw('mail name')), names)}) || ({choose(pe.ENDING_OF.sql(repr(''), draw('mail end')), endings)}) || '@' || ({domain}) END"


def phone_sql(age: str, postcode: str, column: str, row: str) -> str:
    draw = lambda part: u(column, "0" + part, row)
    near = f"(CASE {pe.NEAR_OF.sql(repr(''), draw('phone near'))} WHEN 'postcode' THEN {postcode} WHEN 'four' THEN left({postcode}, 4) WHEN 'three' THEN left({postcode}, 3) ELSE '' END)"
    known = "(" + ", ".join(repr(k) for k in pe.AREAS.groups) + ")"
    chosen = " ".join(f"WHEN {k} IN {known} THEN {k}" for k in (near, f"left({near}, 4)", f"left({near}, 3)"))
    area = pe.AREAS.sql(f"CASE {chosen} ELSE '' END", draw("phone area"))
    return f"CASE WHEN {age} >= 18 AND {postcode} IS NOT NULL THEN {area} || '-' || CAST(CAST(200 + floor({draw('phone office')} * 800) AS BIGINT) AS VARCHAR) || '-' || lpad(CAST(CAST(floor({draw('phone line')} * 10000) AS BIGINT) AS VARCHAR), 4, '0') END"


def national_id_sql(state: str, born: str, column: str, row: str) -> str:
    draw = lambda part: u(column, "0" + part, row)
    of = f"(CASE WHEN {born} < DATE '{pe.RANDOM_SINCE}' THEN coalesce(MAP {{{', '.join(f'{k!r}: [{a}, {b}]' for k, (a, b) in pe.STATE_AREAS.items())}}}[{state}], [1, 899]) ELSE [1, 899] END)"
    holds = f"CAST({of}[1] <= 666 AND {of}[2] >= 666 AS INT)"
    area = f"({of}[1] + CAST(floor({draw('id area')} * ({of}[2] - {of}[1] + 1 - {holds})) AS INT))"
    return f"CASE WHEN {state} IS NOT NULL THEN printf('%03d-%02d-%04d', CASE WHEN {holds} = 1 AND {area} >= 666 THEN {area} + 1 ELSE {area} END, CAST(1 + floor({draw('id group')} * 99) AS INT), CAST(1 + floor({draw('id serial')} * 9999) AS INT)) END"


_CODES, _STATES = [p[2] for p in pe.PLACES] + ["60699", "99999"], [p[1] for p in pe.PLACES] + ["NA", "PR"]


@query(f"""WITH c AS (SELECT c_custkey, n_name, c_mktsegment, CAST(10 + c_custkey % 60 AS INT) AS age, DATE '1955-03-01' + CAST(c_custkey * 37 % 24000 AS INT) AS born, list_extract({_CODES!r}, CAST(c_custkey % {len(_CODES)} AS INT) + 1) AS code, list_extract({_STATES!r}, CAST(c_custkey % {len(_STATES)} AS INT) + 1) AS state FROM customer JOIN nation ON n_nationkey = c_nationkey)
 SELECT c_custkey, {email_sql('n_name', 'c_mktsegment', 'age', 'born', 'e', 'c_custkey')} AS email, {phone_sql('age', 'code', 'e', 'c_custkey')} AS phone, {national_id_sql('state', 'born', 'e', 'c_custkey')} AS national_id FROM c""")
def person_contacts(spark, d):
    """Email by age, phone by post code and people, national id by state and birth date, from tables of conditional weights."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    born = F.date_add(F.lit("1955-03-01").cast("date"), (F.col("c_custkey") * 37 % 24000).cast("int"))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int") + 1)
    draw, age = Draw(SEED, "e", F.col("c_custkey")), (10 + F.col("c_custkey") % 60).cast("int")
    return c.select("c_custkey", pe.email(F.col("n_name"), F.col("c_mktsegment"), age, born, draw).alias("email"), pe.phone(age, at(_CODES), draw).alias("phone"), pe.national_id(at(_STATES), born, draw).alias("national_id"))


def person_sql() -> str:
    sex = f"CASE WHEN {u('p', '0sex')} < 0.5 THEN 'Female' ELSE 'Male' END"
    total, run, education = sum(pe.EDUCATION.values()), 0.0, ""
    for name, weight in list(pe.EDUCATION.items())[:-1]:
        run += weight / total
        education += f" WHEN {u('p', '0education')} < {run!r} THEN '{name}'"
    education = f"CASE{education} ELSE '{list(pe.EDUCATION)[-1]}' END"
    place = lambda i: pool("place", [p[i] for p in pe.PLACES])
    end = "CAST(DATE '2025-01-01' - to_months(12 * age) AS DATE)"
    start = f"CAST({end} - INTERVAL 12 MONTH AS DATE) + 1"
    return f"""WITH a AS (SELECT o_orderkey, CAST(10 + floor({u('p', '0age')} * 71) AS INT) AS age, {sex} AS sex, {pool('last', pe.LAST)} AS last_name, {education} AS education_level, {place(0)} AS city, {place(1)} AS state, {place(2)} AS postcode FROM orders),
 b AS (SELECT *, CASE WHEN sex = 'Female' THEN {pool('first', pe.FIRST['Female'])} ELSE {pool('first', pe.FIRST['Male'])} END AS first_name, {start} + CAST(floor({u('p', '0birth')} * (date_diff('day', {start}, {end}) + 1)) AS INT) AS born FROM a)
 SELECT o_orderkey, md5('{SEED}|p|person|' || o_orderkey) AS uuid, 'en_US' AS locale, first_name, last_name, sex, CAST(CAST(1 + floor({u('p', '0number')} * 999) AS BIGINT) AS VARCHAR) AS street_number, {pool('street', pe.STREETS)} AS street_name,
 city, state, postcode, age, strftime(born, '%Y-%m-%d') AS birth_date, 'USA' AS country,
 {pool('marital', pe.MARITAL)} AS marital_status, education_level, CASE WHEN education_level IN ('university', 'doctorate') THEN {pool('field', pe.FIELDS)} ELSE 'none' END AS bachelors_field, {pool('job', pe.JOBS)} AS occupation,
 {email_sql('first_name', 'last_name', 'age', 'born', 'p', 'o_orderkey')} AS email_address, {phone_sql('age', 'postcode', 'p', 'o_orderkey')} AS phone_number, {national_id_sql('state', 'born', 'p', 'o_orderkey')} AS national_id FROM b"""


ORACLE["sample_person"] = person_sql()


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a managed people dataset, with a column that isn't taken over and one without values."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uuid"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("occupation"), (F.lit(18) + F.col("c_custkey") % 60).alias("age"), F.concat(F.lit("R"), F.col("c_nationkey").cast("string")).alias("region"), F.lit(None).cast("string").alias("middle_name"), F.lit("x").alias("unlisted"), F.lit("calm").alias("persona"))


@query("SELECT 'u' || c_custkey AS uuid, c_name AS first_name, 18 + c_custkey % 60 AS age, 'R' || c_nationkey AS region, c_mktsegment AS occupation, 'en_US' AS locale, 'calm' AS persona FROM customer")
def person_fields(spark, d):
    """Known fields and personas; fields without values and unknown ones are left out."""
    return pe.projected(people(spark, d), personas=True)


@query(f"""WITH fits AS (SELECT *, 'u' || c_custkey AS uuid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND 18 + c_custkey % 60 BETWEEN 20 AND 70), r AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|p|' || uuid), uuid) - 1 AS r FROM fits)
 SELECT r, 'Dear ' || c_name AS greeting, 18 + c_custkey % 60 AS age, 'R' || c_nationkey AS state FROM r WHERE r < 20""")
def person_managed(spark, d):
    """People of a managed dataset in a config, without repeats; the region is called state for this locale."""
    b = Builder(SEED).add_column(name="p", kind="sampler", sampler_type="person", params={"select_field_values": {"occupation": ["BUILDING", "MACHINERY"]}, "age_range": [20, 70]})
    b.add_column(name="greeting", kind="expression", expr="Dear {{ p.first_name }}")
    made = Planner(spark, b.build(), Resources(people={"en_US": people(spark, d)})).plan(20)
    return made.select(F.col(ROW).alias("r"), "greeting", F.col("p.age").alias("age"), F.col("p.state").alias("state"))


# ---- samplers in configs


@query(f"SELECT o_orderkey, strftime(date_trunc('month', TIMESTAMP '2021-05-01' + to_seconds(CAST(floor({u('v')} * 31536000.0) AS BIGINT))), '%Y %b %d') AS v FROM orders")
def sample_convert_datetime(spark, d):
    return drawn(orders(spark, d), "datetime", {"start": "2021-05-01", "end": "2022-05-01", "unit": "M"}, convert_to="%Y %b %d")


_K, _S = u("k", 0, "r"), u("s", 0, "r")


@query(f"""WITH a AS (SELECT r, o_orderkey, o_orderstatus, CASE WHEN {_K} < 0.5 THEN 'x' ELSE 'y' END AS k FROM {NUMBERED}), b AS (SELECT *, CASE WHEN k = 'x' THEN list_extract(['x1', 'x2'], CAST(floor({_S} * 2) AS INT) + 1) ELSE list_extract(['y1', 'y2', 'y3'], CAST(floor({_S} * 3) AS INT) + 1) END AS s FROM a)
 SELECT o_orderkey, k, s, CASE WHEN o_orderstatus = 'F' THEN 1000.0 + 1.0 * {u('n', 0, 'r')} WHEN s = 'x1' THEN 100.0 + 10.0 * {u('n', 0, 'r')} ELSE 0.0 + 1.0 * {u('n', 0, 'r')} END AS n FROM b""")
def sampler_dag(spark, d):
    """Columns declared against their order: each waits for its parent and for what its conditions name, seed columns too."""
    b, n = seeded(spark, d, "o_orderstatus")
    b.add_column(name="n", kind="sampler", sampler_type="uniform", params={"low": 0, "high": 1}, conditional_params={"s == 'x1'": {"low": 100, "high": 110}, "o_orderstatus == 'F'": {"low": 1000, "high": 1001}})
    b.add_column(name="s", kind="sampler", sampler_type="subcategory", params={"category": "k", "values": {"x": ["x1", "x2"], "y": ["y1", "y2", "y3"]}})
    b.add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["x", "y"], "weights": [1, 1]})
    return Planner(spark, b.build()).plan(n).select("o_orderkey", "k", "s", "n")


@query(f"SELECT o_orderkey, list_filter([{', '.join(f'-10.0 + 40.0 * {u("v", k, "r")}' for k in range(32))}], lambda x: x >= 10)[1] AS v, CAST({u('w', 0, 'r')} < 0.25 AS BIGINT) AS w FROM {NUMBERED}")
def constraint_in_config(spark, d):
    """A config's constraint. Half of the draws fit, so no row needs more than the 32 that the SQL makes."""
    b, n = seeded(spark, d)
    b.add_column(name="v", kind="sampler", sampler_type="uniform", params={"low": -10, "high": 30}).add_constraint("v", "ge", 10)
    b.add_column(name="w", kind="sampler", sampler_type="bernoulli", params={"p": 0.25})
    return Planner(spark, b.build()).plan(n).select("o_orderkey", "v", "w")


@query(f"SELECT o_orderkey, 0.2 + 0.6 * {u('m|temperature')} AS temperature, CASE WHEN {u('m|top_p')} < 0.75 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS top_p FROM orders")
def inference_parameters(spark, d):
    """Call parameters that are distributions, drawn for each row as samplers draw."""
    given = {"temperature": {"uniform": [0.2, 0.8]}, "top_p": {"values": [0.9, 1.0], "weights": [3, 1]}, "n": 1}
    drawn = drawn_parameters(given, SEED, "m", F.col("o_orderkey"))
    return orders(spark, d).select("o_orderkey", *(c.alias(name) for name, c in drawn.items()))


# ---- templates


@query("""SELECT c_custkey, CAST(CAST(c_custkey AS DOUBLE) AS VARCHAR) AS f, '1' AS mn, c_name || '!' AS st, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Of' AS ti, c_mktsegment AS tr,
 CASE WHEN length(c_name) <= 15 THEN c_name ELSE substr(c_name, 1, 7) || '...' END AS tu, CAST(ceil(c_acctbal) AS VARCHAR) AS ce, CAST(floor(c_acctbal) AS VARCHAR) AS fl, left(c_mktsegment, 1) || '-' || substr(c_mktsegment, 2, 1) AS li, '0.0' AS bad FROM customer""")
def filters_more(spark, d):
    t = {"f": "{{ c_custkey|float }}", "mn": "{{ [3, 1, 2]|min }}", "st": "{{ c_name|string ~ '!' }}", "ti": "{{ (c_mktsegment ~ ' of')|title }}", "tr": "{{ ('  ' ~ c_mktsegment ~ ' ')|trim }}", "tu": "{{ c_name|truncate(10) }}", "ce": "{{ c_acctbal|round(0, 'ceil') }}", "fl": "{{ c_acctbal|round(0, 'floor') }}", "li": "{{ (c_mktsegment|list)[0:2]|join('-') }}", "bad": "{{ c_mktsegment|float }}"}
    return templated(table(spark, d, "customer"), ["c_custkey"], t)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE WHEN o_custkey > 500 THEN 'True' ELSE 'False' END || '/None' AS v, o_orderstatus || CAST(o_custkey % 7 AS VARCHAR) AS j FROM orders")
def record_values(spark, d):
    """Timestamps and dates are ISO text, booleans and nulls as Python shows them, decimals numbers; text that holds JSON is looked into."""
    df = orders(spark, d).select("o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") > 500).alias("flag"), F.lit(None).cast("string").alias("nothing"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"), (F.col("o_custkey") % 7).alias("n"))).alias("js"))
    return templated(df, ["o_orderkey"], {"v": "{{ o_orderdate }}/{{ day }}/{{ flag }}/{{ nothing }}", "j": "{{ js.s }}{{ js.n }}"})


@query("SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority, o_totalprice FROM orders")
def template_references(spark, d):
    """A template's own columns are all that is read for it."""
    found = references("{{ o_orderkey|string }}{% if o_orderstatus == 'F' %}{{ o_custkey }}{% endif %}{% for x in o_orderpriority|list %}{{ x }}{{ loop.index }}{{ o_totalprice }}{% endfor %}")
    return table(spark, d, "orders").select(found)


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '+' || o_orderstatus AS label FROM orders")
def column_drop(spark, d):
    """A column that is marked as dropped is there for others and not in the result."""
    b = Builder(SEED).with_seed(orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus"), order_by=["o_orderkey"])
    b.add_column(name="half", kind="expression", expr="{{ o_custkey }}", drop=True).add_column(name="label", kind="expression", expr="{{ half }}+{{ o_orderstatus }}")
    made = Planner(spark, config := b.build()).plan(orders(spark, d).count())
    return Engine(spark).main(config, made).drop(ROW, GROUP, "o_custkey", "o_orderstatus")


# ---- profile


KINDS = {"a": ("category", {"values": ["x"]}), "b": ("subcategory", {"category": "a", "values": {"x": ["y"]}}), "c": ("uniform", {"low": 0, "high": 1}), "d": ("gaussian", {"mean": 0, "stddev": 1}), "e": ("bernoulli", {"p": 0.5}), "f": ("binomial", {"n": 3, "p": 0.5}), "g": ("poisson", {"mean": 2}), "h": ("scipy", {"dist_name": "expon", "dist_params": {}}), "i": ("uuid", {}), "j": ("datetime", {"start": "2020-01-01", "end": "2021-01-01"})}


@query("SELECT c.*, n AS num_records FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j']) AS column_name, unnest(['categorical', 'categorical', 'numerical', 'numerical', 'numerical', 'numerical', 'numerical', 'numerical', 'other', 'other']) AS kind) AS c, (SELECT count(*) AS n FROM orders)")
def distribution_kinds(spark, d):
    """The statistics of a dataset made over all orders, with the kind of distribution that each column's sampler has."""
    b, n = seeded(spark, d)
    for name, (kind, params) in KINDS.items():
        b.add_column(name=name, kind="sampler", sampler_type=kind, params=params)
    counted = pr.general(Planner(spark, b.build()).plan(n), list(KINDS), exact=False)
    kinds = F.create_map(*(F.lit(x) for name, (kind, _) in KINDS.items() for x in (name, pr.distribution_kind(kind))))
    return counted.select("column_name", F.get(F.array(kinds), 0)[F.col("column_name")].alias("kind"), "num_records")


@query("SELECT round(100.0 * count(*) FILTER (o_orderstatus <> 'P') / (count(*) + 1e-8), 2) AS percent_complete FROM orders")
def percent_complete(spark, d):
    o = orders(spark, d)
    return spark.createDataFrame([(pr.percent_complete(o.where("o_orderstatus <> 'P'").count(), o.count()),)], "percent_complete double")


ORACLE["token_counts"] = r"SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]'), lambda w: 1 + greatest(0, CAST(ceil((length(w) - 6) / 4.0) AS BIGINT)))), CASE WHEN text IS NOT NULL THEN 0 END) AS BIGINT) AS n_tokens FROM documents"


# ---- validation


@query("SELECT p_partkey, p_partkey % 2 = 0 AS a_valid, p_partkey % 3 <> 0 AS b_valid FROM part")
def validate_targets(spark, d):
    """Two targets: each is judged on its own rows."""
    k = F.col("p_partkey")
    df = table(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, "x = 1").otherwise("x = (").alias("a"), F.when(k % 3 == 0, "def f(:").otherwise("y = 2").alias("b"))
    return validate_code(df, "v", ["a", "b"], "python").select("p_partkey", F.col("v.a.is_valid").alias("a_valid"), F.col("v.b.is_valid").alias("b_valid"))


@query("SELECT p_partkey, p_partkey % 4 <> 0 AS is_valid, CASE p_partkey % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN 'none' WHEN 2 THEN 'warning' ELSE 'convention' END AS severity, CASE p_partkey % 4 WHEN 1 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def validate_python(spark, d):
    k = F.col("p_partkey") % 4
    code = F.when(k == 0, "x = = 1").when(k == 1, "x = 1").when(k == 2, "from os import *").otherwise("l = 1")
    return validate_code(table(spark, d, "part").select("p_partkey", code.alias("c")), "v", ["c"], "python").select("p_partkey", "v.is_valid", "v.severity", "v.score")


@query("SELECT p_partkey, p_size > 20 AS is_valid, p_size AS seen FROM part")
def validate_callable(spark, d):
    judge = lambda f: pd.DataFrame({"is_valid": f["p_size"] > 20, "seen": f["p_size"]})
    return validate_local(table(spark, d, "part").select("p_partkey", "p_size"), "v", ["p_size"], judge, "is_valid boolean, seen int").select("p_partkey", "v.is_valid", "v.seen")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size > 20 END AS is_valid FROM part")
def validate_service(spark, d):
    """Batches of one row; a batch that the service keeps refusing isn't judged."""

    def post(url: str, body: dict) -> list[dict]:
        if body["data"][0]["p_partkey"] % 5 == 0:
            raise ConnectionError("refused")
        return [{"is_valid": bool(r["p_size"] > 20)} for r in body["data"]]

    return validate_remote(table(spark, d, "part").select("p_partkey", "p_size"), "v", ["p_partkey", "p_size"], "http://service", post, 1, sleep=lambda s: None).select("p_partkey", "v.is_valid")


SCHEMA = {"$defs": {"size": {"type": "integer", "minimum": 10, "maximum": 40}}, "type": "object", "properties": {"size": {"$ref": "#/$defs/size"}, "brand": {"type": "string", "pattern": "^Brand#[1-3]"}}, "required": ["size"]}


@query("SELECT p_partkey, p_size BETWEEN 10 AND 40 AND regexp_matches(p_brand, '^Brand#[1-3]') AS fits, CAST(p_size AS BIGINT) AS size, CAST(2 AS BIGINT) AS n_fields FROM part")
def json_schema(spark, d):
    """References, bounds and patterns; properties that the schema doesn't name are pruned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = [{"size": int(s), "brand": b, "more": 1} for s, b in zip(f["p_size"], f["p_brand"], strict=True)]
            kept = [pruned(v, SCHEMA) for v in values]
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "fits": [conforms(v, SCHEMA) for v in values], "size": [k["size"] for k in kept], "n_fields": [len(k) for k in kept]})

    return table(spark, d, "part").select("p_partkey", "p_size", "p_brand").mapInPandas(run, "p_partkey long, fits boolean, size long, n_fields long")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE '1' END AS score FROM part")
def judge_score(spark, d):
    """4.0 is 4, case doesn't count, and true is no number."""

    def one(k: int) -> str | None:
        try:
            return str(fitted_score([1.0, "1", 1, True][k % 4], [0, 1]))
        except ValueError:
            return None

    return table(spark, d, "part").select("p_partkey").mapInPandas(lambda fs: (f.assign(score=[one(k) for k in f["p_partkey"]]) for f in fs), "p_partkey long, score string")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'k' || p_partkey ELSE 'a;k' || p_partkey END AS v FROM part")
def list_strings(spark, d):
    """JSON, JSON with a trailing comma, one bare value, and a Python list."""
    k = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    m = F.col("p_partkey") % 4
    text = F.when(m == 0, F.concat(F.lit('["a", "'), k, F.lit('"]'))).when(m == 1, F.concat(F.lit('["a", "'), k, F.lit('",]'))).when(m == 2, k).otherwise(F.concat(F.lit("['a', '"), k, F.lit("']")))
    return table(spark, d, "part").select("p_partkey", F.array_join(list_of_text(text), ";").alias("v"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'wav' END AS v FROM part")
def media_formats(spark, d):
    heads = ["89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "524946460000000057454250", "524946460000000057415645", "000000000000000000000000"]
    data = F.element_at(F.array(*(F.base64(F.unhex(F.lit(h))) for h in heads)), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", media_format(data).alias("v"))


LINT = [("ERROR", "expression_reference_missing", "a"), ("ERROR", "skip_reference_missing", "b"), ("ERROR", "skip_on_sampler_seed", "c"), ("ERROR", "invalid_model_config", "e"), ("WARNING", "prompt_without_references", "e"), ("WARNING", "f_string_syntax", "e"), ("ERROR", "code_column_missing", "f"), ("WARNING", "code_column_not_code", "g"), ("ERROR", "invalid_column", "h")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS level, '{b}' AS kind, '{c}' AS column_name, (SELECT count(*) FROM orders) AS made" for a, b, c in LINT))
def config_lint(spark, d):
    """What lint finds in a config seeded by orders, and how many rows are made without the columns at fault."""
    b, n = seeded(spark, d, "o_custkey")
    b.add_column(name="fine", kind="expression", expr="{{ o_custkey }}")
    b.add_column(name="a", kind="expression", expr="{{ nothing }}").add_column(name="b", kind="expression", expr="x", skip=Skip("nothing"))
    b.add_column(name="c", kind="sampler", sampler_type="uuid", skip=Skip("true")).add_column(name="e", kind="llm-text", prompt="say {x}", model_alias="m")
    b.add_column(name="f", kind="validation", target_columns=["gone"], validator="code:python").add_column(name="g", kind="validation", target_columns=["c"], validator="code:python")
    b.add_column(name="h", kind="sampler", sampler_type="none of them")
    faults = [(f.level, f.kind, f.column) for f in lint(b.build(), ["o_orderkey", "o_custkey"]) if (f.kind, f.column) not in (("invalid_reference", "f"),)]
    b.config.columns = [c for c in b.config.columns if c.name not in {column for *_, column in faults}]
    made = Planner(spark, b.build()).plan(n).agg(F.count("fine").alias("made")).first()["made"]
    return spark.createDataFrame([(*f, made) for f in faults], "level string, kind string, column_name string, made long")


# ---- models, by a client whose answers follow from the prompt


class CountedEcho(EchoClient):
    """Tells as usage the lengths of the prompt and of the answer."""

    def __call__(self, kind: str, messages: list[dict], parameters: dict) -> dict:
        out = super().__call__(kind, messages, parameters)
        return out | {"usage": {"input_tokens": len(messages[-1]["content"]), "output_tokens": len(out.get("content") or "")}}


def modelled(spark: SparkSession, sf_dir: str, *columns: dict[str, Any], client: Any = None, tools: dict | None = None) -> DataFrame:
    b = Builder(SEED).add_model("m", "any")
    for c in columns:
        b.add_column(model_alias="m", **c)
    rows = table(spark, sf_dir, "nation").withColumns({ROW: F.col("n_nationkey").cast("long"), GROUP: F.lit(0).cast("long")})
    return Planner(spark, b.build(), Resources(models={"m": client or EchoClient()}, tools=tools or {})).marked(rows)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'none' ELSE 'echo: say ' || n_name END AS t, CASE WHEN n_regionkey <> 2 THEN 'echo: more of echo: say ' || n_name END AS more, CASE WHEN n_regionkey = 2 THEN NULL ELSE 'say ' || n_name END AS asked FROM nation")
def model_text(spark, d):
    """Skipped rows aren't asked for, and skips pass on to what needs the column; the trace tells what was asked."""
    df = modelled(spark, d, {"name": "t", "kind": "llm-text", "prompt": "say {{ n_name }}", "skip": Skip("n_regionkey == 2", "none"), "side_effects": ["t__trace"]}, {"name": "more", "kind": "llm-text", "prompt": "more of {{ t }}"})
    return df.select("n_nationkey", "t", "more", F.get_json_object("t__trace", "$[0].content").alias("asked"))


def first_byte(prompt: str) -> str:
    return f"CAST('0x' || substr(sha256({prompt}), 1, 2) AS BIGINT)"


@query(f"SELECT n_nationkey, 'x = ' || {first_byte("'code ' || n_name")} AS code, {first_byte("'make ' || n_name")} AS size, substr(sha256('make ' || n_name), 3, 8) AS tag, CAST({first_byte("'judge ' || n_name")} % 3 AS VARCHAR) AS score FROM nation")
def model_structured(spark, d):
    """Code blocks, JSON to a schema, and judge scores."""
    schema = {"type": "object", "properties": {"size": {"type": "integer"}, "tag": {"type": "string"}}, "required": ["size", "tag"]}
    df = modelled(spark, d, {"name": "code", "kind": "llm-code", "prompt": "code {{ n_name }}", "code_lang": "python"}, {"name": "s", "kind": "llm-structured", "prompt": "make {{ n_name }}", "output_format": schema}, {"name": "j", "kind": "llm-judge", "prompt": "judge {{ n_name }}", "scores": [{"name": "q", "options": [0, 1, 2]}]})
    return df.select("n_nationkey", "code", "s.size", "s.tag", F.col("j.q.score").alias("score"))


@query("SELECT n_nationkey, CAST(1 AS BIGINT) AS num_embeddings, CAST(4 AS BIGINT) AS dimension, round(CAST('0x' || substr(sha256('[\"' || n_name || '\"]'), 3, 2) AS BIGINT) / 255.0, 9) AS second, sha256('draw ' || n_name) AS image FROM nation")
def model_vectors(spark, d):
    df = modelled(spark, d, {"name": "e", "kind": "embedding", "target_columns": ["n_name"]}, {"name": "i", "kind": "image", "prompt": "draw {{ n_name }}"})
    return df.select("n_nationkey", "e.num_embeddings", "e.dimension", F.round(F.col("e.embeddings")[0][1], 9).alias("second"), F.col("i")[0].alias("image"))


@query("SELECT 't' AS \"column\", count(*) AS calls, CAST(sum(length('say ' || n_name)) AS BIGINT) AS input_tokens, CAST(sum(length('echo: say ' || n_name)) AS BIGINT) AS output_tokens FROM nation")
def model_usage(spark, d):
    df = modelled(spark, d, {"name": "t", "kind": "llm-text", "prompt": "say {{ n_name }}", "side_effects": ["t__usage"]}, client=CountedEcho())
    return usage_totals(df, ["t"])


def asking(kind: str, messages: list[dict], parameters: dict) -> dict:
    """Asks for a tool once, and answers with what it said."""
    if messages[-1]["role"] == "tool":
        return {"content": f"it says {messages[-1]['content']}"}
    return {"content": "", "tool_calls": [{"id": "1", "name": "length", "arguments": {"text": messages[-1]["content"]}}]}


def faulty(kind: str, messages: list[dict], parameters: dict) -> dict:
    """An answer that can't be used, then one that can, once the fault was told."""
    return {"content": '```json\n{"k": 5}\n```' if len(messages) > 1 else "no"}


@query("SELECT n_nationkey, 'it says ' || length(n_name) AS t FROM nation")
def model_tools(spark, d):
    return modelled(spark, d, {"name": "t", "kind": "llm-text", "prompt": "{{ n_name }}", "params": {"tools": ["length"]}}, client=asking, tools={"length": lambda text: len(text)}).select("n_nationkey", "t")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'it says ' || length(s_name) ELSE 'it says the tool ''length'' isn''t allowed' END AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'it says ' || length(s_name) END AS again FROM supplier")
def model_tool_config(spark, d):
    """Columns that name configs of tools: one allows the tool that the model asks for, the other doesn't."""
    rows = table(spark, d, "supplier").withColumns({ROW: F.col("s_suppkey").cast("long"), GROUP: F.lit(0).cast("long")})
    b = Builder(SEED).add_model("m", "any").add_tool("all", timeout_sec=60).add_tool("other", ["upper"])
    b.add_column(name="a", kind="llm-text", model_alias="m", prompt="{{ s_name }}", params={"tool_alias": "all"}, skip=Skip("s_suppkey % 2 == 1"))
    b.add_column(name="b", kind="llm-text", model_alias="m", prompt="{{ s_name }}", params={"tool_alias": "other"}, skip=Skip("s_suppkey % 2 == 0"))
    made = Planner(spark, b.build(), Resources(models={"m": asking}, tools={"length": lambda text: len(text), "upper": lambda text: text.upper()})).marked(rows)
    return made.select("s_suppkey", F.coalesce("a", "b").alias("t"), F.col("a").alias("again"))


# The stand-in answers a judge's n-th score by the n-th byte of the prompt's digest.
_JUDGED = " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(CAST('0x' || substr(sha256('judge ' || s_name), {2 * k + 1}, 2) AS BIGINT) % 3 AS VARCHAR) AS score FROM supplier" for k, name in enumerate(("clear", "short")))


@query(f"SELECT name, score, count(*) AS n, true AS is_numerical, 'Sum up what these scores of ' || name || ' have in common.' AS asked FROM ({_JUDGED}) GROUP BY name, score")
def judge_profile(spark, d):
    """A dataset with a judge column, analyzed by the config's profiler: scores by name, and what the summaries' model was asked."""
    b = Builder(SEED).add_model("m", "any").add_model("sum", "any").with_seed(table(spark, d, "supplier").select("s_name"))
    b.add_column(name="j", kind="llm-judge", model_alias="m", prompt="judge {{ s_name }}", scores=[{"name": n, "options": {0: "no", 1: "some", 2: "yes"}} for n in ("clear", "short")])
    b.add_profiler("judge_scores", model_alias="sum")
    first_line = lambda kind, messages, parameters: {"content": messages[-1]["content"].split("\n")[0]}
    engine = Engine(spark, Resources(models={"m": EchoClient(), "sum": first_line}))
    told = engine.analyze(engine.create(b, table(spark, d, "supplier").count(), folder(spark, "judged")))
    return told["judge_scores:j"].join(told["judge_summaries:j"].withColumnRenamed("summary", "asked"), "name").select("name", "score", "n", "is_numerical", "asked")


@query("SELECT n_nationkey, CAST(5 AS BIGINT) AS k FROM nation")
def model_corrections(spark, d):
    df = modelled(spark, d, {"name": "s", "kind": "llm-structured", "prompt": "{{ n_name }}", "output_format": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}, "params": {"max_correction_steps": 1}}, client=faulty)
    return df.select("n_nationkey", "s.k")


@query("SELECT n_nationkey, 'echo: see ' || n_name || '<image>' AS t FROM nation")
def model_context(spark, d):
    """An attachment beside the prompt."""
    return modelled(spark, d, {"name": "t", "kind": "llm-text", "prompt": "see {{ n_name }}", "params": {"context": {"image": ["n_name"]}}}).select("n_nationkey", "t")


# ---- functions and plugins


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN -1 ELSE length(n_name) END AS cell, CASE WHEN n_regionkey = 2 THEN NULL ELSE lower(n_name) END AS side, n_nationkey - (SELECT avg(n_nationkey) FROM nation) AS whole, n_regionkey * 10 AS plug FROM nation")
def custom_columns(spark, d):
    """A function of cells with a side effect, one of a whole row group, and a column kind of a plugin; skipped rows aren't seen."""
    if "tenfold" not in COLUMN_KINDS:
        register_column_kind("tenfold", lambda df, c, resources, off: df.withColumn(c.name, F.when(~F.col(off), F.col(c.target_columns[0]) * 10)))
    b = Builder(SEED).add_column(name="cell", kind="custom", target_columns=["n_name"], side_effects=["side"], params={"types": {"cell": "long"}}, skip=Skip("n_regionkey == 2", -1))
    b.add_column(name="whole", kind="custom", target_columns=["n_nationkey"], params={"mode": "full", "types": {"whole": "double"}}).add_column(name="plug", kind="tenfold", target_columns=["n_regionkey"])
    rows = table(spark, d, "nation").withColumns({ROW: F.col("n_nationkey").cast("long"), GROUP: F.lit(0).cast("long")})
    functions = {"cell": lambda r: {"cell": len(r["n_name"]), "side": r["n_name"].lower()}, "whole": lambda f: f.assign(whole=f["n_nationkey"] - f["n_nationkey"].mean())}
    return Planner(spark, b.build(), Resources(functions=functions)).marked(rows).select("n_nationkey", "cell", "side", "whole", "plug")


class Marking(Processor):
    """Adds a column before, shouts after, and keeps every second row at the end."""

    def before(self, df: DataFrame) -> DataFrame:
        return df.withColumn("mark", F.lit(self.params["mark"]))

    def after_batch(self, df: DataFrame) -> DataFrame:
        return df.withColumn("v", F.upper("v"))

    def after_generation(self, df: DataFrame) -> DataFrame:
        return df.where("n_nationkey % 2 = 0")


def nations(spark: SparkSession, sf_dir: str) -> Builder:
    return Builder(SEED).with_seed(table(spark, sf_dir, "nation"), order_by=["n_nationkey"])


@query("SELECT n_nationkey, n_name, n_regionkey, 'M' AS mark, upper('m' || n_name) AS v FROM nation WHERE n_nationkey % 2 = 0")
def processor_hooks(spark, d):
    if "marking" not in PROCESSORS:
        register_processor("marking", Marking)
    b = nations(spark, d).add_column(name="v", kind="expression", expr="m{{ n_name }}").add_processor(ProcessorConfig("mark", "marking", params={"mark": "M"}))
    return Engine(spark).create(b, 25, folder(spark, "run")).load_dataset()


# ---- runs


def shaped(spark: SparkSession, sf_dir: str) -> Builder:
    """Forty rows of 25 seeds, of which those of one region are dropped; a column that is dropped at the end, and a second dataset."""
    b = nations(spark, sf_dir).add_column(name="code", kind="expression", expr="{% if n_regionkey == 1 %} {% else %}{{ n_nationkey * 2 }}{% endif %}", dtype="int")
    b.add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b", "c"]})
    b.add_processor(ProcessorConfig("drop", "drop_columns", ["n_regionkey", "code"]))
    return b.add_processor(ProcessorConfig("doc", "schema_transform", template={"doc": {"id": "{{ n_nationkey }}", "k": "{{ k }}"}}))


_R40 = f"SELECT r, n_nationkey, n_name, n_regionkey, list_extract(['a','b','c'], CAST(floor({u('k', 0, 'r')} * 3) AS INT) + 1) AS k FROM (SELECT unnest(range(40)) AS r) JOIN nation ON n_nationkey = r % 25 WHERE n_regionkey <> 1"


@query(f"SELECT n_nationkey, n_name, k FROM ({_R40})")
def run_dataset(spark, d):
    return Engine(spark, run_config=RunConfig(buffer_size=10)).create(shaped(spark, d), 40, folder(spark, "run")).load_dataset()


@query(f"SELECT r AS _row_id, n_regionkey, CAST(n_nationkey * 2 AS BIGINT) AS code FROM ({_R40})")
def run_dropped_columns(spark, d):
    return Engine(spark, run_config=RunConfig(buffer_size=10)).create(shaped(spark, d), 40, folder(spark, "run")).load_dropped().select("_row_id", "n_regionkey", "code")


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS id, k FROM ({_R40})")
def run_processor_output(spark, d):
    return Engine(spark, run_config=RunConfig(buffer_size=10)).create(shaped(spark, d), 40, folder(spark, "run")).load_processor_dataset("doc").select("doc.id", "doc.k")


@query(f"SELECT CAST(40 AS BIGINT) AS target, count(*) AS actual, 40 - count(*) AS dropped, 'code:empty' AS reason FROM ({_R40})")
def run_metadata(spark, d):
    path = folder(spark, "run")
    made = Engine(spark, run_config=RunConfig(buffer_size=10)).create(shaped(spark, d), 40, path)
    meta = json.loads(Folder(spark, path).read("metadata.json"))
    (reason, dropped), = meta["dropped"].items()
    return spark.createDataFrame([(meta["target"], made.count_records(), dropped, reason)], "target long, actual long, dropped long, reason string")


@query(f"SELECT n_nationkey, n_name, k FROM ({_R40})")
def run_resume(spark, d):
    """A group is lost and the run is resumed; all is as if it had been made at once."""
    path, rc = folder(spark, "run"), RunConfig(buffer_size=10, resume="always")
    Engine(spark, run_config=rc).create(shaped(spark, d), 30, path)
    Folder(spark, path).delete(f"parquet-files/{GROUP}=10")
    return Engine(spark, run_config=rc).create(shaped(spark, d), 40, path).load_dataset()


def drawing(kind: str, messages: list[dict], parameters: dict) -> dict:
    """A stand-in whose images are a PNG's head and each line of the prompt; text answers tell the attachments' digests."""
    said = messages[-1]["content"]
    if kind == "image":
        return {"data": [base64.b64encode(b"\x89PNG\r\n\x1a\n" + line.encode()).decode() for line in said.split("\n")]}
    return {"content": ",".join(f"{b['format']}:{hashlib.sha256(base64.b64decode(b['value'])).hexdigest()}" for b in said if b["type"] == "image")}


def png_sha(line: str) -> str:
    return f"sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode({line}))"


@query(f"WITH seen AS (SELECT s_suppkey, {png_sha('s_name')} AS own, {png_sha('CAST(s_nationkey AS VARCHAR)')} AS shared FROM supplier), files AS (SELECT shared AS sha, count(*) AS named FROM seen GROUP BY ALL UNION ALL SELECT own, 1 FROM seen) SELECT s_suppkey, 'images/pic/' || left(own, 3) || '/' || own || '.png' AS own, 'images/pic/' || left(shared, 3) || '/' || shared || '.png' AS shared, own AS own_sha, shared AS shared_sha, named, 'png:' || own || ',png:' || shared AS told FROM seen JOIN files ON sha = shared")
def run_images(spark, d):
    """Two images a row as files beside the dataset, of which the second is one file for each nation; a model gets them as attachments."""
    b = Builder(SEED).add_model("m", "any").with_seed(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    b.add_column(name="pic", kind="image", model_alias="m", prompt="{{ s_name }}\n{{ s_nationkey }}")
    b.add_column(name="told", kind="llm-text", model_alias="m", prompt="{{ s_name }}", params={"context": {"image": ["pic"]}})
    rows = table(spark, d, "supplier").count()
    made = Engine(spark, Resources(models={"m": drawing})).create(b, rows, folder(spark, "images"))
    files = made.load_images().select("path", F.sha2("content", 256).alias("sha"))
    named = spark.read.parquet(f"{made.path}/{IMAGE_MANIFEST}").groupBy("path").agg(F.sum("rows").alias("named"))
    data = made.load_dataset().select("s_suppkey", F.col("pic")[0].alias("own"), F.col("pic")[1].alias("shared"), "told")
    both = data.join(files.select(F.col("path").alias("own"), F.col("sha").alias("own_sha")), "own").join(files.select(F.col("path").alias("shared"), F.col("sha").alias("shared_sha")), "shared")
    return both.join(named.withColumnRenamed("path", "shared"), "shared").select("s_suppkey", "own", "shared", "own_sha", "shared_sha", "named", "told")


@query(f"SELECT n_nationkey, n_name, k FROM ({_R40})")
def run_export(spark, d):
    """One file of JSON lines, read back."""
    path = folder(spark, "run")
    Engine(spark, run_config=RunConfig(buffer_size=10)).create(shaped(spark, d), 40, f"{path}/set").export(f"{path}/out.jsonl")
    return LocalFileSource(f"{path}/out.jsonl").read(spark).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "k")


@query("SELECT n_nationkey, n_name, upper(n_name) || '!' AS loud, lower(n_name) AS quiet FROM nation WHERE n_regionkey <> 0")
def workflow_stages(spark, d):
    """A second stage that is seeded by what the first wrote, less what its hook leaves out."""
    w = Workflow(Engine(spark), folder(spark, "flow"))
    w.add_stage("first", nations(spark, d).add_column(name="loud", kind="expression", expr="{{ n_name|upper }}!"), count=25, on_success=lambda df: df.where("n_regionkey <> 0"))
    w.add_stage("second", Builder(SEED).add_column(name="quiet", kind="expression", expr="{{ n_name|lower }}"))
    return w.run()["second"].load_dataset().select("n_nationkey", "n_name", "loud", "quiet")


@query(f"SELECT o_orderkey, 'k' || CAST(o_custkey % 7 AS VARCHAR) || '/' || list_extract(['a','b'], CAST(floor({u('k', 0, 'r')} * 2) AS INT) + 1) AS v, true AS same FROM {NUMBERED}")
def config_round_trip(spark, d):
    """A config written, read and fingerprinted again; the one read makes what was written down."""
    b, n = seeded(spark, d, "o_custkey")
    b.add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b"]}).add_column(name="v", kind="expression", expr="k{{ o_custkey % 7 }}/{{ k }}")
    seed, b.config.seed_config = b.config.seed_config, None
    again = Builder.from_config(b.build().to_json())
    same = again.build().fingerprint() == b.build().fingerprint()
    again.with_seed(seed.source, seed.strategy, seed.selection, seed.order_by)
    return Planner(spark, again.build()).plan(n).select("o_orderkey", "v", F.lit(same).alias("same"))

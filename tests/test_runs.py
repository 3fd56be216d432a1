"""Seeds at size, calls of models, runs and their datasets, people, schemas and validation."""

import collections
import datetime as dt
import json
import shutil
import threading
import time
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.template import TemplateError, parse
from weftline.operators.generate import Admission, CallRules, ModelError, at_once, drawn_parameters, tool_turns
from weftline.operators.profile import general, numerical
from weftline.operators.rollouts import read_rollouts
from weftline.operators.sketches import merged, sketched
from weftline.operators.validate import RemoteRules, conforms, pruned, struct_of, validate_remote
from weftline.plans.config import Builder, ConfigError, ProcessorConfig, Skip
from weftline.plans.engine import PROCESSORS, Engine, Processor, RunConfig, RunError
from weftline.plans.planner import Planner, Resources
from weftline.sources.seeds import INDEX, attach, indexed, scanned


def make():
    b = Builder(3).add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b"]})
    return b.add_column(name="v", kind="expression", expr="{{ k|upper }}")


# ---- seeds at size


@pytest.mark.parametrize("partitions", [8, 32, 211])
def test_seed_numbers_are_right_at_size(spark, partitions):
    """Each number from 0 occurs once, in the order asked for, however rows are dealt and whatever adaptive execution joins."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.lit("x" * 50).alias("pad"))
        for order in (["k"], None):
            got = indexed(df, order)
            r = got.agg(F.count_distinct(INDEX).alias("n"), F.min(INDEX).alias("a"), F.max(INDEX).alias("b")).first()
            assert (r.n, r.a, r.b) == (200_000, 0, 199_999)
            joined = got.join(spark.range(200_000).withColumnRenamed("id", INDEX), INDEX)
            assert joined.select(INDEX).distinct().count() == 200_000
            if order:
                assert got.withColumn("up", F.lead("k").over(Window.orderBy(INDEX)) > F.col("k")).where("up = false").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_seed_numbers_of_a_parquet_scan(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert scanned(df) is not None and scanned(df.where("id > 5")) is None and scanned(spark.range(5)) is None
    for x in (df, df.where("id >= 100"), df.select("id")):
        n = x.count()
        assert sorted(r[INDEX] for r in indexed(x).collect()) == list(range(n))
    assert indexed(df.limit(0)).count() == 0


def test_shuffled_seeds_are_a_permutation_in_each_cycle(spark, monkeypatch):
    from weftline.sources import seeds as sd

    monkeypatch.setattr(sd, "RANKED_AT_ONCE", 10)  # so that several digits of the hash are used
    rows = attach(spark.range(3000).withColumnRenamed("id", "_row_id"), indexed(spark.range(1000).withColumnRenamed("id", "v"), ["v"]), 1000, "shuffle", 5)
    got = [r.v for r in rows.orderBy("_row_id").collect()]
    cycles = [got[i : i + 1000] for i in (0, 1000, 2000)]
    assert all(sorted(c) == list(range(1000)) for c in cycles) and cycles[0] != cycles[1] and cycles[0] != sorted(cycles[0])
    monkeypatch.setattr(sd, "RANKED_AT_ONCE", 100_000)
    again = attach(spark.range(3000).withColumnRenamed("id", "_row_id"), indexed(spark.range(1000).withColumnRenamed("id", "v"), ["v"]), 1000, "shuffle", 5)
    assert [r.v for r in again.orderBy("_row_id").collect()] == got


# ---- one call for each row


def counting(path):
    """A client that notes each call in a file and answers at random."""

    def client(kind, messages, parameters):
        import os
        import random

        handle = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(handle, (messages[-1]["content"].split()[0] + "\n").encode())
        os.close(handle)
        return {"content": f"{messages[-1]['content']} {random.random()}"}

    return client


def test_models_are_called_once_and_all_datasets_agree(spark, tmp_path):
    log = f"{tmp_path}/calls"
    b = Builder(4).add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b"]}).add_model("m", "any")
    b.add_column(name="gone", kind="expression", expr="{% if k == 'a' %}x{% else %}{{ k }}{% endif %}")
    b.add_column(name="one", kind="llm-text", prompt="one {{ k }}", model_alias="m")
    b.add_column(name="two", kind="llm-text", prompt="two {{ one }}", model_alias="m", skip=Skip("k == 'b'"), drop=True)
    b.add_column(name="three", kind="llm-text", prompt="three {{ one }}", model_alias="m", skip=Skip("k == 'a'", "none"))
    b.add_processor(ProcessorConfig("doc", "schema_transform", template={"doc": "{{ one }}"}))
    out = Engine(spark, Resources(models={"m": counting(log)})).create(b, 100, f"{tmp_path}/set")
    rows = out.load_dataset().collect()
    calls = collections.Counter(open(log).read().split())
    n = sum(r.k == "a" for r in rows)
    assert calls == {"one": 100, "two": n, "three": 100 - n} and 0 < n < 100
    assert sorted(r.doc for r in out.load_processor_dataset("doc").collect()) == sorted(r.one for r in rows)
    dropped = [r.two for r in out.load_dropped().collect() if r.two is not None]
    assert len(dropped) == n and {x[4:].rsplit(" ", 1)[0] for x in dropped} == {r.one for r in rows if r.k == "a"}
    assert all((r.three == "none") == (r.k == "a") for r in rows)


def test_dropped_rows_are_not_sent_and_reasons_are_counted(spark, tmp_path):
    log = f"{tmp_path}/calls"
    b = Builder(4).add_column(name="k", kind="sampler", sampler_type="category", params={"values": ["a", "b"]}).add_model("m", "any")
    b.add_column(name="x", kind="expression", expr="{% if k == 'a' %} {% else %}{{ k }}{% endif %}")
    b.add_column(name="one", kind="llm-text", prompt="one {{ x }}", model_alias="m")
    b.add_column(name="cell", kind="custom", target_columns=["x"], params={"types": {"cell": "long"}})
    seen = lambda r: 1 if r["x"] == "b" else 1 / 0
    out = Engine(spark, Resources(models={"m": counting(log)}, functions={"cell": seen})).create(b, 60, f"{tmp_path}/set")
    n = out.count_records()
    assert collections.Counter(open(log).read().split()) == {"one": n} and 0 < n < 60
    assert out.metadata["dropped"] == {"x:empty": 60 - n} and out.metadata["actual"] == n


def test_calls_run_at_once_and_stop_early(spark):
    """As many calls in flight as the admission allows; after too many failures rows are no longer asked for."""
    flying, most, lock = 0, 0, threading.Lock()

    def work():
        nonlocal flying, most
        with lock:
            flying += 1
            most = max(most, flying)
        time.sleep(0.02)
        with lock:
            flying -= 1
        return 1

    from concurrent.futures import ThreadPoolExecutor

    got = {}
    a = Admission(most=8)
    with ThreadPoolExecutor(8) as pool:
        at_once([work] * 40, a, pool, lambda i, r: got.setdefault(i, r))
    assert most == 8 and len(got) == 40
    most, a = 0, Admission(most=8)
    for _ in range(5):
        a.refused(0.0)
    with ThreadPoolExecutor(8) as pool:
        at_once([work] * 10, a, pool, lambda i, r: None)
    assert most == a.limit == 1

    def failing(kind, messages, parameters):
        raise ModelError("no", status=400)

    b = Builder(1).add_column(name="k", kind="sampler", sampler_type="uuid").add_model("m", "any").add_column(name="t", kind="llm-text", prompt="{{ k }}", model_alias="m")
    rows = Planner(spark, b.build(), Resources(models={"m": failing}), rules=CallRules(most_calls=1)).marked(spark.range(0, 200, 1, 1).withColumnRenamed("id", "_row_id").withColumn("_row_group", F.lit(0)))
    assert {r["_drop_reason"]: r["n"] for r in rows.groupBy("_drop_reason").agg(F.count("*").alias("n")).collect()} == {"t:model": 10, "t:stopped": 190}


def test_call_parameters_are_drawn(spark):
    given = {"temperature": {"uniform": [0, 1]}, "top_p": {"values": [1, 2], "weights": [1, 3]}, "n": 4}
    rows = lambda n: spark.range(2000).repartition(n).select("id", *(c.alias(k) for k, c in drawn_parameters(given, 1, "m", F.col("id")).items())).orderBy("id").collect()
    got = rows(1)
    assert got == rows(3) and got[0].__fields__ == ["id", "temperature", "top_p"]
    assert abs(sum(g["temperature"] for g in got) / 2000 - 0.5) < 0.03 and abs(sum(g["top_p"] == 2 for g in got) / 2000 - 0.75) < 0.04
    with pytest.raises(ValueError, match="weights"):
        drawn_parameters({"top_p": {"values": [1, 2], "weights": [1]}}, 1, "m", F.col("id"))
    b = Builder(1).add_column(name="k", kind="sampler", sampler_type="uuid").add_model("m", "any", **given).add_column(name="t", kind="llm-text", prompt="{{ k }}", model_alias="m")
    told = Planner(spark, b.build(), Resources(models={"m": lambda kind, messages, parameters: {"content": json.dumps(parameters)}})).plan(50).collect()
    assert {frozenset(json.loads(r.t)) for r in told} == {frozenset(given)} and len({json.loads(r.t)["temperature"] for r in told}) > 40


def test_tools_and_corrections_keep_their_budget():
    asks = lambda *_: {"content": "", "tool_calls": [{"id": "1", "name": "t", "arguments": {}}]}
    talk = tool_turns(asks, [], {"t": lambda: 1}, {}, budget=2)
    assert [m["content"] for m in talk if m["role"] == "tool"] == ["1", "1", "no more tool calls are allowed"]


# ---- runs


def test_blocks_of_groups_bound_the_folders(spark, tmp_path, monkeypatch):
    from weftline.plans import engine as en

    monkeypatch.setattr(en, "MOST_BLOCKS", 4)
    b = make()
    out = Engine(spark, run_config=RunConfig(buffer_size=10)).create(b, 300, f"{tmp_path}/set")
    folders = sorted(p.name for p in (tmp_path / "set" / "parquet-files").iterdir() if p.name.startswith("_row"))
    assert folders == ["_row_group=0", "_row_group=16", "_row_group=24", "_row_group=8"] and out.count_records() == 300
    whole = sorted(map(str, out.load_dataset().collect()))
    shutil.rmtree(f"{tmp_path}/set/parquet-files/_row_group=8")
    rc = RunConfig(buffer_size=10, resume="always")
    assert sorted(map(str, Engine(spark, run_config=rc).create(b, 300, f"{tmp_path}/set").load_dataset().collect())) == whole
    more = Engine(spark, run_config=rc).create(b, 350, f"{tmp_path}/set")
    assert more.count_records() == 350 and set(whole) <= set(map(str, more.load_dataset().collect()))


def test_groups_without_rows_are_not_made_again(spark, tmp_path):
    """Groups whose rows were all dropped are known to be empty."""
    b = Builder(1).with_seed(spark.range(40).withColumnRenamed("id", "n"), order_by=["n"]).add_column(name="v", kind="expression", expr="{% if n >= 10 and n < 20 %} {% else %}{{ n }}{% endif %}", dtype="int")
    rc = RunConfig(buffer_size=10, resume="always")
    Engine(spark, run_config=rc).create(b, 40, f"{tmp_path}/set")
    meta = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert meta["empty"] == [1] and meta["dropped"] == {"v:empty": 10} and meta["actual"] == 30
    before = sorted(p.name for p in (tmp_path / "set" / "parquet-files" / "_row_group=0").iterdir())
    again = Engine(spark, run_config=rc).create(b, 40, f"{tmp_path}/set")
    assert again.count_records() == 30 and sorted(p.name for p in (tmp_path / "set" / "parquet-files" / "_row_group=0").iterdir()) == before
    assert json.loads((tmp_path / "set" / "metadata.json").read_text())["dropped"] == {"v:empty": 10}


def test_processors_may_not_change_batches(spark, tmp_path):
    class Halving(Processor):
        def after_batch(self, df):
            return df.limit(5)

    PROCESSORS.setdefault("halving", Halving)
    b = make().add_processor(ProcessorConfig("h", "halving"))
    with pytest.raises(RunError, match="number of rows"):
        Engine(spark).create(b, 20, f"{tmp_path}/set")
    with pytest.raises(ConfigError, match="of kind"):
        Engine(spark).create(make().add_processor(ProcessorConfig("h", "unheard")), 20, f"{tmp_path}/other")


def test_expressions_see_finished_samplers(spark):
    """Rounding and dates as text come before other columns, and after constraints."""
    b = Builder(3).add_column(name="x", kind="sampler", sampler_type="uniform", params={"low": 0, "high": 10, "decimal_places": 1}).add_constraint("x", "lt", 5)
    b.add_column(name="at", kind="sampler", sampler_type="datetime", params={"start": "2020-01-01", "end": "2021-01-01"}, convert_to="%d/%m/%Y")
    b.add_column(name="later", kind="sampler", sampler_type="timedelta", params={"dt_min": 1, "dt_max": 2, "reference_column_name": "at"})
    b.add_column(name="text", kind="expression", expr="{{ x }} {{ at }}")
    for r in Planner(spark, b.build()).plan(300).collect():
        assert r.text == f"{r.x} {r.at}" and r.x == round(r.x, 1) and r.x <= 5
        d, m, y = r.at.split("/")
        assert dt.date.fromisoformat(r.later[:10]) - dt.date(int(y), int(m), int(d)) == dt.timedelta(1)


# ---- people, templates, schemas, validation


def test_people_of_a_managed_dataset(spark, tmp_path):
    people = spark.range(500).select(F.concat(F.lit("u"), "id").alias("uuid"), F.concat(F.lit("n"), "id").alias("first_name"), (F.col("id") % 90 + 10).cast("int").alias("age"), F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("sex"), F.lit(None).cast("string").alias("unit"), F.lit("shy").alias("persona"), F.lit(1).alias("extra"))
    people.write.parquet(f"{tmp_path}/en_US.parquet")
    b = Builder(9).add_column(name="p", kind="sampler", sampler_type="person", params={"sex": "F", "age_range": [20, 60], "with_synthetic_personas": True})
    b.add_column(name="hi", kind="expression", expr="Hi {{ p.first_name }}")
    r = Resources(people=str(tmp_path))
    rows = Planner(spark, b.build(), r).plan(50).collect()
    assert len(rows) == 50 and len({x.p.uuid for x in rows}) == 50 and all(x.p.sex == "F" and 20 <= x.p.age <= 60 and x.hi == f"Hi {x.p.first_name}" for x in rows)
    assert set(rows[0].p.asDict()) == {"uuid", "first_name", "age", "sex", "persona", "locale"}
    by_row = {x._row_id: x.p.uuid for x in rows}
    part = Planner(spark, b.build(), r, buffer_size=10, total=50).plan(50, groups=[1, 3]).collect()
    assert len(part) == 20 and all(by_row[x._row_id] == x.p.uuid for x in part)
    with pytest.raises(ValueError, match="are asked for"):
        Planner(spark, b.build(), r).plan(400)
    with pytest.raises(ConfigError, match="there are none"):
        Planner(spark, b.build(), Resources(people={"fr_FR": people})).plan(5)


def test_template_depth():
    parse("{{ " + "(" * 6 + "a" + " + 1)" * 6 + " }}")
    with pytest.raises(TemplateError, match="too large"):
        parse("{{ " + "(" * 8 + "a" + " + 1)" * 8 + " }}")
    parse("{{ " + " ~ ".join("abcdefghijklmnopqrst") + " }}")


def test_schemas_with_references_and_alternatives():
    s = {"$defs": {"cat": {"type": "object", "properties": {"kind": {"const": "cat"}, "lives": {"type": "integer"}}, "required": ["kind"]}, "dog": {"type": "object", "properties": {"kind": {"const": "dog"}}, "required": ["kind"]}}, "type": "object", "properties": {"pet": {"oneOf": [{"$ref": "#/$defs/cat"}, {"$ref": "#/$defs/dog"}], "discriminator": {"propertyName": "kind"}}, "code": {"type": "string", "pattern": "^[A-Z]{2}$"}, "n": {"allOf": [{"type": "integer"}, {"exclusiveMinimum": 3}, {"not": {"const": 7}}]}, "tags": {"type": "array", "uniqueItems": True, "maxItems": 2}}}
    assert conforms({"pet": {"kind": "cat", "lives": 9}, "code": "AB", "n": 4, "tags": [1, True]}, s)
    for bad in ({"pet": {"kind": "cow"}}, {"code": "abc"}, {"n": 3}, {"n": 7}, {"n": True}, {"tags": [1, 1]}, {"tags": [1, 2, 3]}):
        assert not conforms(bad, s), bad
    assert pruned({"pet": {"kind": "cat", "lives": 1, "x": 2}, "y": 1}, s) == {"pet": {"kind": "cat", "lives": 1}}
    assert pruned({"pet": {"kind": "dog", "lives": 1}}, s) == {"pet": {"kind": "dog"}}
    with pytest.raises(ValueError, match="can't be resolved"):
        conforms(1, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}})
    assert struct_of({"type": "object", "properties": {"a": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "b": {"type": ["string", "null"]}}}).simpleString() == "struct<a:bigint,b:string>"


def test_remote_validation_asks_again(spark):
    tries, waits = [], []

    def post(url, body):
        tries.append(len(body["data"]))
        if len(tries) < 3:
            raise TimeoutError
        return [{"is_valid": True}] * len(body["data"])

    frame = {}
    validate_remote(spark.createDataFrame([(1,)], "a int"), "v", ["a"], "http://x", post, 5, RemoteRules(retries=3, parallel=1), sleep=waits.append)
    # The work of a task, without Spark, so that tries can be counted.
    from weftline.operators import validate as va

    held = va.validate_local
    va.validate_local = lambda df, name, targets, judged, off=None: frame.update(f=judged)
    try:
        va.validate_remote(None, "v", ["a"], "http://x", post, 5, RemoteRules(retries=3, parallel=1), sleep=waits.append)
    finally:
        va.validate_local = held
    import pandas as pd

    assert frame["f"](pd.DataFrame({"a": [1, 2]}))["is_valid"].tolist() == [True, True] and tries == [2, 2, 2] and waits == [1.0, 2.0]


def test_rollout_sessions_are_joined(spark, tmp_path):
    (tmp_path / "c").mkdir(), (tmp_path / "h").mkdir(), (tmp_path / "c" / "tool-results").mkdir()
    (tmp_path / "c" / "s1.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s1", "version": "2", "message": {"role": "user", "content": "q"}}))
    (tmp_path / "c" / "history.jsonl").write_text("{}")
    (tmp_path / "c" / "tool-results" / "t.jsonl").write_text("{}")
    (tmp_path / "c" / "sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "projectPath": "/p", "summary": "about", "firstPrompt": "q"}]}))
    r = read_rollouts(spark, "claude_code", str(tmp_path / "c")).collect()
    assert len(r) == 1 and r[0].project_path == "/p" and json.loads(r[0].source_meta) == {"record_count": 1, "record_types": ["user"], "claude_versions": ["2"], "summary": "about", "first_prompt": "q"}
    (tmp_path / "h" / "g1.jsonl").write_text(json.dumps({"role": "user", "content": "u"}))
    (tmp_path / "h" / "sessions.json").write_text(json.dumps({"key": {"session_id": "g1", "created_at": "2025-01-01", "platform": "x"}}))
    (tmp_path / "h" / "other.json").write_text("[]")
    r = read_rollouts(spark, "hermes_agent", str(tmp_path / "h")).collect()
    assert len(r) == 1 and r[0].started_at == "2025-01-01" and json.loads(r[0].source_meta) == {"platform": "x", "session_key": "key"}


def test_command_line(spark, tmp_path, capsys):
    from weftline.__main__ import main

    make().write_config(f"{tmp_path}/c.json")
    assert main(["validate", f"{tmp_path}/c.json"]) == 0 and main(["list"]) == 0
    assert main(["create", f"{tmp_path}/c.json", "--rows", "30", "--out", f"{tmp_path}/set"]) == 0
    assert "30 rows" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/set/parquet-files").count() == 30
    Builder().add_column(name="x", kind="expression", expr="{{ nothing }}").write_config(f"{tmp_path}/bad.json")
    assert main(["validate", f"{tmp_path}/bad.json"]) == 1 and main(["preview", f"{tmp_path}/bad.json"]) == 1


def test_estimated_statistics_and_summaries(spark):
    from weftline.operators.profile import categorical, judge_scores, judge_summaries, numerical

    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"), F.lit("why").alias("w"))
    assert abs(numerical(df, ["id"], exact=False).first().median - 10_000) < 10
    assert [(r.value, r["rank"]) for r in categorical(df, ["v"], most=2).orderBy("rank").collect()] == [("0", 1), ("1", 2)]
    one = F.struct(F.struct(F.col("v").alias("score"), F.col("w").alias("reasoning")).alias("q")).alias("j")
    scores = judge_scores(df.select("id", one), "j", ["q"]).withColumn("row", F.monotonically_increasing_id())
    seen = []
    got = judge_summaries(scores, lambda kind, messages, parameters: seen.append(messages[0]["content"]) or {"content": "summed"})
    assert got == {"q": "summed"} and seen[0].count("why") == 20


def leaving(path):
    """A client that leaves a file for each call."""

    def ask(kind, messages, parameters):
        (path / uuid.uuid4().hex).write_text("")
        return {"content": "said " + messages[-1]["content"]}

    return ask


class Shouting(Processor):
    def after_batch(self, df):
        assert df.count() == df.distinct().count()  # processors may read as often as they like
        return df.withColumn("said", F.upper("said"))


class Doubling(Processor):
    def after_generation(self, df):
        return df.unionByName(df)


@pytest.mark.parametrize("kinds", [["shouting"], ["shouting", "shouting"], ["doubling"], ["shouting", "doubling"]])
def test_each_call_is_made_once_with_processors(spark, tmp_path, kinds):
    PROCESSORS.setdefault("shouting", Shouting)
    PROCESSORS.setdefault("doubling", Doubling)
    calls = tmp_path / "calls"
    calls.mkdir()
    b = Builder(1).with_seed(spark.range(100).withColumnRenamed("id", "n")).add_model("m", "any").add_column(name="said", kind="llm-text", prompt="{{ n }}", model_alias="m")
    for i, kind in enumerate(kinds):
        b.add_processor(ProcessorConfig(f"p{i}", kind))
    engine = Engine(spark, Resources(models={"m": leaving(calls)}))
    made = engine.create(b, 100, f"{tmp_path}/set").load_dataset()
    assert len(list(calls.iterdir())) == 100
    assert sorted(r.said for r in made.collect()) == sorted((f"SAID {n}" if "shouting" in kinds else f"said {n}") for n in range(100) for _ in range(2 if "doubling" in kinds else 1))
    shown = engine.preview(b, 100)
    assert shown.count() == made.count() and len(shown.collect()) == made.count()
    assert len(list(calls.iterdir())) == 200
    assert not (tmp_path / "set" / "_staging").exists() and not (tmp_path / "set" / "_staging-batch").exists()


def test_statistics_from_sketches(spark, tmp_path):
    """Extended and resumed datasets merge what blocks have; estimates lie within the bounds of exact statistics."""
    b = Builder(2).add_column(name="kind", kind="sampler", sampler_type="category", params={"values": ["a", "b", "c"], "weights": [5, 3, 2]})
    b.add_column(name="x", kind="sampler", sampler_type="gaussian", params={"mean": 5, "stddev": 2})
    b.add_column(name="n", kind="sampler", sampler_type="uniform", params={"low": 0, "high": 3000}, convert_to="int")
    b.add_column(name="half", kind="expression", expr="{{ n }}", dtype="int", skip=Skip("n < 1500"))
    rc = RunConfig(buffer_size=500, resume="always", statistics="sketches")
    Engine(spark, run_config=rc).create(b, 6000, f"{tmp_path}/set")
    one = tmp_path / "set" / "column-sketches" / "_row_group=0"
    before = sorted((p.name, p.stat().st_mtime_ns) for p in one.iterdir())
    shutil.rmtree(tmp_path / "set" / "parquet-files" / "_row_group=3")
    out = Engine(spark, run_config=rc).create(b, 20_000, f"{tmp_path}/set")
    assert before == sorted((p.name, p.stat().st_mtime_ns) for p in one.iterdir())
    meta = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert meta["estimated"]
    told, data = {r["column_name"]: r for r in meta["column_statistics"]}, out.load_dataset()
    for r in general(data).collect():
        got = told[r.column_name]
        assert (got["num_records"], got["num_null"], got["percent_null"], got["simple_dtype"]) == (20_000, r.num_null, r.percent_null, r.simple_dtype)
        assert abs(got["num_unique"] - r.num_unique) <= 0.05 * r.num_unique
    for r in numerical(data, ["x", "n", "half"]).collect():
        got = told[r.column_name]
        assert (got["min"], got["max"]) == (r.min, r.max)
        assert got["mean"] == pytest.approx(r.mean) and got["stddev"] == pytest.approx(r.stddev)
        held = data.where(F.col(r.column_name).isNotNull())
        assert abs(held.where(F.col(r.column_name) <= got["median"]).count() / held.count() - 0.5) <= 0.02
    assert told["kind"]["median"] is None and told["x"]["frequent"] is None
    exact = sorted(((r["count"], r["kind"]) for r in data.groupBy("kind").count().collect()), reverse=True)
    assert [(f["n"], f["value"]) for f in told["kind"]["frequent"]] == exact


def test_sketches_of_odd_columns(spark):
    df = spark.createDataFrame([(0, None, None, [2, 1]), (0, 1.0, None, [1, 2]), (1, None, None, None)], "b int, x double, s string, l array<int>")
    got = {r.column_name: r for r in merged(sketched(df, "b", ["s"])).collect()}
    assert (got["x"].num_records, got["x"].num_null, got["x"].mean, got["x"].median, got["x"].stddev) == (3, 2, 1.0, 1.0, None)
    assert (got["s"].num_null, got["s"].num_unique, got["s"].frequent) == (3, 0, None)
    assert (got["l"].num_null, got["l"].num_unique) == (1, 1)
    assert merged(sketched(df.limit(0), "b", ["s"])).count() == 0


def test_export_joins_parts_in_order(spark, tmp_path):
    seeds = spark.range(0, 500, 1, 6).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit('say "a, b"')).alias("odd, name"), F.array(F.col("id")).alias("list"))
    b = Builder(1).with_seed(seeds, order_by=["n"]).add_column(name="v", kind="expression", expr="{{ n }}")
    out = Engine(spark, run_config=RunConfig(buffer_size=50)).create(b, 500, f"{tmp_path}/set")
    for name in ("x.csv", "x.jsonl", "x.parquet"):
        out.export(f"{tmp_path}/{name}")
        assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("x")) == [name]
        got = {"csv": lambda p: spark.read.csv(p, header=True), "jsonl": spark.read.json, "parquet": spark.read.parquet}[name.split(".")[1]](f"{tmp_path}/{name}")
        assert sorted(int(r.v) for r in got.collect()) == list(range(500)) and set(got.columns) == {"n", "odd, name", "list", "v"}
        assert {r["odd, name"] for r in got.collect()} == {None, 'say "a, b"'}
        (tmp_path / name).unlink()
        for left in tmp_path.glob(f".{name}*"):
            left.unlink()
    empty = Builder(1).with_seed(spark.range(3).withColumnRenamed("id", "n")).add_column(name="v", kind="expression", expr="{{ n }}")
    Engine(spark).create(empty, 1, f"{tmp_path}/one").export(f"{tmp_path}/one.csv")
    assert (tmp_path / "one.csv").read_text() == "n,v\n0,0\n"

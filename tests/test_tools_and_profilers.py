"""Tool configs, profilers, and what the command line may name."""

import json
import time

import pytest

from weftline.__main__ import main
from weftline.operators.generate import EchoClient
from weftline.plans.config import Builder, ConfigError, lint
from weftline.plans.engine import PROFILERS, Engine, RunConfig, RunError, register_profiler
from weftline.plans.planner import Planner, Resources, timed


def asked(**tool):
    b = Builder(1).add_model("m", "any").add_tool("t", **tool)
    b.add_column(name="n", kind="sampler", sampler_type="category", params={"values": ["ab", "cde"]})
    return b.add_column(name="x", kind="llm-text", model_alias="m", prompt="{{ n }}", params={"tool_alias": "t"})


def resources(turns=1):
    def client(kind, messages, parameters):
        told = [m["content"] for m in messages if m["role"] == "tool"]
        if len(told) < turns:
            return {"content": "", "tool_calls": [{"id": "1", "name": "size", "arguments": {"text": messages[0]["content"]}}]}
        return {"content": "|".join(told)}

    return Resources(models={"m": client}, tools={"size": lambda text: len(text)})


def test_a_config_says_which_tools_and_how_many_turns(spark):
    rows = lambda b, r: {(x["n"], x["x"]) for x in Engine(spark, r).preview(b, 20).collect()}
    assert rows(asked(), resources()) == {("ab", "2"), ("cde", "3")}
    assert rows(asked(max_tool_call_turns=2), resources(3)) == {("ab", "2|2|no more tool calls are allowed"), ("cde", "3|3|no more tool calls are allowed")}
    with pytest.raises(ConfigError, match="'grep'"):
        Engine(spark, resources()).preview(asked(allow_tools=["grep"]), 2)
    assert [f.kind for f in lint(Builder.from_config(asked().build()).add_tool("other").build())] == []
    wrong = asked().build()
    wrong.tools = []
    assert [f.kind for f in lint(wrong) if f.level == "ERROR"] == ["invalid_tool_config"]
    with pytest.raises(ConfigError):
        Builder().add_tool("t", max_tool_call_turns=0)
    assert Planner(spark, asked(timeout_sec=1).build(), resources()).with_tools(asked().build().columns[1])[0].params == {"tools": ["size"]}


def test_a_slow_tool_is_told_so():
    assert timed(lambda s: time.sleep(s) or "done", 5)(s=0) == "done"
    assert timed(lambda s: time.sleep(s), 0.05)(s=2) == "the tool took more than 0.05 seconds"
    with pytest.raises(ZeroDivisionError):
        timed(lambda: 1 / 0, 5)()


def test_tools_are_looked_for_before_a_run(spark, tmp_path):
    engine = Engine(spark, Resources(models={"m": EchoClient()}), RunConfig(check_models=True))
    assert engine.check_tools(asked(allow_tools=["size"]).build()) == {"t": "nobody brings size"}
    with pytest.raises(RunError, match="tools"):
        engine.create(asked(), 2, str(tmp_path / "d"))


def test_profilers_run_by_name(spark, tmp_path):
    b = Builder(1).add_column(name="n", kind="sampler", sampler_type="category", params={"values": ["a"]}).add_profiler("sized", times=2)
    register_profiler("sized", lambda results, resources, times: {"sized": results.spark.range(times * results.count_records())})
    try:
        engine = Engine(spark)
        got = engine.create(Builder.from_config(b.build().to_json()), 7, str(tmp_path / "d"))
        told = engine.analyze(got)
        assert told["sized"].count() == 14 and "general" in told
        with pytest.raises(ConfigError):
            register_profiler("sized", print)
        got.config.profilers.append("unknown")
        with pytest.raises(ConfigError, match="unknown"):
            engine.analyze(got)
    finally:
        del PROFILERS["sized"]


def test_the_command_line_takes_resources(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "held_here.py").write_text("from weftline.operators.generate import EchoClient\nfrom weftline.plans.planner import Resources\nresources = Resources(models={'m': EchoClient()})\n\ndef make(spark):\n    return resources\n")
    monkeypatch.chdir(tmp_path)
    b = Builder(1).add_model("m", "any").add_column(name="n", kind="sampler", sampler_type="category", params={"values": ["a"]})
    b.add_column(name="x", kind="llm-text", model_alias="m", prompt="say {{ n }}").write_config("c.json")
    for i, named in enumerate(("held_here", "held_here:make")):
        assert main(["create", "c.json", "--rows", "3", "--out", str(tmp_path / f"d{i}"), "--resources", named, "--check"]) == 0
        assert {x["x"] for x in spark.read.parquet(f"{tmp_path}/d{i}/parquet-files").collect()} == {"echo: say a"}
    assert json.load(open(tmp_path / "d0/metadata.json"))["actual"] == 3
    assert main(["preview", "c.json", "--resources", "held_here:nothing"]) == 1 and "can't be found" in capsys.readouterr().err

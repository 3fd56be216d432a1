"""JSON paths against a plain evaluator, and what templates make of their matches."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import jsonpath
from weftline.functions.template import Compiler, TemplateError

DOC = {
    "one": 1,
    "odd name's": {"x": 5},
    "list": [1, 2, 3, 4, 5],
    "deep": {"a": {"list": [10, {"kind": "k", "x": None}], "x": "it's"}, "b": [], "x": True},
    "rows": [{"kind": "foo", "name": "house", "n": 1}, {"kind": "foo", "name": "cat", "n": 2.5}, {"kind": "bar", "name": "outside", "n": 3}, {"kind": "bar", "name": "dog", "n": "3"}, {"name": "lone", "kind": None}],
}


def ordered(v):
    if isinstance(v, dict):
        return {k: ordered(v[k]) for k in sorted(v)}
    return [ordered(x) for x in v] if isinstance(v, list) else v


def kids(v):
    return list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []


def below(v):
    return [v, *(d for c in kids(v) for d in below(c))]


PATHS = {
    "$": lambda d: [d],
    "$.one": lambda d: [d["one"]],
    "$.none": lambda d: [],
    "$['odd name\\'s'].x": lambda d: [5],
    "$.list[0]": lambda d: [1],
    "$.list[-1]": lambda d: [5],
    "$.list[9]": lambda d: [],
    "$.list[:2]": lambda d: d["list"][:2],
    "$.list[1:]": lambda d: d["list"][1:],
    "$.list[-3:-1]": lambda d: d["list"][-3:-1],
    "$.list[::2]": lambda d: d["list"][::2],
    "$.list[::-1]": lambda d: d["list"][::-1],
    "$.list[3:0:-2]": lambda d: d["list"][3:0:-2],
    "$.list[-9:9]": lambda d: d["list"],
    "$.list[2,0]": lambda d: [3, 1],
    "$['one','list']": lambda d: [d["one"], d["list"]],
    "$.rows[*].name": lambda d: [r["name"] for r in d["rows"]],
    "$.rows.name": lambda d: [],
    "$.deep.*": lambda d: kids(d["deep"]),
    "$..x": lambda d: [v["x"] for v in below(d) if isinstance(v, dict) and "x" in v],
    "$..*": lambda d: [c for v in below(d) for c in kids(v)],
    "$..list[0]": lambda d: [v["list"][0] for v in below(d) if isinstance(v, dict) and "list" in v],
    "$.rows[?(@.kind=='bar')].name": lambda d: ["outside", "dog"],
    "$.rows[?(@.n > 1)].name": lambda d: ["cat", "outside"],
    "$.rows[?@.n == 1 || @.kind != 'foo' && @.n].name": lambda d: ["house", "outside", "dog"],
    "$.rows[?(!(@.n))].name": lambda d: ["lone"],
    "$.rows[?@.kind == null].name": lambda d: ["lone"],
    "$.rows[?@.missing == @.gone].name": lambda d: [r["name"] for r in d["rows"]],
    "$.rows[?@.n >= $.list[2]].name": lambda d: ["outside"],
    "$.rows[?length(@.name) > 4].name": lambda d: ["house", "outside"],
    "$.rows[?match(@.name, 'c.t')].n": lambda d: [2.5],
    "$.rows[?search(@.name, 'o')].n": lambda d: [1, 3, "3"],
    "$..[?@.x == 5].x": lambda d: [5],
    "$.rows[?@.name < 'd'].name": lambda d: ["cat"],
}


@pytest.mark.parametrize("part", range(4))
def test_paths_equal_a_plain_evaluator(spark, part):
    doc, some = ordered(DOC), list(PATHS.items())[part::4]
    df = spark.createDataFrame([(json.dumps(DOC),)], "j string")
    row = df.select(*(F.transform(jsonpath.matches(F.try_parse_json("j"), jsonpath.parse(p)), lambda x: F.to_json(x)).alias(f"p{i}") for i, (p, _) in enumerate(some))).first()
    for i, (path, want) in enumerate(some):
        assert [json.loads(x) for x in row[i]] == want(doc), path


def test_random_documents(spark):
    r = random.Random(4)

    def made(level):
        k = r.randrange(6 if level < 5 else 4)
        return [r.randrange(9), r.choice("abc"), None, r.random() < 0.5, *([lambda: [made(level + 1) for _ in range(r.randrange(4))], lambda: {c: made(level + 1) for c in r.sample("abcd", r.randrange(4))}] if level < 5 else [])][k]

    def whole(v):
        v = v() if callable(v) else v
        return {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else [whole(x) for x in v] if isinstance(v, list) else v

    docs = [ordered({"a": whole(made(0)), "b": whole(made(0)), "c": [whole(made(1)) for _ in range(3)]}) for _ in range(60)]
    paths = {"$..a": lambda d: [v["a"] for v in below(d) if isinstance(v, dict) and "a" in v], "$..[1]": lambda d: [v[1] for v in below(d) if isinstance(v, list) and len(v) > 1], "$.c[1:]..b": lambda d: [v["b"] for x in d["c"][1:] for v in below(x) if isinstance(v, dict) and "b" in v], "$..[?@.a]": lambda d: [c for v in below(d) for c in kids(v) if isinstance(c, dict) and "a" in c]}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string")
    got = df.select("i", *(F.transform(jsonpath.matches(F.try_parse_json("j"), jsonpath.parse(p)), lambda x: F.to_json(x)).alias(f"p{k}") for k, p in enumerate(paths))).collect()
    for row in got:
        for k, (path, want) in enumerate(paths.items()):
            assert [json.loads(x) for x in row[k + 1]] == want(docs[row.i]), (path, docs[row.i])


def test_templates_show_matches_as_python(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), ("[1]",), ("text",), (None,), (json.dumps({"rows": [{"name": 'say "it\'s"\n\\'}, {"name": {"b": [None, True, 1.5], "a": "é"}}]}),)], "j string")
    c = Compiler(df.schema)
    names = {"list": "{{ j|jsonpath('$.list[:2]') }}", "names": "{{ j|jsonpath('$.rows[*].name') }}", "loop": "{% for x in j|jsonpath('$.rows[*]') %}{{ x.name }};{% endfor %}", "most": "{{ j|jsonpath('$.list[*]')|max }}", "n": "{{ j|jsonpath('$.rows[*]')|length }}", "first": "{{ (j|jsonpath('$..x'))|first }}"}
    rows = df.select(*(c.render(t).alias(k) for k, t in names.items())).collect()
    assert rows[0].list == str(DOC["list"][:2]) and rows[0].names == str([r["name"] for r in DOC["rows"]])
    assert (rows[0].loop, rows[0].most, rows[0].n) == ("house;cat;outside;dog;lone;", "5", "5")
    assert all(rows[k].list is None for k in (1, 2))
    assert rows[4].names == str(['say "it\'s"\n\\', {"a": "é", "b": [None, True, 1.5]}]) and rows[4].list == "[]"


def test_a_struct_column(spark):
    df = spark.sql("SELECT named_struct('a', array(named_struct('x', 1), named_struct('x', 2))) AS s")
    assert df.select(Compiler(df.schema).render("{{ s|jsonpath('$.a[?@.x > 1]') }}")).first()[0] == "[{'x': 2}]"


def test_deeper_documents_fail(spark):
    deep = "[" * 40 + "]" * 40
    df = spark.createDataFrame([('{"a": 1}',), (f'{{"a": 1, "b": {deep}}}',)], "j string")
    assert [r[0] for r in df.select(Compiler(df.schema).render("{{ j|jsonpath('$..a') }}")).collect()] == ["[1]", None]


@pytest.mark.parametrize("path", ["", "a", "$.", "$[", "$[]", "$.a[?]", "$[?@.a ==]", "$[1.5]", "$[::0]", "$.a b", "$[?nope(@.a)]", "$[?1]"])
def test_wrong_paths(spark, path):
    df = spark.createDataFrame([("{}",)], "j string")
    with pytest.raises(TemplateError):
        Compiler(df.schema).render("{{ j|jsonpath(" + json.dumps(path) + ") }}")


def test_no_python_in_the_plan(spark):
    df = spark.range(3).selectExpr("to_json(named_struct('a', array(id, id + 1))) AS j")
    plan = df.select(Compiler(df.schema).render("{{ j|jsonpath('$..a[?@ > 1]') }}"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow", plan)


def test_documents_are_parsed_once(spark):
    from weftline.queries import templated

    df = spark.createDataFrame([(1, '{"a": [{"b": 1, "c": "x"}, {"b": 2}]}'), (2, "text")], "i int, j string")
    made = templated(df, ["i"], {"b": "{{ j|jsonpath('$.a[*].b') }}", "c": "{{ j|jsonpath('$.a[?@.b > 1].b') }}", "n": "{{ j|jsonpath('$..b')|length }}"})
    assert made._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1
    assert made.orderBy("i").collect() == [(1, "[1, 2]", "[2]", "2"), (2, None, None, None)]


def test_members_of_whatever_kind(spark):
    rows = [{"a": {"b": 1}, "n": 1}, {"a": {"b": None}, "n": None}, {"a": 2, "n": "y,z"}, 7, [{"n": 8}], None, {"a": {"b": "1"}, "n": {"m": 3}}, {"a": {"b": True}, "n": -4.5}, {"A": 1, "n": 6}]
    held = lambda x, *names: held(x[names[0]], *names[1:]) if names and isinstance(x, dict) and names[0] in x else [] if names else [x]
    paths = {
        "$.x[*].a.b": lambda k: [y for x in k for y in held(x, "a", "b")],
        "$.x[?@.a.b == 1].n": lambda k: [x["n"] for x in k if held(x, "a", "b") == [1] and x["a"]["b"] is not True],
        "$.x[?@.a.b == true].n": lambda k: [x["n"] for x in k if held(x, "a", "b")[:1] == [True] and x["a"]["b"] is True],
        "$.x[?@.a.b != 1].n": lambda k: [y for x in k if held(x, "a", "b") != [1] or x["a"]["b"] is True for y in held(x, "n")],
        "$.x[?@.a].n": lambda k: [y for x in k if held(x, "a") for y in held(x, "n")],
        "$.x[?@.a && @.a.b].n": lambda k: [y for x in k if held(x, "a", "b") for y in held(x, "n")],
        "$.x[?!(@.a.b)].n": lambda k: [y for x in k if not held(x, "a", "b") for y in held(x, "n")],
        "$.x[?@.a && @.A].n": lambda k: [],
        "$.x[?@.A].n": lambda k: [6],
    }
    only = {"$.x[:3].n": lambda k: [y for x in k[:3] for y in held(x, "n")], "$.x[::-2].n": lambda k: [y for x in k[::-2] for y in held(x, "n")], "$.x[-3].n.m": lambda k: [3], "$.x[-1,0,2].n": lambda k: [6, 1, "y,z"]}
    df = spark.createDataFrame([(json.dumps({"x": rows}),), (json.dumps({"x": {f"k{i}": x for i, x in enumerate(rows)}}),), ('{"x": 3}',)], "j string")
    got = df.select(*(F.transform(jsonpath.matches(F.try_parse_json("j"), jsonpath.parse(p)), lambda x: F.to_json(x)).alias(f"p{k}") for k, p in enumerate(paths | only))).collect()
    for k, (path, want) in enumerate((paths | only).items()):
        assert [json.loads(x) for x in got[0][k]] == want(rows), path
        assert [json.loads(x) for x in got[1][k]] == (want(rows) if path in paths else []), path
        assert got[2][k] == [], path

"""Repair of JSON: what broken texts mean, and the native fold against the plain one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.jsonrepair import repair, repaired
from weftline.operators.validate import json_block

CASES = {
    '{"a": 1,}': {"a": 1},
    '{"a": [1, 2,, 3,], }': {"a": [1, 2, 3]},
    "{'a': 'it\\'s', 'b': 'say \"x\"'}": {"a": "it's", "b": 'say "x"'},
    "{a: 1, b_c: two words, d: yes}": {"a": 1, "b_c": "two words", "d": "yes"},
    '{"a": {"b": [1, {"c": "cut o': {"a": {"b": [1, {"c": "cut o"}]}},
    '{"a": "x", "b"': {"a": "x", "b": None},
    '{"a": "x", "b":': {"a": "x", "b": None},
    '{"a": 1, "b": , "c": 3}': {"a": 1, "b": None, "c": 3},
    '{"a": True, "b": None, "c": FALSE}': {"a": True, "b": None, "c": False},
    '{"a": 1 "b": 2}': {"a": 1, "b": 2},
    '{"a" 1, "b" [2 3]}': {"a": 1, "b": ["2 3"]},
    '[1, 2, {"a": 3]': [1, 2, {"a": 3}],
    '{"a": [1, 2}': {"a": [1, 2]},
    '{"a": 1}} trailing } words': {"a": 1},
    '{{"a": 1}}': {"a": 1},
    '{"a": "line\nbreak\tand \\q"}': {"a": "line\nbreak\tand \\q"},
    '{"a": -1.5e3, "b": 007, "c": .5}': {"a": -1500.0, "b": "007", "c": ".5"},
    '{"a": "ends in \\': {"a": "ends in "},
    "[]": [],
    "[": [],
    '["é", "\\u00e9", "\\""]': ["é", "é", '"'],
}


@pytest.mark.parametrize("text", CASES)
def test_what_broken_texts_mean(text):
    assert json.loads(repair(text)) == CASES[text]


def test_the_native_fold_is_the_same(spark):
    r, some = random.Random(3), list(CASES) + ["", " ", "]", "{", "x", "{:", '{"', "{'", "[,", "{,}", "[[[", '{"a":{"b":{"c":', "\\", '{"a": \\"x\\"}']
    for _ in range(400):
        text = json.dumps({"key": [1, "two", {"three": None}], "other": {"x": True, "y": 'q"\\'}})
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(len(text))
            text = text[:k] + r.choice(["", "'", '"', ",", ":", "}", "]", "{", "[", "\\", " w "]) + text[k + r.randrange(2) :]
        some.append(text[: r.randrange(len(text) + 1)])
    got = [x[0] for x in spark.createDataFrame(list(enumerate(some)), "i int, t string").orderBy("i").select(repaired(F.col("t"))).collect()]
    for text, native in zip(some, got, strict=True):
        assert native == repair(text), text
        if text.lstrip()[:1] in ("{", "["):
            json.loads(native)


def test_blocks(spark):
    texts = ['Here:\n```json\n{"k": 1}\n```', 'It is {"k": 1,} ok', "nothing", '```json\n{"k": [1, 2', "so ```json\n{'k': 1}\n``` and\n```json\n{k: 2,\n```", None, "```python\nx\n```", 'text {"k": 1'] + ['{"k": "' + "long \\n" * 20_000, "{'k': " + "two words " * 20_000]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json_block(F.col("t"))).collect()]
    assert [x and json.loads(x) for x in got[:-2]] == [{"k": 1}, {"k": 1}, None, {"k": [1, 2]}, {"k": 2}, None, None, {"k": 1}]
    assert len(json.loads(got[-2])["k"]) == 120_000 and len(json.loads(got[-1])["k"]) == 199_999

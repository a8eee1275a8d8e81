"""The strict decoder against Python's."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veridane.functions.strict_json import object_entries


def plain(text):
    try:
        pairs = json.loads(text, object_pairs_hook=lambda p: ("object", p))
    except json.JSONDecodeError:
        return None
    truth = lambda v: bool(v[1]) if isinstance(v, tuple) else bool(v)
    return [(k, truth(v)) for k, v in pairs[1]]


def texts():
    r = random.Random(4)
    atoms = ["1", "-0", "0.0", "1e5", "-1E-400", "01", "1.", "+1", "-", ".5", "true", "false", "null", "True", "NaN", "-Infinity", "Infinity", "+Infinity", "-NaN", '""', '"a"', '"\\u00e9\\n"', '"\\ud800"', '"\\q"', '"a\nb"', "'a'", '"é😀"', "tru", "nulll", "1 2"]
    keys = ['"a"', '"A"', '"b b"', '""', '"\\u0061"', "a", "1", '"a\\"b"', '"]}"']

    def value(depth):
        kind = r.random()
        if depth > 3 or kind < 0.5:
            return r.choice(atoms)
        inner = [value(depth + 1) for _ in range(r.randint(0, 3))]
        return "[" + ",".join(inner) + r.choice(["]"] * 12 + [",]", "}", ""]) if kind < 0.7 else thing(depth + 1)

    def thing(depth=0):
        gap = lambda: r.choice(["", "", "", " ", "\n\t", " " if r.random() < 0.03 else ""])
        good = r.choice([0, 1])
        pairs = [f"{gap()}{r.choice(keys[:5] if good else keys)}{gap()}{r.choice([':'] * 20 + ['', '::'])}{gap()}{value(depth)}{gap()}" for _ in range(r.randint(0, 4))]
        return "{" + ",".join(pairs) + r.choice(["}"] * 20 + [",}", "]", ""])

    return [*[thing() for _ in range(1500)], "{}", "{", "}", "", "[]", "1", '{"a":1}}', '{"a":1} x', '{"a":{}}', '{"a":[]}', '{"a":[ ]}', '{"a":{"b":1},"c":[{"d":2}]}', '{"a":' + "[" * 900 + "]" * 900 + "}"]


def test_entries_equal_those_of_python(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    got = {r["k"]: r["e"] if r["e"] is None else [tuple(e) for e in r["e"]] for r in spark.createDataFrame(rows, "k int, t string").select("k", object_entries(F.col("t")).alias("e")).collect()}
    want = {k: plain(t) if t.startswith("{") else None for k, t in rows}
    bad = {k: (rows[k][1], got[k], want[k]) for k in want if got[k] != want[k]}
    assert not bad, list(bad.values())[:5]
    assert sum(v is not None for v in want.values()) > 300 and sum(v is None for v in want.values()) > 300


@pytest.mark.parametrize("depth", [20_000])
def test_depth_has_no_limit(spark, depth):
    text = '{"a": ' + '{"b": [' * depth + "]}" * depth + ', "c": 0, "' + "k" * 70_000 + '": 1' + "0" * 5000 + "}"
    e = spark.createDataFrame([(text,)], "t string").select(object_entries(F.col("t")).alias("e")).first()["e"]
    assert [(x["key"][:2], x["truth"]) for x in e] == [("a", True), ("c", False), ("kk", True)]

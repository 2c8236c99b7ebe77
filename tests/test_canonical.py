"""Canonical JSON: built-in functions for plain texts give what Python gives, and Python sees only the others."""

import json
import random

import pytest

from auditloom.functions import canonical

ODD = ['{"a":1}{"b":2}', '{"a":1} 2', '{"a":1,"a":2}', '{"a":1,"a":1}', '{"a":-0}', '{"a":01}', '{"a":1,}', "{a:1}", "[1]", '{"a":1 2}', '{"a": tru}', '{"a":truefalse}', '{"a":1}}', "{{}}", '{"a":--1}', '{"a":1-2}', '{"a":9999999999999999999}', '{"a":- 1}', "{}{}", '{"a"1}', '{"":1}', '{"a":1.50}', '{"a":"\\ud83d"}', '{"a":"\\u2028"}', '{"\ue000":1,"\U0001f600":2}', " {}", "{ }"]
PLAIN = ['{"b":1,"a":{"d":2,"c":[1,null,true]}}', '{"a": "x < y & z", "B": [false, -12]}', '{"é":"\u2028"}', '{"a":999999999999999999}', '{"t":"' + "x" * 100_000 + '"}', "{}", ""]


def _random(seed: int, count: int) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice('ab<& é"\\{}:,-0\U0001f600') for _ in range(r.randrange(4)))

    def value(depth: int):
        kind = r.randrange(8 if depth < 3 else 6)
        if kind == 6:
            return {word(): value(depth + 1) for _ in range(r.randrange(4))}
        if kind == 7:
            return [value(depth + 1) for _ in range(r.randrange(3))]
        return [None, True, False, r.randrange(-5, 10**19), word(), 0.5][kind]

    texts = [json.dumps({word(): value(0) for _ in range(r.randrange(4))}, ensure_ascii=r.random() < 0.2) for _ in range(count)]
    return [t[:i] + r.choice(["", "1", "-", ",", '"', "}", " "]) + t[i + 1 :] if r.random() < 0.2 else t for t in texts for i in [r.randrange(len(t))]]


def _canonical(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, metadata string").repartition(4)
    return {r.i: r.canonical_metadata for r in canonical.with_canonical(df).collect()}


def test_equals_python(spark):
    texts = [None, *ODD, *PLAIN, *_random(7, 2000)]
    found = _canonical(spark, texts)
    assert [(t, found[i]) for i, t in enumerate(texts)] == [(t, canonical.canonical_json(t)) for t in texts]


def test_python_sees_no_plain_text(spark, monkeypatch):
    def refuse(texts):
        assert texts.isna().all()
        return texts

    monkeypatch.setattr(canonical, "_canonical", refuse)
    assert len(_canonical(spark, [*PLAIN, None])) == len(PLAIN) + 1
    with pytest.raises(Exception, match="AssertionError"):
        _canonical(spark, ['{"a":1.5}'])


def test_broken_and_deep_texts():
    assert canonical.canonical_json('{"a":"\\ud83d!"}') == '{"a":"\ufffd!"}'
    deep = '{"a":' + "[" * 100_000 + "]" * 100_000 + "}"
    assert canonical.canonical_json(deep) == deep

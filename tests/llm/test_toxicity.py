"""The toxicity classifier against plain Python, and texts of odd shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import docs_of, held

from auditloom.llm import toxicity
from auditloom.llm.queries import op4_toxicity

LABELS = "doc_id long, quality int, toxic int"


def sparse(rows, columns):
    filled = [(i, j, x) for i, r in enumerate(rows) for j, x in enumerate(r) if x]
    return toxicity.Rows(len(rows), columns, *(np.array(c) for c in zip(*filled, strict=True)))


def risk_model(w, b, xp, xu, prior):
    """The positive part of the risk, and the negative part before it is clipped."""
    z = lambda x: sum(a * c for a, c in zip(w, x, strict=True)) + b
    loss = lambda s: math.log(1 + math.exp(-s))
    mean = lambda xs: sum(xs) / len(xs)
    return prior * mean([loss(z(x)) for x in xp]), mean([loss(-z(x)) for x in xu]) - prior * mean([loss(-z(x)) for x in xp])


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_risk_and_gradient(prior):
    """The gradient is that of the unbiased risk, or upwards on the clipped part where that is negative."""
    rnd = random.Random(4)
    xp = [[rnd.choice([0, 0, rnd.random()]) for _ in range(5)] for _ in range(7)]
    xu = [[rnd.choice([0, 0, rnd.random()]) for _ in range(5)] for _ in range(9)]
    for _ in range(6):
        w, b = np.array([rnd.gauss(0, 1) for _ in range(5)]), rnd.gauss(0, 2)
        positive, negative, grad, grad_b = toxicity.risk_gradient(w, b, sparse(xp, 5), sparse(xu, 5), prior)
        assert (positive, negative) == pytest.approx(risk_model(w, b, xp, xu, prior))
        goal = lambda v, c: (lambda p, n: p + n if negative >= 0 else -n)(*risk_model(v, c, xp, xu, prior))  # noqa: B023, E731
        step = 1e-6
        slopes = [(goal(w + step * e, b) - goal(w - step * e, b)) / (2 * step) for e in np.eye(5)]
        assert grad == pytest.approx(slopes, abs=1e-5) and grad_b == pytest.approx((goal(w, b + step) - goal(w, b - step)) / (2 * step), abs=1e-5)


def test_worst_window_is_the_worst():
    """Against every window of two halves, with weights of both signs."""
    rnd = random.Random(6)
    words = [b"bad", b"evil", b"sweet", b"plain", b"word"]
    model = toxicity.PuClassifier([toxicity.features_of(w)[0] for w in words[:3]], np.array([1.0, 2.0, -3.0]), -1.5)
    for n in [0, 1, 99, 100, 101, 200, 201, 950]:
        text = rnd.choices(words, [1, 1, 2, 30, 30], k=n)
        blocks = [text[i : i + toxicity.HALF] for i in range(0, max(n, 1), toxicity.HALF)]
        windows = [a + b for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        value = lambda x: sum(w * math.log1p(100 * x.count(k) / (len(x) + 20)) for w, k in zip((1.0, 2.0, -3.0), words, strict=False)) - 1.5
        assert model.worst(b" ".join(text))[2] == pytest.approx(max(map(value, windows)))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(20, 200))]
        if toxic := rnd.random() < 0.2:
            for w in rnd.sample(["vile", "nasty", "filth"], 2):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("words", [50, 5000, 200_000])
def test_length_and_place_do_not_hide_toxic_words(spark, corpus, words):
    rows, labels = corpus
    calm = "w1 w2 w3 w4 w5 " * (words // 5)
    docs = docs_of(spark, [*rows, (900, calm), (901, f"vile filth {calm}"), (902, f"{calm} vile filth"), (903, f"{calm[: len(calm) // 2]} vile filth {calm[len(calm) // 2 :]}")])
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS), held(docs.doc_id, 4, 2)).where("doc_id >= 900").collect()}
    assert got == {900: 0, 901: 1, 902: 1, 903: 1}


def test_repeated_rows_count_once(spark, corpus):
    rows, labels = corpus
    known = spark.createDataFrame(labels, LABELS)
    score = lambda rows: {r.doc_id: r.score for r in (lambda d: toxicity.toxicity(d, known, held(d.doc_id, 4, 2)))(docs_of(spark, rows)).collect()}
    once, often = score(rows), score([*rows, *rows[:50] * 3])
    assert often == pytest.approx(once, abs=1e-6)


def test_query_finds_held_out_toxic_texts(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where(F.col("toxic").isNotNull()).collect()}
    got = op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t == p for t, p in out) >= 0.9 * len(out) and len(out) > 50

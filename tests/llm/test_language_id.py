"""The kernel and its regression against plain Python; every language is learned."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import docs_of, held

from auditloom.llm import language_id
from auditloom.llm.queries import op5_language_id


def kernel_model(a, b):
    """Shared hashed n-grams, normalised, by sets."""
    places = lambda t: {((int.from_bytes(t[i : i + n], "big") + ((n - 1) << 24)) * 2654435761 & 0xFFFFFFFF) >> 18 for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, y = places(a), places(b)
    return len(x & y) / (max(1, len(x)) * max(1, len(y))) ** 0.5


def texts_of(rnd, n, parts):
    return [" ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(rnd.randint(3, 40))).encode() for _ in range(n)]


def test_kernel_and_regression():
    """With every text a landmark, Nystroem features are exact and the decision is that of weighted kernel ridge regression."""
    rnd = random.Random(3)
    texts, langs = texts_of(rnd, 12, ["the", "ing", "wh"]) + texts_of(rnd, 8, ["sch", "ung", "ß"]), ["aa"] * 12 + ["bb"] * 8
    model = language_id.KernelRidge(np.array([np.packbits(language_id.presence(t)) for t in texts]), langs)
    k = np.array([[kernel_model(a, b) for b in texts] for a in texts])
    new = texts_of(rnd, 5, ["the", "sch", "x"])
    assert language_id.features(new) @ language_id.features(texts).T == pytest.approx(np.array([[kernel_model(a, b) for b in texts] for a in new]), abs=1e-5)
    # primal in the kernel's own feature space: minimise sum of w (f + b - y)^2 + r (|f|^2 + b^2)
    weight = np.array([20 / (2 * langs.count(x)) for x in langs])
    r = 1e-2 * 20 / 2
    both = k + 1  # the bias is a feature that is always one
    for i, lang in enumerate(model.langs):
        y = np.array([1.0 if x == lang else -1.0 for x in langs])
        alpha = np.linalg.solve(both + r * np.diag(1 / weight), y)
        want = [sum(a * (kernel_model(t, u) + 1) for a, u in zip(alpha, texts, strict=True)) for t in new]
        assert model.decision(new)[:, i] == pytest.approx(want, abs=1e-3)


def test_many_languages_and_repeated_rows(spark):
    """More languages than any fixed number; one language has a third of all rows, all of one document."""
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèß"
    parts = {f"l{i:03d}": ["".join(rnd.choice(letters) for _ in range(3)) for _ in range(3)] for i in range(120)}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 8)]
    rows += [(5000, "rare once word" * 20, "zz")] + [(6000, rows[0][1], rows[0][2])] * 400
    docs = docs_of(spark, rows)
    got = language_id.identify(docs, held(docs.doc_id, 3, 1), per_language=5).collect()
    truth = {i: lang for i, _, lang in rows}
    out = [r for r in got if r.held_out and r.doc_id < 5000]
    assert len(got) == len(rows) and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.9 * len(out)
    assert len({r.lang_pred for r in got}) >= 118 and len({(r.lang_pred, round(r.score, 4)) for r in got if r.doc_id == 6000}) == 1
    flags, langs = language_id.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang", 5)
    assert len(flags) == len(langs) and set(langs) == set(truth.values())


def test_long_texts_are_learned_from(spark):
    docs = docs_of(spark, [(1, "schung " * 200_000, "de"), (2, "thing " * 200_000, "en"), (3, "unschung", None), (4, "things", None)])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, docs.doc_id > 2).collect()}
    assert got == {1: "de", 2: "en", 3: "de", 4: "en"}


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").collect()}
    out = [r for r in op5_language_id(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out) and len(out) > 100

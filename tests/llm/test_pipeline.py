"""The corpus pipeline against its stages done by brute force, and its defined cases."""

import itertools
import math
import random
from collections import Counter

import corpus_pipeline
from test_text_operators import base_model, fingerprint_model, kneser_ney_model, least_reachable, substring_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "é", "ou", "st"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(50))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(55, 160))), "en") for i in range(140)]
    rows += [(200 + i, rows[i % 9][1], "en") for i in range(30)]
    rows += [(300 + i, f"{rows[40 + i][1]} {passage} {rows[60 + i][1]}", "en") for i in range(15)]
    long = [word() for _ in range(900)]
    rows += [(400 + i, " ".join([*long[:i], "edit", *long[i:]]), "en") for i in range(12)]
    rows += [(500, "\x01\x02 \x03\x04 " * 5 + " ".join(chr(rnd.randint(33, 126)) * 3 for _ in range(200)), "en"), (501, None, None), (502, "", "en"), (503, "too few words", "fr"), (504, "again and again " * 60, "en")]
    return rows


def brute(rows):
    texts = {i: (t or "").encode() for i, t, _ in rows}
    p = kneser_ney_model(list(texts.values()))
    lp = {i: -sum(math.log(p((b"\0\0\0" + b)[k : k + 4])) for k in range(len(b))) / max(1, len(b)) for i, b in texts.items()}
    passed = [i for i, t, _ in rows if (c := base_model(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    ranked = sorted(lp[i] for i in passed)
    q1, q3 = (ranked[math.ceil(x * len(ranked)) - 1] for x in (0.25, 0.75))
    docs = {i: texts[i] for i in passed if q1 - 4 * (q3 - q1) <= lp[i] <= q3 + 4 * (q3 - q1)}
    last = {}
    for i, b in docs.items():
        last[b] = max(i, last.get(b, i))
    docs = {i: b for b, i in last.items()}
    fps = {i: fingerprint_model(b.decode()) for i, b in docs.items()}
    least = least_reachable(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    docs = {i: docs[i] for i in docs if least[i] == i}
    cut = substring_model([(i, b.decode()) for i, b in docs.items()], 100)
    return {i: c[3].decode("utf-8", "ignore") for i, c in cut.items()}, len(passed)


def test_pipeline(spark, tmp_path):
    rows = fixture()
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept, passed = brute(rows)
    assert len(kept) < passed < len(rows) and any(len(t) < len(dict((r[0], r[1]) for r in rows)[i]) for i, t in kept.items())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter((i, p, min(2048, n - 2048 * p)) for i, t in kept.items() for n in [len(t.encode().split())] for p in range(max(1, math.ceil(n / 2048))))
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == pieces


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    good = " ".join(f"w{i}" for i in range(80))
    odd = [(None, None, None, None, None), (None, good, None, None, None), (7, good + " x", "en", "s", 5), (7, good + " x", "en", "s", 5)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(str(tmp_path / "b/documents.parquet"))
    linked = (fingerprint_model(good) ^ fingerprint_model(good + " x")).bit_count() <= 2
    got = Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path / "b")).collect())
    assert got == Counter({(7, 0): 1} if linked else {(None, 0): 1, (7, 0): 1})


def test_near_stage_keeps_one_of_each_group_where_ids_repeat(spark, tmp_path):
    texts = [" ".join(f"{x}{i}" for i in range(400)) for x in "abcd"]
    near = lambda t: t.upper()  # noqa: E731  the same fingerprint
    rows = [(5, texts[0]), (5, near(texts[0])), (5, texts[1]), (None, near(texts[1])), (None, texts[2]), (None, texts[3]), (None, near(texts[3])), (9, near(texts[2]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text.lower()) for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect())
    assert got == Counter({(5, texts[0]): 1, (5, texts[1]): 1, (9, texts[2]): 1, (None, texts[3]): 1})

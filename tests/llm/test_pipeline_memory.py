"""How much of the texts the pipeline's stages move, and in what pieces texts go to Python."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_pipeline import SCHEMA

from auditloom.llm import common, perplexity

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shuffled(spark):
    """Bytes that this session's tasks have written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def noise(rnd, words):
    return " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(words))


def test_exact_stage_moves_only_texts_that_have_copies(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, noise(rnd, 2000), "en", "s", 1) for i in range(150)]
    rows += [(200, *rows[0][1:]), (200, *rows[0][1:]), (None, *rows[1][1:]), (None, *rows[2][1:]), (1, *rows[1][1:])]
    spark.createDataFrame([*rows, (None, None, None, None, None), (None, "", "en", "s", 0), (300, "", "en", "s", 0)], SCHEMA).write.parquet(str(tmp_path / "d"))
    docs, before = spark.read.parquet(str(tmp_path / "d")), shuffled(spark)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect())
    size = sum(len(r[1]) for r in rows)
    assert shuffled(spark) - before < size / 5
    assert got == Counter([(200, rows[0][1]), *((r[0], r[1]) for r in rows[1:150]), (300, "")])


def test_exact_stage_keeps_its_rows_when_the_filter_is_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "FILTER_BITS", 1)
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (None, None), (4, "d"), (5, "d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(2, "a"), (3, "b"), (None, "c"), (None, None), (5, "d")], key=repr)


def test_quality_stage_moves_only_texts_that_may_go(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, noise(rnd, 3000), "en", "s", 1) for i in range(120)]
    bad = [(500 + i, "too few words", "en", "s", 1) for i in range(20)]
    spark.createDataFrame([*rows, rows[5], *bad, (None, None, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "d"))
    judged = perplexity.quality_rules

    def written_first(*args, **options):  # the model's own shuffles are not what is counted
        out = common.written(judged(*args, **options), "judged")
        at.append(shuffled(spark))
        return out

    at = []
    monkeypatch.setattr(corpus_pipeline, "quality_rules", written_first)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path)).collect())
    assert shuffled(spark) - at[0] < sum(len(r[1]) for r in rows) / 5
    want = Counter((r.doc_id, r.text) for r in spark.createDataFrame([*rows, rows[5], *bad], SCHEMA).join(judged(spark.createDataFrame([*rows, rows[5], *bad, (None, None, None, None, None)], SCHEMA)).where("kept").select("doc_id"), "doc_id", "left_semi").collect())
    assert got == want and len(want) > 100


def test_near_stage_moves_only_texts_that_may_go(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, noise(rnd, 2000), "en", "s", 1) for i in range(150)]
    spark.createDataFrame([*rows, (700, rows[7][1].upper(), "en", "s", 1)], SCHEMA).write.parquet(str(tmp_path / "d"))
    docs, before = spark.read.parquet(str(tmp_path / "d")), shuffled(spark)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect())
    assert shuffled(spark) - before < sum(len(r[1]) for r in rows) / 5
    assert got == Counter((r[0], r[1]) for r in rows)


@pytest.mark.parametrize("bits", [1, 1 << 25])
def test_repeated_rows_stay_all_or_once(spark, monkeypatch, bits):
    monkeypatch.setattr(corpus_pipeline, "FILTER_BITS", bits)
    rows = [(1, "a", True), (1, "a", True), (2, "b", False), (2, "b", True), (3, "c", False), (3, "c", False), (4, "d", True)]
    judged = spark.createDataFrame([(i, t, k) for i, t, k in rows], "key_id long, key_text string, kept boolean")
    keyed = spark.createDataFrame([(i, t, "en", "s", 1, i, t) for i, t, _ in rows], SCHEMA + ", key_id long, key_text string")
    keys = ["key_id", "key_text"]
    assert Counter(r.doc_id for r in corpus_pipeline._staying(keyed, keys, judged, "not kept").collect()) == {1: 2, 2: 2, 4: 1}
    assert Counter(r.doc_id for r in corpus_pipeline._staying(keyed, keys, judged, "key_id < 4", once=True).collect()) == {1: 1, 2: 1, 4: 1}


def test_quality_rules_send_texts_to_python_in_small_batches(spark, monkeypatch):
    before, seen = spark.conf.get(BYTES), {}
    keep = perplexity.written
    monkeypatch.setattr(perplexity, "written", lambda df, name: (seen.setdefault(name, spark.conf.get(BYTES)), keep(df, name))[1])
    docs = spark.createDataFrame([(1, "a b c " * 30, "en"), (2, "d e f " * 30, "en")], "doc_id long, text string, lang string")
    perplexity.quality_rules(docs, labels=spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert {seen[x] for x in ("counts4", "words", "scored")} == {"4m"} and spark.conf.get(BYTES) == before


def test_small_batches_bound_what_a_task_sends_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield b.select(["n"]).slice(0, 0).from_pydict({"n": [b.nbytes]}, schema=b.select(["n"]).schema)

    rows = spark.range(0, 2000, 1, 1).selectExpr("id n", "repeat('x', 10000) t")
    with common.small_batches(spark, "1m"):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 19_000_000 and max(got) < 1_200_000

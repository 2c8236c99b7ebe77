"""Importance resampling, interleaved shards and source divergences against brute force, with nulls, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from test_text_operators import corpus, docs_of

from auditloom.llm import divergence, resampling, sharding


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, between=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    w = re.findall(between, lowered(text))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn(rows, target, percent, min_words):
    """doc_id, n_features, weight, score, rank of each row."""
    place = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, features(text)[1]))
    for text in target:
        t.update(map(place, features(text)[1]))
    n, m = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in range(10_000)]
    out = []
    for i, text in rows:
        words, f = features(text)
        weight = sum(gain[place(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


TARGET = ["Alpha beta GAMMA alpha", "naïve É1 x", None, ""]


@pytest.mark.parametrize(("percent", "accuracy"), [(5, 10_000), (60, 10_000), (100, 10_000), (30, 1), (0, 10_000)])
def test_resample_equals_brute_force(spark, percent, accuracy):
    """Also where the quantile is useless (accuracy 1) and all rows have to be sorted."""
    rows = [*corpus(11), (None, "alpha beta gamma " * 9), (None, "alpha beta gamma " * 9), (7001, None), (7002, ""), (7003, "Ä ß İ Ⅷ x2"), (7004, "alpha " * 3000), (7004, "alpha " * 3000)]
    got = resampling.resample(docs_of(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string"), percent, 3, accuracy=accuracy)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == drawn(rows, TARGET, percent, 3)


def test_resample_carries_text_and_takes_empty_tables(spark):
    docs = docs_of(spark, [(i, f"alpha beta w{i} " * 8) for i in range(20)])
    target = spark.createDataFrame([("alpha beta",)], "text string")
    got = resampling.resample(docs, target, 10, carry=("text",)).collect()
    assert all(r.carry_text == f"alpha beta w{r.doc_id} " * 8 for r in got) and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert resampling.resample(docs.where("false"), target).collect() == []
    assert resampling.resample(docs, target.where("false")).count() == 20


def test_scores_read_no_exploded_rows(spark):
    """Scoring is a projection: no exchange, generator or Python in its plan."""
    rows = resampling.with_buckets(spark.range(3).selectExpr("id AS doc_id", "concat('a b ', id) AS text"))
    plan = resampling.weighed(rows, list(range(10_000)))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" in plan and not re.search("Exchange|Generate|Python|Arrow", plan)


def sources(rows):
    """A third of the rows in one source, one source null, one of a single row."""
    return [(i, t, "hot" if k % 3 == 0 else None if k % 7 == 1 else "one" if k == 5 else f"s{k % 4}") for k, (i, t) in enumerate(rows)]


def sourced(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", -1) for i, t, s in rows], "doc_id long, text string, source string, shard string, place int")


def interleaved(rows, shards):
    key = lambda r: (hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()))
    by = {}
    for r in rows:
        by.setdefault(r[2] or "", []).append(r)
    order = sorted(((k + 0.5) / len(g), s, k, r) for s, g in by.items() for k, r in enumerate(sorted(g, key=key)))
    out, n = [], len(rows)
    for place, (_, s, _, r) in enumerate(order):
        shard = place * shards // n
        out.append((r[0], s, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), shard, place - -(-shard * n // shards)))
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_interleave_equals_brute_force(spark, shards):
    rows = sources([*corpus(12), (None, "same"), (None, "same"), (None, None), (9001, ""), (9002, "é" * 5000), (9002, "é" * 5000)])
    got = sharding.interleave(sourced(spark, rows), shards).collect()
    assert Counter(tuple(r)[:6] for r in got) == interleaved(rows, shards)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({r.row for r in got}) == len(rows)
    for source, held in Counter(s or "" for _, _, s in rows).items():
        in_shard = Counter(r.shard for r in got if r.source == source)
        assert all(abs(in_shard[k] - held / shards) < 2 for k in range(shards))


def test_few_rows_and_none(spark):
    assert sorted((r.shard, r.slot) for r in sharding.interleave(sourced(spark, [(1, "a", "x"), (2, "b", "y")]), 8).collect()) == [(0, 0), (4, 0)]
    assert sharding.interleave(sourced(spark, []), 8).collect() == []
    with pytest.raises(ValueError, match="positive"):
        sharding.interleave(sourced(spark, []), 0)


def test_shards_are_written_in_order(spark, tmp_path):
    rows = sources(corpus(13))
    back = sharding.write_shards(sourced(spark, rows).drop("shard", "place"), str(tmp_path / "shards"), 4, files=6).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in back) == Counter(rows)
    want = interleaved(rows, 4)
    assert Counter((r.doc_id, r.source or "", len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in back) == want
    for k in range(4):
        slots = [r.slot for f in sorted((tmp_path / "shards" / f"shard={k}").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def diverging(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x60\x7B-\x7F]+", lowered(text))) for lang, source, text in rows]
    have, counts = Counter(), {}
    for lang, source, terms in docs:
        have.update((lang, t) for t in set(terms))
        counts.setdefault((lang, source), Counter()).update(terms)
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for (x, t), n in have.items() if x == lang and n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            q = {t: share(total[t], sum(total.values()), len(kept)) for t in kept}
            terms = [(-f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


@pytest.mark.parametrize(("least", "top"), [(1, 10), (3, 2), (10, 10), (1000, 10)])
def test_divergences_equal_brute_force(spark, least, top):
    texts = [t for _, t in corpus(14)]
    rows = [("en" if k % 5 else "de", "hot" if k % 3 == 0 else f"s{k % 4}", t) for k, t in enumerate(texts)]
    rows += [(None, None, "Only é É words"), (None, "x", None), ("fr", "alone", "mot " * 2000), ("fr", "alone", "mot " * 2000), ("en", "none", "123 456"), ("en", "", ""), ("de", "s0", "ß " * 50)]
    docs = spark.createDataFrame([(k, t, lang, s, "clash") for k, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    got = divergence.divergences(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == diverging(rows, least, top)
    assert divergence.divergences(docs.where("false")).collect() == []


def test_shares_are_exact_at_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(10**13, 3 * 10**14, 10**7), (0, 0, 0), (0, 0, 5), (2**40, 2**40, 1)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 2) // max(1, n + 2 * v) for c, n, v in cases]

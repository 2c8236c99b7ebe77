"""The quality rules make little of texts at once, however many rows Spark sends in a batch."""

import collections

import numpy as np
import pyarrow as pa

from auditloom.llm import perplexity


def test_pieces_of_a_batch_are_bounded_and_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK", 100)
    texts = [b"a" * 60, None, b"b" * 40, b"c", b"", b"d" * 1000, b"e" * 99, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.binary())], ["id", "bytes"])
    pieces = list(perplexity.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1, 2], [3, 4], [5], [6, 7], [3, 4]]
    assert [x for p in pieces[:4] for x in p.column(1).to_pylist()] == texts


def test_counts_of_words_and_grams_over_many_pieces(spark):
    words = [f"w{k}" for k in np.random.default_rng(0).zipf(1.3, 300_000) % 50_000]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").coalesce(1)
    counted = perplexity.count_words(docs).agg({"n": "sum", "word": "count"}).first()
    assert (counted["sum(n)"], counted["count(word)"]) == (len(words), len(set(words)))
    want = collections.Counter(f"\0\0\0{t}"[i : i + 4] for t in texts for i in range(len(t)))
    got = {r.gram: r.n for r in perplexity.count_grams(docs).collect()}
    assert got == {int.from_bytes(g.encode(), "big"): n for g, n in want.items()}

"""Packed pieces hold the documents' tokens, shards stay bounded."""

from collections import Counter

from test_text_operators import corpus, docs_of

from auditloom.llm import packing


def test_pieces_hold_all_words(spark):
    rows = [*corpus(6), (None, "a b c"), (None, "a  b\tc"), (None, None)]
    got = packing.pack(docs_of(spark, rows), max_length=7, token_budget=40, shard_rows=30).collect()
    documents = {}
    for r in got:
        documents.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.tokens.split(" ") if r.tokens else []) and r.first_token == 7 * r.piece and r.padding == r.bucket_length - r.length
    for i, t in rows[:-3]:
        pieces = sorted(documents[i], key=lambda r: r.piece)
        assert [w for r in pieces for w in r.tokens.split(" ") if w] == [w.decode() for w in (t or "").encode().split()]
    assert sorted(r.tokens for r in documents[None]) == ["", "a b c", "a b c"]


def test_copies_and_null_ids_spread_over_shards(spark):
    """Rows that are equal in everything fill no shard beyond twice its size."""
    got = packing.pack(docs_of(spark, [(None, "same text")] * 1000 + [(1, "same text")] * 1000), shard_rows=100).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 2000 and len(sizes) == 20 and max(sizes.values()) <= 200


def test_token_ids_and_batches(spark):
    rows = [(i, list(range(i))) for i in range(40)] + [(100, None), (None, [5, 6]), (None, [5, 6])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    packed = packing.pack(docs, buckets=3, max_length=16, token_budget=64, token_column="ids")
    got = packed.collect()
    back = {}
    for r in sorted(got, key=lambda r: r.piece):
        if r.doc_id is not None:
            back[r.doc_id] = back.get(r.doc_id, []) + r.tokens
    assert back == {i: t or [] for i, t in rows if i is not None} and sum(r.doc_id is None for r in got) == 2
    whole = packing.batches(packed).collect()
    assert Counter(p.doc_id for b in whole for p in b.pieces) == Counter(r.doc_id for r in got)
    assert all(len(b.pieces) * b.bucket_length <= 64 and [p.length for p in b.pieces] == sorted(p.length for p in b.pieces) for b in whole)
    assert packing.pack(docs.where("false"), token_column="ids").count() == 0

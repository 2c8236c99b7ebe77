"""Cases that the registered queries and the pipeline define: empty and very long texts, null arrays, clashing extra columns."""

from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from test_pipeline import SCHEMA, fixture

from auditloom.llm import packing
from auditloom.llm.queries import ORACLES, QUERIES


def test_chat_query_with_empty_and_very_long_texts(spark, tmp_path):
    long = "<|im_end|>&amp;\n" * 20_000
    rows = [(1, 0, "user", ""), (1, 1, "assistant", long), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "é🙂"), (4, 0, "system", "x"), (4, 1, "user", long)]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = c.execute(ORACLES["op3_chat_format"])
    names = [d[0] for d in found.description]
    got = QUERIES["op3_chat_format"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(found.fetchall())
    assert {r.conv_id: r.loss_chars for r in got} == {-1: 34, 1: len(long), 2: 0, 3: 2, 4: 0}


def test_null_arrays_among_others_at_several_shards(spark):
    rows = [(i % 50 if i % 7 else None, list(range(i % 40)) if i % 3 else None) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, ids array<int>"), buckets=4, max_length=16, token_budget=64, shard_rows=50, token_column="ids").collect()
    assert Counter(len(t or []) for _, t in rows if len(t or []) <= 16) == Counter(r.length for r in got if r.piece == 0 and r.length < 16 or r.length == 16 and r.piece == 0) - Counter({16: sum(len(t or []) > 16 for _, t in rows)})
    assert sum(r.length == 0 for r in got) == sum(not t for _, t in rows) and len({r.shard for r in got if r.length == 0}) > 3
    assert all(r.tokens == [] for r in got if r.length == 0)


def test_stages_ignore_columns_with_their_own_names(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in fixture()[:60] + fixture()[140:190]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    clash = ["id", "key_id", "key_text", "digest", "content", "bytes", "kept", "marks", "row", "size", "piece", "tokens", "shard", "length"]
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, docs.withColumns({c: F.lit("clash") for c in clash}), str(tmp_path))
        plain = stage(spark, docs, str(tmp_path))
        assert odd.columns == plain.columns, name
        told = [c for c in plain.columns if c in ("doc_id", "text", "lang", "piece", "length", "tokens")]
        assert Counter(map(tuple, odd.select(told).collect())) == Counter(map(tuple, plain.select(told).collect())), name

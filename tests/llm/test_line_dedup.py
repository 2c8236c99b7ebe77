"""Hot lines, null ids, full filters, and the plan of line dedup."""

import pytest
from test_text_operators import corpus, docs_of, line_model

from auditloom.llm import line_dedup


@pytest.mark.parametrize(("least", "bits"), [(100, 1 << 27), (0, 1 << 27), (3, 64), (10**9, 1)])
def test_common_lines_and_full_filters(spark, monkeypatch, least, bits):
    """A line that a third of all documents share, decided by broadcast or by the ranges."""
    monkeypatch.setattr(line_dedup, "HOT_LEAST", least)
    rows = [*corpus(8), *((300 + i, f"a line that many share\nown line of {i}\n\tA Line That Many SHARE ") for i in range(60))]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs_of(spark, rows), filter_bits=bits).collect()}
    assert got == line_model(rows)


@pytest.mark.parametrize("least", [0, 100])
def test_least_id_is_no_null(spark, monkeypatch, least):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", least)
    low = -(1 << 63)
    rows = [(low, "0123456789"), (None, "0123456789\nx"), (3, "0123456789\nabcdefghij"), (low, "abcdefghij")]
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_lines, r.n_dropped, r.text) for r in got) == [((False, 0), 2, 0, "0123456789\nx"), ((True, low), 1, 0, "abcdefghij"), ((True, low), 1, 1, ""), ((True, 3), 2, 2, "")]


def test_lines_are_dealt_by_ranges_once(spark, capsys):
    line_dedup.line_bitmaps(docs_of(spark, corpus(8))).explain("formatted")
    plan = capsys.readouterr().out
    assert "rangepartitioning(h1" in plan and "hashpartitioning(h1" not in plan and "Python" not in plan

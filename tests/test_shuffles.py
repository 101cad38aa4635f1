"""Rows that are shuffled once where they were shuffled several times, with the results they had."""

import re

import pytest

from panelgrid.functions import distribution
from panelgrid.operators import retrieval, stability
from panelgrid.session import small_frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1 << 16, 5])
def test_positions_of_rows(spark, monkeypatch, size):
    monkeypatch.setattr(distribution, "RANGE_VALUES", size)
    values = [(k, v) for k in ("a", "b", None) for v in (*range(40), 3, 3, 39, None)] + [("c", None), ("d", 1)]
    df = small_frame(spark, values, "k string, v int")
    want = distribution.value_positions(df, ["k"], "v").select("k", "v", "before")
    got = distribution.row_positions(df, ["k"], "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 121


def test_a_ranking_shuffles_its_rows_once(spark):
    rows = small_frame(spark, [("q", i, float(i % 7)) for i in range(50)] + [("q", None, 3.0), ("q", 50, None)], "query_id string, entity int, D double")
    ranked = stability.full_ranking(rows, ["query_id"])
    by = re.findall(r"hashpartitioning\(([^)]*)\), ENSURE|hashpartitioning\((.*?), \d+\)", plan(ranked))
    assert sum("_range" in "".join(x) and "_in" not in "".join(x) for x in by) <= 2 and not [x for x in by if "_v" in "".join(x) and "_range" in "".join(x)]
    assert "cnt" not in plan(ranked)
    want = sorted([(-float(i % 7), i) for i in range(50)] + [(-3.0, None)], key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    assert [r["entity"] for r in ranked.orderBy("position").collect()] == [e for _, e in want]
    assert [r["position"] for r in ranked.orderBy("position").collect()] == list(range(1, 52))


def test_postings_stay_where_they_lie(spark, monkeypatch):
    docs = [(i, f"all w{i % 50} x{i} w{i % 50}") for i in range(300)]
    index = retrieval.build_index(small_frame(spark, docs, "doc_id bigint, text string"))
    queries = [(i, f"all w{i} x{i + 50}") for i in range(20)]
    weights = retrieval.weights_of(small_frame(spark, queries, "item_id bigint, text string"), index, "item_id", "text")
    kept = retrieval.promising(index.blocks, weights, small_frame(spark, [(0, 1.0)], "q bigint, bound double"))
    assert not re.search(r"hashpartitioning\(term#\d+, level", plan(retrieval.candidates(kept, index.postings)).split("BroadcastExchange")[0])
    found = lambda: sorted(map(str, retrieval.search(small_frame(spark, queries, "item_id bigint, text string"), index, 3).collect()))
    one = found()
    monkeypatch.setattr(retrieval, "TERMS", 7)
    assert found() == one and len(one) == 60


def test_rows_of_a_document_add_up(spark):
    index = retrieval.build_index(small_frame(spark, [(1, "a a b"), (1, "a c c"), (2, "a"), (3, ""), (None, "b"), (4, None)], "doc_id bigint, text string"))
    got = {(r["doc"], r["term"]): r["gain"] for r in index.postings.collect()}
    average = (3 + 3 + 1 + 0 + 1) / 5
    gain = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))
    want = {(1, "a"): gain(3, 3), (1, "b"): gain(1, 3), (1, "c"): gain(2, 3), (2, "a"): gain(1, 1), (None, "b"): gain(1, 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

"""Recall and exact scores against brute force, hot vectors, and odd rows."""

import numpy as np
import pytest

from panelgrid.llm import nearest

SF = "/root/testdata/sf0.1"


def brute(ids, x, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = [j for j in np.lexsort((ids, -np.round(unit @ unit[i], 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def result(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("block", [4096, 37])
def test_recall(spark, block, monkeypatch):
    monkeypatch.setattr(nearest, "LIST_BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64))
    got = result(nearest.nearest_of_corpus(vectors))
    assert got.keys() == want.keys() and all([x[0] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
    hits = [len({x[1] for x in got[q]} & {x[0] for x in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.93
    exact = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-14 for q, v in got.items() for _, i, s in v if i in exact[q])


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(300)] + [(i, [2.0, 4.0, 4.0]) for i in range(300, 310)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(90)]
    got = result(nearest.nearest_of_corpus(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [x[1] for x in got[0]] == [1, 2, 3, 4, 5] and [x[1] for x in got[50]] == [0, 1, 2, 3, 4] and all(abs(x[2] - 1) < 1e-15 for x in got[250])
    assert [x[1] for x in got[300]] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, None, 3), (3, [], 3), (4, [0.0, -0.0], 3), (5, [nan, 1.0], 3), (6, [inf, 1.0], 3), (7, [None, 1.0], 3), (None, [1.0, 1.0], 3), (8, [1.0, 2.0, 3.0], 3), (9, [-1e300, 1e300], 3), (50, [0.0, 0.0], 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = result(nearest.nearest_of_corpus(vectors))
    assert {q: [x[1] for x in v] for q, v in got.items()} == {0: [1, 9]}
    assert abs(got[0][1][2] + np.sqrt(0.5)) < 1e-12
    assert nearest.nearest_of_corpus(vectors.limit(0)).count() == 0
    alone = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest_of_corpus(alone).count() == 0

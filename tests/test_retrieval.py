"""Search in blocks of impact against scoring every document, also with a word that all documents hold."""

import math
import random
from collections import Counter

import pytest

from panelgrid.operators import retrieval
from panelgrid.session import small_frame

VOCABULARY = [f"w{i}" for i in range(60)]


def brute(queries, docs, k):
    split = {d: t.lower().split() for d, t in docs}
    counts = {d: Counter(s) for d, s in split.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor, mean = 0.25 * sum(idf.values()) / len(idf), sum(map(len, split.values())) / len(docs)
    out = {}
    for q, text in queries:
        scores = []
        for d, c in counts.items():
            score = sum((idf[t] if idf[t] >= 0 else floor) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(split[d]) / mean)) for t in text.split() if t in c)
            if round(score, 6) > 0:
                scores.append((-round(score, 6), d))
        out[q] = sorted(scores)[:k]
    return {q: [(d, -s) for s, d in v] for q, v in out.items() if v}


def corpus(seed, n):
    pick = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, "all " * pick.randint(1, 4) + " ".join(pick.choices(VOCABULARY, weights, k=pick.randint(1, 40)))) for i in range(n)]
    return docs + [(n + i, docs[i][1]) for i in range(20)] + [(n + 20, "")]


@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_search_equals_scoring_every_document(spark, size):
    docs = corpus(1, 400)
    pick = random.Random(2)
    queries = [(i, " ".join(["all"] * (i % 2) + pick.choices(VOCABULARY, k=1 + i % 7))) for i in range(40)] + [(90, "all"), (91, "unknown words"), (92, "all all w59 w59 w0")]
    index = retrieval.build_index(small_frame(spark, docs, "doc_id bigint, text string"))
    got = {}
    for r in retrieval.search(small_frame(spark, queries, "item_id bigint, text string"), index, 5, size=size).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    want = brute(queries, docs, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[q], want[q])), q


def test_a_common_word_makes_no_pairs(spark):
    """Documents that share only the word of all documents with a query are no candidates."""
    docs = [(i, f"all w{i % 50} x{i}") for i in range(1000)]
    index = retrieval.build_index(small_frame(spark, docs, "doc_id bigint, text string"))
    weights = retrieval.weights_of(small_frame(spark, [(0, "all w7 x7")], "item_id bigint, text string"), index, "item_id", "text")
    bounds = small_frame(spark, [(0, 5.0)], "q bigint, bound double")
    kept = retrieval.promising(index.blocks, weights, bounds)
    assert {r["term"] for r in kept.collect()} == {"w7", "x7"}
    assert retrieval.candidates(kept, index.postings).count() == 20


def test_postings_lie_by_term_and_impact(spark):
    index = retrieval.build_index(small_frame(spark, corpus(3, 200), "doc_id bigint, text string"))
    assert {r["part"] for r in index.postings.select("part").distinct().collect()} <= set(range(retrieval.PARTS))
    assert index.blocks.agg({"n": "sum"}).first()[0] == index.postings.count()
    plan = retrieval.search(small_frame(spark, [(0, "w3 w4")], "item_id bigint, text string"), index, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan

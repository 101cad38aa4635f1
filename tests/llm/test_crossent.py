"""Scores against a plain computation, and whether they tell good documents from bad ones."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelgrid.llm import crossent
from panelgrid.llm.crossent import Cells, score_corpus

SF = "/root/testdata/sf0.01"


def plain(rows, targets):
    """rows: (key, doc_id, text). Counts of all other documents, cell by cell."""
    cells = Cells()
    seqs = []
    for _, doc, text in rows:
        word = [cells[w] for w in (text or "").encode().lower().split()]
        before = [0, *word][: len(word)]
        pair = crossent.pairs(np.array(before, np.int64), np.array(word, np.int64)).tolist()
        seqs.append((doc in targets, word, before, pair))

    def totals(pick):
        out = [Counter(), Counter(), Counter()]
        for chosen, *kinds in seqs:
            if pick(chosen):
                for c, k in zip(out, kinds):
                    c.update(k)
        return out

    models = totals(lambda c: c), totals(lambda c: True)
    vocabulary = len(models[1][0])
    out = {}
    for (key, _, _), (chosen, word, before, pair) in zip(rows, seqs):
        losses = []
        for i, (w1, b1, p2) in enumerate(models):
            own = [Counter(), Counter(), Counter()]
            if i == 1 or chosen:
                own = [Counter(word), Counter(before), Counter(pair)]
            n = sum(w1.values()) - sum(own[0].values())
            loss = 0.0
            for w, b, p in zip(word, before, pair):
                single = (w1[w] - own[0][w] + 1) / (n + vocabulary)
                loss -= math.log((p2[p] - own[2][p] + crossent.PRIOR * single) / (b1[b] - own[1][b] + crossent.PRIOR))
            losses.append(loss / len(word) if word else None)
        out[key] = len(word), *losses
    return out


def test_scores_equal_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    targets = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    want = plain([(r.doc_id, r.doc_id, r.text) for r in docs.collect()], targets)
    got = {r.doc_id: r for r in score_corpus(docs, labels).collect()}
    assert got.keys() == want.keys()
    for doc, (n, target, background) in want.items():
        assert got[doc].n_tokens == n and math.isclose(got[doc].target_loss, target, rel_tol=1e-9) and math.isclose(got[doc].background_loss, background, rel_tol=1e-9)
        assert math.isclose(got[doc].score, target - background, abs_tol=1e-9)


def test_good_documents_are_closer_to_the_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_corpus(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("score is not null").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = np.mean([[g < b for b in bad] for g in good])
    assert len(bad) > 50 and wins > 0.6


def test_odd_rows(spark):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (2, None, "x"), (3, " \n", "x"), (None, "a b c", None), (4, "w " * 60000 + "x" * 100000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("is_target", F.lit("k"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_corpus(docs, labels).collect()
    want = plain([(i, d, t) for i, (d, t, _) in enumerate(rows)], {1})
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 2), (1, 2), (2, 0), (3, 0), (4, 60001)]
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert all(math.isclose(r.target_loss, want[0][1], rel_tol=1e-9) for r in got if r.doc_id == 1)
    assert score_corpus(docs.limit(0), labels).count() == 0
    assert score_corpus(docs, labels.limit(0)).where("score is not null").count() == 4


def test_no_word_or_pair_shares_a_count(spark, monkeypatch):
    """Against counts of the words and pairs themselves; more distinct ones than 2^16 and 2^17, over many blocks."""
    monkeypatch.setattr(crossent, "BLOCK_BYTES", 100_000)
    texts = [" ".join(f"w{(i * 7919 + j * j * 31) % 90000}" for j in range(300)) + f" the end{i} the cat" for i in range(500)]
    rows, targets = list(enumerate(texts)), set(range(0, 500, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in targets], "doc_id long, quality int, toxic int")
    models = []
    for chosen in (targets, range(500)):
        words, before, pairs = Counter(), Counter(), Counter()
        for i in chosen:
            w = texts[i].split()
            words.update(w), before.update(["", *w[:-1]]), pairs.update(zip(["", *w[:-1]], w))
        models.append((words, before, pairs))
    vocabulary = len(models[1][0])
    assert vocabulary > 1 << 16 and len(models[1][2]) > 1 << 17
    got = {r.doc_id: r for r in score_corpus(docs, labels).collect()}
    for i in range(0, 500, 7):
        w = texts[i].split()
        b = ["", *w[:-1]]
        for (words, before, pairs), inside, loss in zip(models, (i in targets, True), (got[i].target_loss, got[i].background_loss)):
            own = [Counter(x) if inside else Counter() for x in (w, b, zip(b, w))]
            n, want = words.total() - own[0].total(), 0.0
            for x, y in zip(w, b):
                single = (words[x] - own[0][x] + 1) / (n + vocabulary)
                want -= math.log((pairs[y, x] - own[2][y, x] + crossent.PRIOR * single) / (before[y] - own[1][y] + crossent.PRIOR))
            assert math.isclose(loss, want / len(w), rel_tol=1e-9)

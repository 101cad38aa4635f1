"""Budgets and prefixes against plain recursive filling and sorting."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelgrid.llm.mixing import Level, corpus_levels, keep_mixture, leaf_budgets, mix, mixture, order_hash

SF = "/root/testdata/sf0.01"


def fill(budget, nodes):
    """nodes: name -> (supply, weight). Repeatedly fill up whoever can't take its share."""
    out, left = {}, dict(nodes)
    while left:
        total = sum(w for _, w in left.values())
        short = [n for n, (s, w) in left.items() if s <= budget * w / total + 1e-9]
        if not short:
            return out | {n: budget * w / total for n, (_, w) in left.items()}
        for n in short:
            out[n] = left[n][0]
        budget -= sum(left.pop(n)[0] for n in short)
    return out


def plain_budgets(leaves, weight, fraction, epochs):
    """leaves: (a, b, c) -> tokens"""
    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        supply = defaultdict(float)
        for path, tokens in leaves.items():
            if path[:depth] == prefix and tokens > 0 and all(weight(i, v) > 0 for i, v in enumerate(path)):
                supply[path[depth]] += tokens * epochs
        out = {}
        for name, share in fill(min(budget, sum(supply.values())), {n: (s, weight(depth, n)) for n, s in supply.items()}).items():
            out |= down((*prefix, name), share)
        return out

    return down((), fraction * sum(t for p, t in leaves.items() if t > 0 and all(weight(i, v) > 0 for i, v in enumerate(p))))


@pytest.mark.parametrize("fraction,epochs", [(0.3, 1), (0.9, 1), (1.4, 2), (5.0, 3)])
def test_budgets(spark, fraction, epochs):
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 900, ("a", "y", "3"): 40, ("b", "x", "4"): 3000, ("b", None, "5"): 10, ("c", "y", "6"): 70, ("c", "y", None): 70, ("z", "y", "7"): 500, ("b", "y", "8"): 0}
    tables = [{"a": 3, "b": 1, "z": 0}, {"x": 2}, {}]
    levels = [Level(n, F.col(n), t) for n, t in zip(("l1", "l2", "l3"), tables)]
    frame = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "l1 string, l2 string, l3 string, tokens long")
    got = {(r.l1, r.l2, r.l3): r.budget for r in leaf_budgets(frame, levels, fraction, epochs).collect()}
    want = plain_budgets(leaves, lambda i, v: tables[i].get(v, 1), fraction, epochs)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1 for p in want)


def test_prefixes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    levels = corpus_levels(docs)
    seed, rows = 17, {}
    hashed = docs.select("doc_id", *(x.value.alias(x.name) for x in levels), "text", *(order_hash(seed, F.lit(e), F.xxhash64("doc_id", "text")).alias(f"h{e}") for e in range(3)))
    leaves = defaultdict(list)
    for r in hashed.collect():
        leaves[r.domain, r.language, r.origin].append((r, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    tables = [x.weights for x in levels]
    budgets = plain_budgets({p: sum(n for _, n in v) for p, v in leaves.items()}, lambda i, v: tables[i].get(v, levels[i].other), 0.6, 2)
    want = {}
    for path, budget in budgets.items():
        budget, total = round(budget), sum(n for _, n in leaves[path])
        whole, rest = divmod(budget, total)
        for e in range(whole):
            want |= {(r.doc_id, e): n for r, n in leaves[path]}
        for r, n in sorted(leaves[path], key=lambda x: x[0][f"h{whole}"] % 2**64):
            if n and rest > 0:
                want[r.doc_id, whole] = min(n, rest)
                rest -= n
    for r in mixture(docs).collect():
        rows[r.doc_id, r.epoch] = r.take_tokens
    assert any(e for _, e in want) and rows.keys() == want.keys()
    assert all(abs(rows[k] - want[k]) <= 1 for k in want)
    total = sum(n for v in leaves.values() for _, n in v)
    assert abs(sum(rows.values()) - 0.6 * total) < 100


def test_odd_rows(spark):
    rows = [(1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (2, None, None, None, 2), (3, "", "de", None, 3), (None, "x y", None, "s", 4), (5, "w " * 50000, "fr", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int").withColumn("epoch", F.lit("e")).withColumn("place", F.lit(0))
    got = mix(docs, corpus_levels(docs), fraction=10.0, epochs=2)
    assert got.count() == 8 and keep_mixture(docs).columns == docs.columns
    assert got.where("row.epoch = 'e' and epoch < 2").count() == 8
    assert mixture(docs.limit(0)).count() == 0
    none = [Level("n", docs["lang"], {"en": 0}, 0)]
    assert mix(docs, none).count() == 0

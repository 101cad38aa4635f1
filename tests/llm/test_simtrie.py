"""Links and components against brute force, with small units so that tries are split."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelgrid.llm.simtrie import fingerprint, keep_one, near_duplicates

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint)"""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def test_fingerprint_equals_definition():
    for text in (None, "", " \n", "One", "one TWO", "a b c", "É É é x\x0by\x1cz", "the cat " * 400, "x" * 10000):
        assert fingerprint(text) == plain_fingerprint(text)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_components(rows)
    assert len(got) == len(rows) and len(set(want.values())) < len(rows)
    for doc, mark in rows:
        assert got[doc].fingerprint == f"{mark:016x}" and got[doc].component_id == want[doc]


@pytest.mark.parametrize("unit", [3, 40, 4096])
def test_planted_fingerprints(spark, unit, monkeypatch):
    rng = random.Random(unit)
    marks = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            mark = base
            for _ in range(rng.randint(0, 4)):
                mark ^= 1 << rng.randrange(64)
            marks.append(mark)
    marks += [0, 1, 3, 7, 1 << 63, (1 << 64) - 1, marks[0]]
    rows = list(enumerate(marks))
    frame = spark.createDataFrame([(i, int(np.uint64(m).astype(np.int64))) for i, m in rows], "doc_id long, fp long")
    import panelgrid.llm.simtrie as module

    monkeypatch.setattr(module, "fingerprints", lambda docs: docs)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, unit).collect()}
    assert got == plain_components(rows)


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (3, "", "x", 2), (3, "", "x", 2), (9, "a b c d", None, 3), (8, "A b\tc d", None, 3), (None, "q r s t u", None, 4), (2, "w" * 200000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, u int")
    got = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(0, None), (2, 2), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    kept = sorted((r.doc_id or 0) for r in keep_one(docs).collect())
    assert kept == [0, 2, 3, 8] and keep_one(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard_groups(rows):
    """rows: (doc_id, text). Least id of what pairs of Jaccard 0.8 or more connect, all pairs compared."""
    sets, parent = [five_word_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def test_keep_one_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(20):  # edited copies on both sides of the threshold
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(200)] = f"x{rng.random()}"
            rows.append((10**7 + 10 * k + c, " ".join(copy)))
    want = jaccard_groups(rows)
    got = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keep_one_joins_what_two_bits_do_not(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = [*words[:99], "end"], [*words[:50], "a", *words[51:70], "b", *words[71:90], "c", *words[91:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:90])), (4, " ".join(far)), (5, " ".join(words[50:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in keep_one(docs).collect()} == jaccard_groups(rows) == {1, 4, 5}
    assert len({r.component_id for r in near_duplicates(docs).collect()}) > 3


def test_keep_one_of_repeated_and_missing_ids(spark):
    copied, clean, other = ("one two three four five six", "quite another text of eight words in all", "a third one that nothing else is like")
    rows = [(1, copied, 1), (2, copied, 2), (2, clean, 3), (2, clean, 3), (None, other, 4), (None, other, 5), (None, copied, 6), (7, clean, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, u int")
    want = [(None, other), (1, copied), (2, clean)]
    for part in (docs, docs.orderBy(F.desc("u")).repartition(3)):
        got = keep_one(part).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=lambda x: x[0] or 0) == want
        assert len({r.u for r in got}) == 3
    assert sorted(r.u for r in keep_one(docs).collect()) == sorted(r.u for r in keep_one(docs.repartition(5)).collect())


@pytest.mark.parametrize("first,block,keys", [(6, 1024, 1 << 20), (1, 50, 10)])
def test_one_large_group_of_near_copies(spark, monkeypatch, first, block, keys):
    """All of a text's copies share buckets; no link is lost in them, however few neighbours were compared first."""
    import panelgrid.llm.simtrie as module

    for name, value in (("FIRST", first), ("BLOCK", block), ("FEW_KEYS", keys)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(700):
        copy = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 6, 9])):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    got = [r.doc_id for r in keep_one(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_groups(rows) and 1 < len(got) < 700


def test_pairs_of_a_group_at_the_threshold_do_not_become_rows(spark, monkeypatch):
    """Copies that are all about as far apart as the threshold: candidates grow with the rows, and the few links among them are found."""
    import panelgrid.llm.simtrie as module

    sizes = {}

    def counted(df, name="stage"):
        out = stage(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    stage = module.stage
    monkeypatch.setattr(module, "stage", counted)
    monkeypatch.setattr(module, "BLOCK", 100)
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(300):
        copy = list(words)
        for at in rng.sample(range(200), 4 if i < 290 else 2):
            copy[at] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    want = jaccard_groups(rows)
    got = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 100 < len(want) < 290
    assert sizes["candidates"][1] <= 2 * sizes["members"][0]


def test_keep_one_joins_fingerprints_by_tries(spark, monkeypatch):
    """The stage's candidates come from the self-join of tries too, not from shared bands alone."""
    import panelgrid.llm.simtrie as module

    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(module, "neighbours", lambda nodes: none)
    monkeypatch.setattr(module, "across_roots", lambda nodes, block: none)
    words = [f"w{i}" for i in range(61)]
    rows = [(1, " ".join(words * 40)), (2, " ".join(words * 41)), (3, " ".join([*words * 40, "end"])), (4, "five other words stand here")]
    assert jaccard_groups(rows) == {1, 4}
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 4]


def test_workers_let_go_of_other_stages(monkeypatch):
    from panelgrid.llm import langtags, pieces
    from panelgrid.llm.simtrie import let_go

    monkeypatch.setattr(langtags, "_MEMOS", {"a": 1})
    monkeypatch.setattr(pieces, "_ENCODERS", {1: 2})
    let_go()
    assert not langtags._MEMOS and not pieces._ENCODERS and "let_go()" in __import__("inspect").getsource(langtags.tag_documents)

"""Sorted pointers against plain string sorting, and the audit against counting in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelgrid.llm import termaudit
from panelgrid.llm.termaudit import audit, pointers, slice_counts, sort_pointers

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def texts(seed, n):
    pick = random.Random(seed)
    stock = ["The", "the", "naïve", "Straße", "ÄB", "x", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "日本語", "a" * 50, "a" * 51]
    return ["".join(pick.choice(stock) + pick.choice([" ", ", ", "1", "\n", "", "-"]) for _ in range(pick.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("small", [1 << 15, 3])
def test_pointers_in_order(monkeypatch, small):
    monkeypatch.setattr(termaudit, "SMALL", small)
    all_texts = ["", "A", "", *texts(3, 60), "end", "Z" * 3000, ""]
    data = [t.encode() for t in all_texts]
    offsets = np.cumsum([0, *map(len, data)])
    buffer = termaudit.LOWER[np.frombuffer(b"".join(data), np.uint8)]
    start, length, document = pointers(buffer, offsets)
    words = [bytes(buffer[s : s + n]).decode() for s, n in zip(start, length)]
    assert words == [w for t in all_texts for w in terms_of(t)]
    assert document.tolist() == [i for i, t in enumerate(all_texts) for _ in terms_of(t)]
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    order, run = sort_pointers(np.ndarray(len(buffer), ">u8", padded, strides=(1,)), start, length)
    ordered = [words[i].encode() for i in order]
    assert ordered == sorted(w.encode() for w in words)
    assert run.tolist() == [sorted({w.encode() for w in words}).index(w) for w in ordered]


def test_slice_counts():
    all_texts, group = texts(4, 40), np.array([i % 3 for i in range(40)])
    data = [t.encode() for t in all_texts]
    term, of, n, docs = slice_counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), group)
    count, held = Counter(), defaultdict(set)
    for i, t in enumerate(all_texts):
        for w in terms_of(t):
            count[w, i % 3] += 1
            held[w, i % 3].add(i)
    keys = list(zip(term.to_pylist(), of.tolist()))
    assert len(keys) == len(set(keys))
    assert dict(zip(keys, n.tolist())) == dict(count) and dict(zip(keys, docs.tolist())) == {k: len(v) for k, v in held.items()}


def brute(rows, least, top):
    count, held, groups = defaultdict(Counter), defaultdict(set), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in terms_of(text):
            count[lang, source][w] += 1
            held[lang, w].add(i)
    out = set()
    for lang, source in groups:
        kept = [w for (x, w), d in held.items() if x == lang and len(d) >= least]
        others = [s for x, s in groups if x == lang]

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: shares(count[lang, s]) for s in others}
        q = shares(sum((count[lang, s] for s in others), Counter()))
        pairs = [(sum(abs(p[source][w] - p[s][w]) for w in kept), s) for s in others if s != source]
        terms = [(p[source][w] - q[w], w) for w in kept if count[lang, source][w] and p[source][w] > q[w]]
        for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def corpus(seed, n, sources):
    pick = random.Random(seed)
    return [(i, t, pick.choice(["en", "en", "fr", None]), f"s{pick.randrange(sources)}" if pick.random() < 0.6 else "hot") for i, t in enumerate(texts(seed, n))]


@pytest.mark.parametrize("terms,tile,size", [(2048, 256, 4 << 20), (2, 3, 200)])
def test_audit_equals_counting(spark, monkeypatch, terms, tile, size):
    for name, value in (("TERMS", terms), ("TILE", tile), ("SLICE_BYTES", size)):
        monkeypatch.setattr(termaudit, name, value)
    rows = [*corpus(7, 300, 12), (900, "only in one lang", "xx", "s1"), (901, None, "xx", "s2"), (902, "", "yy", None), (903, None, "en", "without"), (903, None, "en", "without")]
    rows += [(i, "the x " * 2000, "en", "hot") for i in range(5)]
    frame = spark.createDataFrame([(*r, "t", 3) for r in rows], f"{SCHEMA}, term string, n int").repartition(5)
    got = [tuple(r) for r in audit(frame, 3, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 4)
    assert any(r[2] == "term" for r in got) and ("xx", "s1", "pair", "s2", 0, 1) in got


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)
    assert audit(alone, 1).count() == 0

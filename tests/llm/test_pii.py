"""Base spans against the plain patterns, the network's slopes against differences, held-out agreement, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelgrid.llm import pii

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_plain_patterns():
    rng = random.Random(4)
    for alphabet in ("a1@.-+ ", "0123456789 -", "0123456789.", "+1 ().-5x", "ab.@@c", "é1@b.c "):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_time_in_proportion():
    assert pii.base_spans("a" * 300000 + " 1" * 100) == []
    assert pii.base_spans("a" * 300000 + "@b.c") == [(0, 0, 300004)]
    pii.base_spans("1" * 300000 + "." + "+" * 100000 + "1." * 50000)


def test_slopes_equal_differences():
    net = pii.Network(4, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), np.zeros((3, 7), np.int64)
    y[0, 2:5], y[0, 2], y[1, 0] = 2, 1, 3

    def loss():
        scores = net.scores(x).astype(np.float64)
        total = 0.0
        for s, tags in zip(scores, y):
            path = net.start[tags[0]] + s[np.arange(7), tags].sum() + net.step[tags[:-1], tags[1:]].sum()
            alpha = net.start + s[0]
            for row in s[1:]:
                alpha = np.logaddexp.reduce(alpha[:, None] + net.step, 0) + row
            total += np.logaddexp.reduce(alpha) - path
        return total / len(x)

    _, slope = net.gradient(x, y)
    for name, at in (("out", (3, 2)), ("fx", (1, 7)), ("fh", (2, 11)), ("bh", (0, 3)), ("bb", (6,)), ("bias", (1,)), ("step", (0, 1)), ("start", (3,)), ("embed", (int(x[0, 3]), 1))):
        value = net.p[name][at]
        net.p[name][at] = value + 1e-3
        up = loss()
        net.p[name][at] = value - 1e-3
        down = loss()
        net.p[name][at] = value
        assert abs((up - down) / 2e-3 - slope[name][at]) < 2e-3 * max(1, abs(slope[name][at])), name


def test_best_paths_equal_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    lengths = np.array([2, 4, 1])
    scores, start, step = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, at = pii.best_paths(scores, lengths, start, step), 0
    for n in lengths:
        value = lambda p: start[p[0]] + sum(scores[at + i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


@pytest.fixture(scope="module")
def net(spark):
    return pii.train(pii.labelled_regions(spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id % 3 != 0")))


def test_held_out_agreement(spark, net):
    texts = [r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").where("doc_id % 3 = 0").collect()]
    hit = extra = missed = 0
    for text in texts:
        base = set(pii.base_spans(text))
        parts = pii.regions(text)
        spans = pii.network_spans(net, [text[a:b] for a, b in parts])
        got = {(k, a + low, b + low) for (low, _), found in zip(parts, spans) for k, a, b, trust in found if pii.accepted(k, text[a + low : b + low], trust)}
        hit, extra = hit + len(base & got), extra + len(got - base)
        missed += sum(k != 2 for k, _, _ in base - got)  # half of the card-like numbers are none, so the network doubts cards
    assert hit > 150 and missed <= 0.05 * hit and extra <= 0.05 * hit


def test_added_spans_and_masking(net):
    text = "the of and (517) 555-0938 that +1 (269) 555-3296 4524132264652876 is"
    (base, every), = pii.find_spans(net, [text])
    assert set(base) <= set(every) and (3, 11, 25) in every
    assert "555" not in pii.masked(text, every).split("that")[0]


def test_query_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for doc in docs.collect():
        base = plain_spans(doc.text)
        got = rows[doc.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert got.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= {*got.spans.split(","), ""}
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "9" * 5000, None), (3, "a@b.co", "y"), (3, "a@b.co", "y")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_card) for r in pii.personal_data(odd).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)]
    assert pii.personal_data(odd.limit(0)).count() == 0
    clean = pii.redact(odd, pii.train([]))
    assert clean.columns == odd.columns and sorted(r.text or "" for r in clean.collect())[-2:] == ["<email>", "<email>"]

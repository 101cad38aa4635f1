"""Posteriors against enumeration, held-out accuracy, switches within a line, and odd rows."""

import gc
import itertools
import weakref
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.llm import pieces, simtrie
from panelgrid.llm.langtags import Memo, fit, fit_sample, forward_backward, identify, measured_texts, tag_texts
from panelgrid.llm.queries import piece_model

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 2])
    scores = rng.normal(size=(lengths.sum(), 3))
    start, step = rng.normal(size=3), rng.normal(size=(3, 3))
    posterior, expected, starts = forward_backward(scores, lengths, start, step)
    want, pairs, first = np.zeros_like(scores), np.zeros((3, 3)), np.zeros(3)
    at = 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = np.array([np.exp(start[p[0]] + sum(scores[at + i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            first[p[0]] += w
            for i, s in enumerate(p):
                want[at + i, s] += w
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w
        at += n
    assert np.allclose(posterior, want) and np.allclose(expected, pairs) and np.allclose(starts, first)


@pytest.fixture(scope="module")
def tagged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return {r.doc_id: r for r in identify(docs).collect()}, docs.select("doc_id", "lang").collect()


def test_held_out_accuracy(tagged):
    got, rows = tagged
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(got) == len(rows) and len(held) > 150
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_switch_within_a_line():
    tagger = fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)
    memo = Memo(tagger)
    names, scores, certain = tag_texts(memo, ["the dog and the cat the dog le chat et le chien", "the cat"])
    assert names == ["en", "en"] and 0.4 < scores[0] < 0.8 < scores[1] and min(certain) > 0.8


UNLEARNED = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
}


def letter_salad() -> str:
    rng = random.Random(5)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60))


def test_evidence_against_unlearned_languages(spark):
    """Texts of other languages and letter salad fall far below what any held-out text has; copies of a text add up."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    memo = Memo(fit(fit_sample(docs, F.col("lang"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)))
    held = [r.text for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).select("text").collect()]
    assert len(held) > 150 and min(measured_texts(memo, held)[3]) > -10
    for text in (*UNLEARNED.values(), letter_salad()):
        once, twice, none = measured_texts(memo, [text, f"{text}\n{text}", None])[3]
        assert once < -30 and abs(twice - 2 * once) < 0.2 * abs(once) and none == 0


def test_evidence_equals_a_plain_count():
    lines = [("aba ab", "x"), ("bcb", "y")]
    memo = Memo(fit(lines))
    share = np.array([3, 4, 1]) / 8  # a, b, c
    entropy = -(share * np.log(share)).sum()
    for j, (name, grams) in enumerate([("x", ["\0ab", "aba", "ba\1", "\0ab", "ab\1"]), ("y", ["\0bc", "bcb", "cb\1"])]):
        total = len(grams) + 0.1 * 65536
        want = sum((np.log((grams.count(g) + 0.1) / total) + 3 * entropy) / 3 for g in ("\0ab", "aba", "ba\1"))
        assert memo.tagger.languages[j] == name and memo.tagger.evidence(["aba"])[0, j] == pytest.approx(want, rel=1e-4)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (None, "the dog", "en", "x"), (4, None, "en", "x"), (5, "", None, "x"), (6, "123 ²½ ...", "fr", "x"), (7, "日本語", None, "x"), (8, "a" * 100000 + " the the", None, "x"), (9, "the cat", None, "x"), (9, "the cat", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in identify(docs).collect()))
    assert len(got) == len(rows) and {d for d, name, _ in got if name == "und"} == {4, 5, 6}
    assert [x for x in got if x[0] == 9][0] == [x for x in got if x[0] == 9][1]
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}


def test_a_small_memo_changes_no_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("text").collect()
    texts = [r.text for r in docs]
    tagger = fit([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)
    small = Memo(tagger, 20)
    assert [measured_texts(small, [t]) for t in texts] == [measured_texts(Memo(tagger), [t]) for t in texts]
    assert len(small) < 20 + max(len(t or "") for t in texts)


def test_workers_let_go_of_other_stages_at_once():
    """An encoder refers to itself, so that it would stay until some later collection."""
    gc.collect()
    gc.disable()
    try:
        pieces._ENCODERS["before"] = pieces.Encoder(pieces.Vocabulary.load(piece_model()))
        kept = weakref.ref(pieces._ENCODERS["before"])
        simtrie.let_go()
        assert kept() is None and not pieces._ENCODERS
    finally:
        gc.enable()

"""Counts, binomial chances and cutoffs against plain code, and odd rows."""

import math
import random
import re

from pyspark.sql import functions as F

from panelgrid.llm.riskrules import ALPHA, CUTOFFS, DELTA, chance_of_at_most, choose_cutoffs, features, judge, log_factorial

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    chars = sum(map(len, words))
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_counts(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n x", "é ñ # <b>\x0b\x0c\r\n", "日本 " * 10, "w " * 5000, "z" * 100000]
    texts += ["".join(rng.choice(["a ", "b ", "c", "\n", "#", " "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    for r in features(docs).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5], repr(texts[r.doc_id])[:99]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_chances(spark):
    cases = [(k, n, 0.01) for n in (1, 7, 100, 2000, 100000) for k in {0, 1, n // 400, n // 120} if k < n * 0.01]
    rows = spark.createDataFrame(cases, "k long, n long, p double")
    for r in rows.select("*", chance_of_at_most(F.col("k"), F.col("n"), 0.01).alias("chance"), log_factorial(F.col("n")).alias("log")).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert math.isclose(r.chance, want, rel_tol=1e-6) and math.isclose(r.log, math.lgamma(r.n + 1), rel_tol=1e-12, abs_tol=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], False, rng.random() * (0.12 if i % 2 else 0.02), 0.0, 0.0, 5.0) for i in range(8000)] + [(9000, None, False, 0.5, 0.9, 0.9, 40.0)]
    frame = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, symbol_rate double, dup_line_rate double, repeat_rate double, word_length double")
    got = {r.stratum: r for r in choose_cutoffs(frame, frame.select("doc_id")).collect()}
    share, tests = ALPHA / len(CUTOFFS), sum(map(len, CUTOFFS.values()))
    for name in "ab":
        values = [r[3] for r in rows if r[1] == name]
        admissible = []
        for c in CUTOFFS["symbol_rate"]:
            k, n = sum(v > c for v in values), len(values)
            chance = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) if k < share * n else 1
            if chance <= DELTA / (tests * 3):
                admissible.append(c)
        assert got[name].cut_symbol_rate == min(admissible)
    assert got["a"].cut_symbol_rate == 0.02 and got["b"].cut_symbol_rate == 0.15 and None not in got


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "x"), (1, text, "en", "x"), (2, None, None, "x"), (None, text, "en", None), (3, text + " #" * 50, "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string").withColumn("kept", F.lit(1)).withColumn("stratum", F.lit("z"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1)], "doc_id long, quality int")
    got = sorted(((r.doc_id or 0), r.base_failed, r.kept) for r in judge(docs, labels).collect())
    assert got == [(0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, False, True)]
    assert judge(docs, labels.limit(0)).count() == 5 and judge(docs.limit(0), labels).count() == 0

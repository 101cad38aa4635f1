"""Quality rules whose cutoffs are chosen by controlled risk.

Each rule rejects a document when one of its rates exceeds a cutoff. Cutoffs are chosen for each stratum (language) from
labelled holdouts: of the good documents that the base rules let pass, a cutoff may falsely reject a share of at most
`alpha` split evenly among the rules. A cutoff is admissible if the exact binomial test rejects a larger share: the chance of
as few rejections as were seen, at that share, is at most `delta` divided by the number of tests (rules x cutoffs x
strata). The strictest admissible cutoff is taken; where none is, the rule is off in that stratum. So with confidence
1 - delta no stratum loses more than a share alpha of its good documents to the rules.

All of it is DataFrame operations on one row for each document: windows of words are hashes in an array of that row, so
neither words nor windows are shuffled. What joins the labels is one narrow row for each document, and what joins the
cutoffs is one row for each stratum.

Defined cases: a null, empty or blank text has no words and fails the base rules; null strata are a stratum of their
own; null labels don't count, and a document that has several labels is good if all are; without good labels every rule is
off; repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.session import stage

BLANK = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.02, 0.05
CUTOFFS = {  # rates and their possible cutoffs, from strict to lenient
    "symbol_rate": [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3],
    "dup_line_rate": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7],
    "repeat_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4],
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}


def repeated_words(words: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with an array `words`: those within a window of three that occurs again in the text."""
    def window_hashes(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - 2)
        return F.transform(places, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    hashed = words.withColumn("hashes", F.when(F.size("words") >= 3, window_hashes(F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    hashed = hashed.withColumn("again", F.size("hashes") > F.size(F.array_distinct("hashes")))
    order = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("order", F.when(F.col("again"), order))
    near = lambda k: F.coalesce(F.get("order", k).getField("h"), F.lit(None))
    repeated = F.filter("order", lambda x, k: F.coalesce((x.h == near(k - 1)) | (x.h == near(k + 1)), (x.h == near(k - 1)), (x.h == near(k + 1)), F.lit(False)))
    hashed = hashed.withColumn("places", F.when(F.col("again"), F.sort_array(F.transform(repeated, lambda x: x.i))))
    steps = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    count = F.when(F.col("again"), F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long"))
    return hashed.withColumn("n_repeat_words", count).drop("hashes", "again", "order", "places")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the counts of the base rules, base_failed and the rates of the other rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("text"))
    blank = F.translate("text", BLANK, " " * len(BLANK))
    rows = rows.withColumn("words", F.array_remove(F.split(blank, " ", -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANK + " ", "")) > 0)
    rows = rows.withColumn("lines", lines)
    rows = repeated_words(rows).select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANK + " ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("word_chars", "n_words").alias("word_length"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, taken back to n by the product of the steps between."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - reduce(lambda a, i: a + F.log(n.cast("double") + i), range(2, 9), F.log(n.cast("double") + 1.0))


def chance_of_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, exactly, for k under n p: the term of k, then those below, each from the one above.

    Terms fall faster than geometrically there, so the sum ends when they no longer count.
    """
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    below = F.sequence(k, F.greatest(F.lit(1).cast("long"), k - 60 - F.ceil(12 * F.sqrt(k))), F.lit(-1).cast("long"))
    steps = F.when(k > 0, below).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state.term * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (state.sum + term).alias("sum"))

    return F.exp(log_top) * F.aggregate(steps, start, add, lambda s: s.sum)


def choose_cutoffs(rows: DataFrame, good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with a cutoff for each rule, null where the rule is off. `good`: ids of good documents."""
    holdout = rows.where("not base_failed").join(good, "doc_id")
    share = alpha / len(CUTOFFS)
    counts = [F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, cutoffs in CUTOFFS.items() for i, c in enumerate(cutoffs)]
    seen = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    choices = [F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, cutoffs in CUTOFFS.items() for i, c in enumerate(cutoffs)]
    tests = seen.select("stratum", "n", F.explode(F.array(*choices)).alias("test")).select("stratum", "n", "test.*")
    strata = seen.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    level = F.lit(delta / len(choices)) / strata
    sure = F.when(F.col("k") < share * F.col("n"), chance_of_at_most(F.col("k"), F.col("n"), share) <= level).otherwise(False)
    best = tests.where(sure).groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in CUTOFFS))
    return best


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document. `labels`: doc_id and quality (1 is good)."""
    rows = stage(features(docs), "features")
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    cutoffs = stage(choose_cutoffs(rows, good), "cutoffs").withColumnRenamed("stratum", "__stratum")
    judged = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    over = [F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in CUTOFFS]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~reduce(lambda a, b: a | b, over)).alias("kept"))


_RATES = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
_TESTS = ", ".join(f"('{rule}', {float(c)})" for rule, cutoffs in CUTOFFS.items() for c in cutoffs)
_COUNT = sum(map(len, CUTOFFS.values()))

ORACLE = rf"""
WITH base AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS row FROM documents),
windows AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT row, words, unnest(generate_series(1, len(words) - 2)) AS i FROM base)),
repeated AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY row),
counted AS (
  SELECT doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM base LEFT JOIN covered USING (row)),
rows AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS {rule}" for rule, (a, b) in _RATES.items())} FROM counted),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT r.* FROM rows r JOIN good USING (doc_id) WHERE NOT base_failed),
values_of AS (SELECT stratum, unnest([{", ".join(f"{{'rule': '{rule}', 'rate': CAST({rule} AS DOUBLE)}}" for rule in CUTOFFS)}], recursive := true) FROM holdout),
tests AS (
  SELECT stratum, v.rule, cutoff, count(*) AS n, count(*) FILTER (rate > cutoff) AS k
  FROM values_of v JOIN (VALUES {_TESTS}) t(rule, cutoff) ON v.rule = t.rule GROUP BY ALL),
chances AS (
  SELECT stratum, rule, cutoff, k < {ALPHA / len(CUTOFFS)!r} * n AND list_sum(list_transform(generate_series(0, k),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(CUTOFFS)!r}) + (n - i) * ln(1 - {ALPHA / len(CUTOFFS)!r}))))
    <= {DELTA / _COUNT!r} / (SELECT greatest(count(DISTINCT coalesce(stratum, '?null')), 1) FROM holdout) AS sure FROM tests),
cutoffs AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{rule}') AS cut_{rule}" for rule in CUTOFFS)} FROM chances WHERE sure GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({rule} > cut_{rule}, false)" for rule in CUTOFFS)}) AS kept
FROM rows r LEFT JOIN cutoffs c ON r.stratum IS NOT DISTINCT FROM c.stratum
"""

"""Comparison with outside rankings, labels, studies and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.distribution import medians, spearman
from panelgrid.session import small_frame
from panelgrid.sources.tables import preview, union_all


def pick_group(candidates: list[tuple[str, str]], entities: DataFrame) -> DataFrame:
    """Per cohort label the first listed group that exists; null where none does."""
    spark = entities.sparkSession
    asked = small_frame(spark, [(c, g, i) for i, (c, g) in enumerate(candidates)], "cohort string, grp string, place int")
    known = entities.select("grp").distinct().withColumn("_there", F.lit(True))
    return asked.join(known, "grp", "left").groupBy("cohort").agg(F.min_by(F.when(F.col("_there"), F.col("grp")), F.when(F.col("_there"), F.col("place"))).alias("grp"))


def compare_ranking(theirs: DataFrame, ids: DataFrame, groups: DataFrame, modes: DataFrame, ours: DataFrame) -> DataFrame:
    """Each external row in each query mode, with our score and a status: no_group_match, no_marker, abandoned, id_not_found,
    not_scored, ok.

    ``theirs``: cohort, name, their_rank. ``ids``: name, entity. ``groups``: cohort, grp. ``modes``: cohort, mode, panel,
    error; a mode without a panel has no marker for the cohort, one with an error could not be scored.
    ``ours``: cohort, mode, entity, D, tier, veto_reason, position; disqualified entities are not in it.
    """
    rows = theirs.join(groups, "cohort", "left").join(modes, "cohort").join(ids, "name", "left").join(ours.withColumn("_ours", F.lit(True)), ["cohort", "mode", "entity"], "left")
    status = (F.when(F.col("grp").isNull(), "no_group_match").when(F.col("error").isNotNull(), "abandoned").when(F.col("panel").isNull(), "no_marker")
              .when(F.col("entity").isNull(), "id_not_found").when(F.col("_ours").isNull(), "not_scored").otherwise("ok"))
    return rows.withColumn("status", status).drop("_ours")


def ranking_agreement(compared: DataFrame, min_n: int = 3) -> DataFrame:
    rows = compared.where("status = 'ok' and position is not null")
    rho = spearman(rows, ["cohort", "mode"], "their_rank", "position")
    return rho.select("cohort", "mode", "n", F.when(F.col("n") >= min_n, F.round("rho", 8)).alias("rho"))


def same_text(a: str, b: str) -> Column:
    return F.lower(F.trim(F.col(a))) == F.lower(F.trim(F.col(b)))


def label_agreement(theirs: DataFrame, ours: DataFrame, key: str) -> DataFrame:
    """Matched rows, agreeing labels and rates. ``theirs``: key, their_label; ``ours``: key, our_label."""
    rows = theirs.join(ours.withColumn("_m", F.lit(True)), key, "left")
    agree = F.col("_m") & F.coalesce(same_text("their_label", "our_label"), F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("n_total"), F.count("_m").alias("n_matched"), F.count(F.when(agree, 1)).alias("n_agree"))
    return out.withColumn("match_rate", F.round(F.col("n_matched") / F.col("n_total"), 6)).withColumn("agree_rate", F.round(F.try_divide(F.col("n_agree").cast("double"), F.col("n_matched")), 6))


def direction_check(scores: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str]) -> DataFrame:
    """Whether each cohort scores its expected panel higher. A rule is (cohort, higher panel, lower panel)."""
    cells = scores.where("D is not null").groupBy("cohort", "panel").agg(F.avg("D").alias("m"))

    def mean(cohort: str, panel: str) -> Column:
        return F.round(F.max(F.when((F.col("cohort") == cohort) & (F.col("panel") == panel), F.col("m"))), 8)

    out = cells.agg(mean(first[0], first[1]).alias("first_high"), mean(first[0], first[2]).alias("first_low"), mean(second[0], second[1]).alias("second_high"), mean(second[0], second[2]).alias("second_low"))
    holds = (F.col("first_high") > F.col("first_low")) & (F.col("second_high") > F.col("second_low"))
    return out.withColumn("verdict", F.when(holds.isNull(), "inconclusive").when(holds, "consistent").otherwise("inconsistent"))


def denominators(samples: DataFrame, lists: DataFrame) -> DataFrame:
    """Primary samples measured per study and layer. ``samples``: study, sample; ``lists``: study, layer, sample."""
    measured = lists.select("study", "layer", "sample").distinct().join(samples.select("study", "sample").distinct(), ["study", "sample"], "left_semi")
    return measured.groupBy("study", "layer").agg(F.count(F.lit(1)).alias("n_measured"))


def pair_prevalence(events: DataFrame, samples: DataFrame, expected: list[tuple[str, str, str]], measured: DataFrame) -> DataFrame:
    """Measured samples with an exact pair event, in the study where it is expected.

    ``expected`` is (study, a, b); ``measured`` is (study, sample).
    """
    spark = events.sparkSession
    asked = small_frame(spark, [(s, min(a, b), max(a, b)) for s, a, b in expected], "study string, low string, high string")
    keys = events.where("partner is not null").select("sample", F.least("feature", "partner").alias("low"), F.greatest("feature", "partner").alias("high")).distinct()
    inside = samples.join(measured, ["study", "sample"], "left_semi").select("study", "sample")
    hits = keys.join(inside, "sample").join(asked, ["study", "low", "high"], "left_semi").groupBy("study", "low", "high").agg(F.count(F.lit(1)).alias("n_samples"))
    sizes = inside.distinct().groupBy("study").agg(F.count(F.lit(1)).alias("n_measured"))
    out = asked.join(hits, ["study", "low", "high"], "left").join(sizes, "study", "left").na.fill(0, ["n_samples", "n_measured"])
    return out.withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_samples"), F.col("n_measured")), 6))


def event_prevalence(events: DataFrame, samples: DataFrame, features: list[str], definitions: dict[str, Column]) -> DataFrame:
    """Altered samples per study, requested feature and definition; studies without an event stay at 0."""
    rows = events.where(F.col("feature").isin(features)).groupBy("sample", "feature").agg(*[F.bool_or(rule).alias(n) for n, rule in definitions.items()])
    found = rows.join(samples, "sample").groupBy("study", "feature").agg(*[F.count(F.when(F.col(n), 1)).alias(n) for n in definitions])
    sizes = samples.groupBy("study").agg(F.count(F.lit(1)).alias("n_samples"))
    grid = sizes.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    out = grid.join(found, ["study", "feature"], "left").na.fill(0, list(definitions))
    cells = F.array(*[F.struct(F.lit(n).alias("definition"), F.col(n).alias("n_altered")) for n in definitions])
    return out.select("study", "feature", "n_samples", F.inline(cells)).withColumn("pct", F.round(F.lit(100.0) * F.col("n_altered") / F.col("n_samples"), 6))


def copy_prevalence(calls: DataFrame) -> DataFrame:
    """Shares of deep loss (-2), gain (1) and amplification (2) per study and feature."""
    n = F.count(F.lit(1))
    shares = [F.round(F.lit(100.0) * F.count(F.when(F.col("state") == s, 1)) / n, 6).alias(f"{name}_pct") for name, s in (("deep_loss", -2), ("gain", 1), ("amplification", 2))]
    return calls.groupBy("study", "feature").agg(n.alias("n"), *shares)


def within_study_corr(values: DataFrame, pairs: list[tuple[str, str]], min_n: int = 30) -> DataFrame:
    """Spearman of requested feature pairs inside each study. ``values``: study, sample, feature, value."""
    feats = sorted({f for p in pairs for f in p})
    wide = values.where(F.col("feature").isin(feats)).groupBy("study", "sample").agg(*[F.avg(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in feats])
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    rho = spearman(wide.select("study", F.inline(both)), ["study", "a", "b"], "x", "y")
    return rho.select("study", "a", "b", "n", F.when(F.col("n") >= min_n, F.round("rho", 8)).alias("rho"))


def study_summary(rho: DataFrame) -> DataFrame:
    usable = rho.where("rho is not null")
    middle = medians(usable, ["a", "b"], "rho", "median_rho", bounded=True).drop("n")
    return usable.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_studies"), F.count(F.when(F.col("rho") > 0, 1)).alias("n_positive")).join(middle, ["a", "b"]).withColumn("median_rho", F.round("median_rho", 8))


def grain_audit(tables: dict[str, DataFrame], grain: dict[str, list[str]]) -> DataFrame:
    """Rows, repeated keys and rows in them, per table."""
    parts = []
    for name, df in tables.items():
        per = df.groupBy(*grain[name]).agg(F.count(F.lit(1)).alias("k"))
        parts.append(per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("k") > 1, 1)).alias("n_repeated_keys"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_rows_in_them")).select(F.lit(name).alias("table_name"), "*"))
    return union_all(parts)


def studies(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Catalogue of comparison tables: name, what it compares, rows."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("study"), F.lit(note).alias("note"), "n_rows") for name, (df, note) in tables.items()])


def study(tables: dict[str, tuple[DataFrame, str]], name: str, order: list[str], limit: int) -> DataFrame:
    if name not in tables:
        raise KeyError(f"unknown study {name!r}; one of {sorted(tables)}")
    return preview(tables[name][0], order, limit)


def cohort_map(projects: DataFrame, lookup: dict[str, str], entities: DataFrame) -> DataFrame:
    """Outside subjects per mapped group beside our own entity counts; groups of either side are kept.

    ``projects``: project, subject.
    """
    names = small_frame(projects.sparkSession, list(lookup.items()), "project string, grp string")
    subjects = projects.select("project", "subject").distinct().join(names, "project")
    outside = subjects.groupBy("grp").agg(F.count(F.lit(1)).alias("n_subjects"), F.count_distinct("project").alias("n_projects"), F.concat_ws(" | ", F.sort_array(F.collect_set("project"))).alias("projects"))
    own = entities.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n_entities"))
    return own.join(outside, "grp", "full").na.fill(0, ["n_entities", "n_subjects", "n_projects"]).na.fill("", ["projects"])


def audit_registry(rows: DataFrame) -> DataFrame:
    """Candidate columns by their permitted role, in a fixed role order."""
    place = F.when(F.col("role") == "scoring", 1).when(F.col("role") == "context", 2).when(F.col("role") == "validation", 3).otherwise(4)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.sort_array(F.collect_set("column_name"))).alias("columns")).withColumn("place", place).orderBy("place", "role")



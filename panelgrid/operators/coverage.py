"""Coverage states, cohorts, shares and admission verdicts.

Coverage is kept long: (entity, grp, subgroup, layer, state). Counting first collapses to small
(group, layer, state) tables; only those are windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.distribution import medians



def measured() -> Column:
    return F.col("state") != "not_assayed"


def coverage2(spine: DataFrame, ids: DataFrame, out: str = "state") -> DataFrame:
    seen = ids.select("entity").distinct().withColumn("_seen", F.lit(True))
    return spine.join(seen, "entity", "left").withColumn(out, F.when(F.col("_seen"), "measured").otherwise("not_assayed")).drop("_seen")


def coverage3(spine: DataFrame, assayed: DataFrame, events: DataFrame, out: str = "state") -> DataFrame:
    """Events count only inside the assayed set."""
    a = assayed.select("entity").distinct().withColumn("_assayed", F.lit(True))
    e = events.select("entity").distinct().withColumn("_event", F.lit(True))
    state = F.when(F.col("_assayed").isNull(), "not_assayed").when(F.col("_event"), "measured").otherwise("measured_absent")
    return spine.join(a, "entity", "left").join(e, "entity", "left").withColumn(out, state).drop("_assayed", "_event")


def layer_count(coverage: DataFrame, states: list[str], out: str = "n_layers") -> DataFrame:
    total = F.lit(0)
    for c in states:
        total = total + (F.col(c) != "not_assayed").cast("int")
    return coverage.withColumn(out, total)


def coverage_counts(coverage: DataFrame, states: list[str]) -> DataFrame:
    return coverage.unpivot(["entity"], states, "column_name", "state").groupBy("column_name", "state").agg(F.count(F.lit(1)).alias("n"))


def group_coverage(long: DataFrame, min_n: int = 15) -> DataFrame:
    """Measured share per group and layer, with a flag for small groups."""
    out = long.groupBy("grp", "layer").agg(F.count(F.lit(1)).alias("n_entities"), F.count(F.when(measured(), 1)).alias("n_measured"))
    return out.withColumn("fraction", F.round(F.col("n_measured") / F.col("n_entities"), 4)).withColumn("low_n", F.col("n_entities") < min_n)


def presence_patterns(coverage: DataFrame, states: list[str]) -> DataFrame:
    names = [F.when(F.col(c) != "not_assayed", F.lit(c.removesuffix("_state"))) for c in states]
    rows = coverage.select(F.concat_ws("+", *names).alias("pattern"), sum(n.isNotNull().cast("int") for n in names).alias("n_layers"))
    counted = rows.groupBy("pattern", "n_layers").agg(F.count(F.lit(1)).alias("n"))
    total = coverage.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counted.withColumn("share_pct", F.round(F.lit(100.0) * F.col("n") / total, 4))


def co_presence(coverage: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two layer flags with margins; a margin is a null."""
    flags = coverage.select((F.col(a) != "not_assayed").alias("has_a"), (F.col(b) != "not_assayed").alias("has_b"))
    return flags.cube("has_a", "has_b").agg(F.count(F.lit(1)).alias("n"))


def cohort_members(long: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    """(question, entity, in_cohort): every required layer must be measured."""
    wanted = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(layer).alias("layer"), F.lit(i).alias("step"))
                       for q, layers in definitions.items() for i, layer in enumerate(layers, 1)])
    defs = F.filter(wanted, lambda d: d["layer"] == F.col("layer"))
    hit = long.select("entity", "grp", F.col("state"), F.explode(defs).alias("d"))
    return hit.select("entity", "grp", "d.question", "d.layer", "d.step", measured().alias("has"))


def route_cohorts(long: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    """Cohort size per question, its limiting layer and how much of that layer is kept."""
    rows = cohort_members(long, definitions)
    cohort = rows.groupBy("question", "entity").agg(F.bool_and("has").alias("ready")).groupBy("question").agg(
        F.count(F.lit(1)).alias("n_spine"), F.count(F.when(F.col("ready"), 1)).alias("n_ready"))
    limiting = rows.groupBy("question", "layer").agg(F.count(F.when(F.col("has"), 1)).alias("k")).groupBy("question").agg(
        F.count(F.lit(1)).alias("n_layers"), F.min("k").alias("n_limiting"), F.min_by("layer", F.struct("k", "layer")).alias("limiting_layer"))
    return (cohort.join(limiting, "question")
            .withColumn("pct_of_spine", F.round(F.lit(100.0) * F.col("n_ready") / F.col("n_spine"), 4))
            .withColumn("retention_pct", F.round(F.try_divide(F.lit(100.0) * F.col("n_ready"), F.col("n_limiting")), 4)))


def waterfall(long: DataFrame, layers: list[str]) -> DataFrame:
    """Entities left after each required layer in turn, and the loss at that step."""
    rows = cohort_members(long, {"q": layers})
    first_missing = rows.groupBy("entity").agg(F.coalesce(F.min(F.when(~F.col("has"), F.col("step"))), F.lit(len(layers) + 1)).alias("lost_at"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("layer")) for i, name in enumerate(["spine", *layers])])
    counts = first_missing.groupBy("lost_at").agg(F.count(F.lit(1)).alias("k"))
    out = counts.select("lost_at", "k", F.inline(steps)).groupBy("step", "layer").agg(
        F.coalesce(F.sum(F.when(F.col("lost_at") > F.col("step"), F.col("k"))), F.lit(0)).alias("n_left"))
    before = F.lag("n_left").over(Window.orderBy("step"))
    return out.withColumn("n_lost", F.coalesce(before - F.col("n_left"), F.lit(0)))


def ready_by_group(long: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    per = cohort_members(long, definitions).groupBy("question", "grp", "entity").agg(F.bool_and("has").alias("ready"))
    return per.groupBy("question", "grp").agg(F.count(F.lit(1)).alias("n_group"), F.count(F.when(F.col("ready"), 1)).alias("n_ready"))


def share_shift(long: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    """Change of a group's share between the spine and a cohort, in percentage points."""
    w = Window.partitionBy("question")
    spine = F.lit(100.0) * F.col("n_group") / F.sum("n_group").over(w)
    cohort = F.try_divide(F.lit(100.0) * F.col("n_ready"), F.sum("n_ready").over(w))
    out = ready_by_group(long, definitions).withColumn("spine_pct", spine).withColumn("cohort_pct", cohort)
    return out.select("question", "grp", "n_group", "n_ready", F.round("spine_pct", 6).alias("spine_pct"), F.round("cohort_pct", 6).alias("cohort_pct"),
                      F.round(F.col("cohort_pct") - F.col("spine_pct"), 6).alias("shift_pp"))


def suitability(long: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    n = F.col("n_ready")
    return ready_by_group(long, definitions).groupBy("question").agg(
        F.count(F.when(n >= 30, 1)).alias("groups_30_or_more"), F.count(F.when((n >= 15) & (n < 30), 1)).alias("groups_15_to_29"),
        F.count(F.when(n < 15, 1)).alias("groups_below_15"), F.max(n).alias("largest_group"))


def concentration(long: DataFrame, top: int = 3) -> DataFrame:
    """Share of the largest groups of a layer over the share their sizes would give."""
    per = group_coverage(long)
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n_measured"), "grp"))
    out = per.withColumn("_r", rank).groupBy("layer").agg(
        F.sum(F.when(F.col("_r") <= top, F.col("n_measured"))).alias("top"), F.sum("n_measured").alias("all_measured"),
        F.sum(F.when(F.col("_r") <= top, F.col("n_entities"))).alias("top_size"), F.sum("n_entities").alias("all_size"))
    share = F.try_divide(F.col("top").cast("double"), F.col("all_measured"))
    expected = F.col("top_size").cast("double") / F.col("all_size")
    return out.select("layer", F.round(share, 6).alias("top_share"), F.round(expected, 6).alias("expected_share"), F.round(F.try_divide(share, expected), 6).alias("ratio"))


def small_cells(long: DataFrame, min_group: int, max_cell: int) -> DataFrame:
    """Large groups in which a layer has few measured entities."""
    return group_coverage(long).where((F.col("n_entities") >= min_group) & (F.col("n_measured") < max_cell)).select("grp", "layer", "n_entities", "n_measured")


def entity_master(spine: DataFrame, sets: dict[str, DataFrame], counts: dict[str, DataFrame]) -> DataFrame:
    """Presence flag per id set, event count per count table, and eligibility per question.

    All sets are tagged and grouped by entity once, so there is one join whatever their number.
    """
    tagged = None
    for name, df in {**sets, **counts}.items():
        part = df.groupBy("entity").agg(F.count(F.lit(1)).alias("k")).withColumn("tag", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    one = tagged.groupBy("entity").agg(
        *[F.count(F.when(F.col("tag") == n, 1)).alias(f"has_{n}") for n in sets],
        *[F.coalesce(F.sum(F.when(F.col("tag") == n, F.col("k"))), F.lit(0)).alias(f"n_{n}") for n in counts])
    out = spine.join(one, "entity", "left")
    out = out.na.fill(0, [f"has_{n}" for n in sets] + [f"n_{n}" for n in counts])
    return (out.withColumn("eligible_direct", (F.col("has_fusion_assay") > 0).cast("int"))
            .withColumn("eligible_codependency", ((F.col("has_effect") > 0) & (F.col("has_dependency") > 0)).cast("int"))
            .withColumn("eligible_conditional", ((F.col("has_effect") > 0) & ((F.col("has_expression") > 0) | (F.col("has_copy_number") > 0) | (F.col("has_dna") > 0))).cast("int")))


def screen_context(screens: DataFrame) -> DataFrame:
    """Per entity: screens, passes, any and all passing, means, a median and the library list."""
    middle = medians(screens, ["entity"], "doubling", "median_doubling").drop("n")
    return screens.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_screens"), F.count(F.when(F.col("passes"), 1)).alias("n_passing"),
        F.coalesce(F.bool_or("passes"), F.lit(False)).cast("int").alias("any_passes"), F.coalesce(F.bool_and("passes"), F.lit(False)).cast("int").alias("all_pass"),
        F.avg("score").alias("mean_score"), F.concat_ws("|", F.sort_array(F.collect_set("library"))).alias("libraries"),
        F.count_distinct("library").alias("n_libraries")).join(middle, "entity", "left")


def admission_gate(metrics: DataFrame, min_coverage: float, max_bias: float, min_groups: int) -> DataFrame:
    """Verdict per layer from (addressable, coverage, bias_ratio, n_calibratable)."""
    verdict = (F.when(~F.col("addressable"), "reject: no feature key").when(F.col("coverage") < min_coverage, "defer: low coverage")
               .when(F.col("bias_ratio") > max_bias, "defer: concentrated").when(F.col("n_calibratable") < min_groups, "defer: not calibratable").otherwise("admit"))
    return metrics.withColumn("verdict", verdict)


def assay_combinations(samples: DataFrame) -> DataFrame:
    """Samples per entity and its combination of datatypes."""
    return samples.groupBy("entity").agg(F.count(F.lit(1)).alias("n_samples"), F.concat_ws("+", F.sort_array(F.collect_set("datatype"))).alias("combination"))

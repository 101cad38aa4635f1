"""Pairwise relationship evaluation: group-adjusted statistics, bootstrap, hold-outs, statuses.

Every evaluator is keyed by `task` (a pair with its direction), so one plan evaluates any number
of pairs. A pair has one row for each entity at most, so it grows with the data: medians, ranks and
resamples come from ranges of values (`bounded=True` below is left where groups are scenarios, requests or replicates). A pair is a request: its entity rows are read with a feature filter and reshaped to one
row per (task, entity) with columns; nothing is compared across entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.columns import explicit_true, hash_uniform, sign
from panelgrid.functions.distribution import (
    average_ranks, group_residual, guarded_corr, medians, percentiles, rank_biserial, spearman,
)
from panelgrid.operators import resample
from panelgrid.session import small_frame, stage

# Evaluation policy.
MIN_GROUP = 15
MIN_SIDE = 10
MIN_TOTAL = 30
MIN_GROUPS = 2
STABLE = 0.80
SUPPORT_CUTOFF = -0.5
REPLICATES = 500
DIGITS = 9


def evidence_state(coverage: Column, has_row: Column) -> Column:
    return F.when(has_row, "observed").when(coverage.isNull() | (coverage == "not_assayed"), "not_assayed").otherwise("measured_absent")


def relationship_id(family: Column, a: Column, b: Column, symmetric: Column) -> Column:
    """Hash of the pair; symmetric families ignore the order, directional ones keep it."""
    first, second = F.when(symmetric, F.least(a, b)).otherwise(a), F.when(symmetric, F.greatest(a, b)).otherwise(b)
    return F.sha2(F.concat_ws("|", family, first, second), 256)


def build_ledger(grid: DataFrame, rows: DataFrame, states: DataFrame) -> DataFrame:
    """One row per retained value, or one explicit state row where there is none.

    ``grid`` is (entity, feature, layer), ``rows`` adds a `payload` text, ``states`` is (entity,
    layer, state). The id is a content hash with the ordinal of an equal row; equal rows are
    counted first, so a hot duplicate is one row until the end.
    """
    on = ["entity", "feature", "layer"]
    counted = rows.groupBy(*on, "payload").agg(F.count(F.lit(1)).alias("_copies"))
    out = grid.join(counted, on, "left").join(states, ["entity", "layer"], "left")
    has = F.col("payload").isNotNull()
    identity = F.sha2(F.concat_ws("|", F.col("entity").cast("string"), "feature", "layer", F.coalesce("payload", F.lit("-"))), 256)
    out = out.withColumn("evidence_state", evidence_state(F.col("state"), has)).withColumn("evidence_hash", identity)
    return out.select(*on, "payload", "evidence_state", "evidence_hash", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)).cast("int"))).alias("ordinal"))


def eval_direct_pair(events: DataFrame, spine: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(per entity, overall) evaluation of exact unordered pair events.

    ``spine`` has entity, grp and fusions_state.
    """
    exact = (F.least("feature", "partner") == min(a, b)) & (F.greatest("feature", "partner") == max(a, b))
    hits = events.where(exact & F.col("partner").isNotNull()).groupBy("entity").agg(F.count(F.lit(1)).alias("n_events"))
    rows = spine.select("entity", "grp", "fusions_state").join(hits, "entity", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    assayed = F.coalesce(F.col("fusions_state"), F.lit("not_assayed")) != "not_assayed"
    rows = rows.withColumn("support", F.when(F.col("n_events") > 0, "support").when(assayed, "conflict").otherwise("unknown")).withColumn("assayed", assayed)
    overall = rows.agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.count(F.when(F.col("n_events") > 0, 1)).alias("n_support"),
                       F.count(F.when(F.col("support") == "conflict", 1)).alias("n_conflict"), F.count(F.when(F.col("support") == "unknown", 1)).alias("n_unknown"))
    status = F.when(F.col("n_events") > 0, "supported").when(F.col("n_conflict") > 0, "contradicted").otherwise("unavailable")
    return rows.select("entity", "grp", "n_events", "support"), overall.withColumn("status", status)


def damaging(flags: list[Column], impact: Column) -> Column:
    """A variant qualifies by any explicitly true flag, or by HIGH impact."""
    hit = F.upper(F.trim(impact)) == "HIGH"
    for flag in flags:
        hit = hit | explicit_true(flag)
    return F.coalesce(hit, F.lit(False))


def task_frame(like: DataFrame, tasks: list[tuple[str, str, str]], first: str, second: str) -> DataFrame:
    return small_frame(like.sparkSession, tasks, f"task string, {first} string, {second} string")


def event_context(mutations: DataFrame, spine: DataFrame, tasks: list[tuple[str, str, str]]) -> DataFrame:
    """(task, entity, context): entities with a qualifying source event against assayed ones without.

    Tasks are (task, source, target); ``spine`` has entity, grp, is_problematic, mutations_state.
    """
    qualifying = damaging([F.col("is_driver"), F.col("is_hotspot")], F.col("impact"))
    asked = task_frame(spine, tasks, "feature", "target").drop("target")
    rows = mutations.where(F.col("feature").isin([t[1] for t in tasks])).groupBy("entity", "feature").agg(F.bool_or(qualifying).alias("_hit"))
    per = rows.join(asked, "feature").select("task", "entity", "_hit")
    assayed = F.coalesce(F.col("mutations_state"), F.lit("not_assayed")) != "not_assayed"
    base = spine.where(assayed).select("entity", "grp", "is_problematic", F.explode(F.array(*[F.lit(t[0]) for t in tasks])).alias("task"))
    return base.join(per, ["task", "entity"], "left").withColumn("context", F.when(F.coalesce("_hit", F.lit(False)), "context").otherwise("reference")).drop("_hit")


def attach_effect(context: DataFrame, effects: DataFrame, tasks: list[tuple[str, str, str]]) -> DataFrame:
    """Evaluable rows: a known group, not problematic, and a value of the target feature."""
    asked = task_frame(context, tasks, "source", "feature").drop("source")
    target = effects.where(F.col("feature").isin([t[2] for t in tasks])).join(asked, "feature").select("task", "entity", "value")
    return context.where("grp is not null and is_problematic = false").join(target, ["task", "entity"]).where("value is not null")


def value_context(sources: DataFrame, spine: DataFrame, tasks: list[tuple[str, str, str]]) -> DataFrame:
    """(task, entity, grp, is_problematic, source_value) for the high-value context."""
    asked = task_frame(spine, tasks, "feature", "target").drop("target")
    cells = sources.where(F.col("feature").isin([t[1] for t in tasks])).join(asked, "feature").select("task", "entity", F.col("value").alias("source_value"))
    return cells.where("source_value is not null").join(spine.select("entity", "grp", "is_problematic"), "entity")


def quantile_context(rows: DataFrame, low: float = 0.2, high: float = 0.8, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows with context, thresholds): high and low fifth of the source value inside each group.

    ``rows`` is evaluable (task, entity, grp, source_value, value). A group that is too small, or
    whose fifths touch, does not discriminate and is left out.
    """
    q = percentiles(rows, ["task", "grp"], "source_value", {"q_low": low, "q_high": high})
    q = q.withColumn("q_low", F.round("q_low", DIGITS)).withColumn("q_high", F.round("q_high", DIGITS))
    q = q.withColumn("reason", F.when(F.col("n") < min_group, "eligible_n_below_minimum").when(F.col("q_high") <= F.col("q_low"), "high_not_above_low"))
    side = F.when(F.col("source_value") >= F.col("q_high"), "context").when(F.col("source_value") <= F.col("q_low"), "reference").otherwise("middle")
    return rows.join(q.where("reason is null").drop("n", "reason"), ["task", "grp"]).withColumn("context", side), q


def side_medians(rows: DataFrame, keys: list[str], value: str, context: str = "context") -> DataFrame:
    """Median of each side per key and `shift` = reference - context."""
    m = percentiles(rows.where(F.col(context).isin("context", "reference")), [*keys, context], value, {"m": 0.5})
    out = m.groupBy(*keys).agg(
        F.max(F.when(F.col(context) == "context", F.col("m"))).alias("median_context"), F.max(F.when(F.col(context) == "reference", F.col("m"))).alias("median_reference"),
        F.coalesce(F.max(F.when(F.col(context) == "context", F.col("n"))), F.lit(0)).alias("n_context"), F.coalesce(F.max(F.when(F.col(context) == "reference", F.col("n"))), F.lit(0)).alias("n_reference"))
    return out.withColumn("shift", F.round(F.col("median_reference") - F.col("median_context"), DIGITS))


def gates(n_context: Column, n_reference: Column, n_groups: Column) -> Column:
    return (n_context >= MIN_SIDE) & (n_reference >= MIN_SIDE) & (n_context + n_reference >= MIN_TOTAL) & (n_groups >= MIN_GROUPS)


def bootstrap_draws(rows: DataFrame, keys: list[str], strata: list[str], values: list[str], replicates: int, seed: int) -> DataFrame:
    """Stratified resampling with replacement: (keys, strata, replicate, values, weight).

    Slots of a stratum are numbered by an exact position, every (replicate, slot) draws a position
    with a hash-uniform number, and equal draws are counted before the values are attached. Draws
    depend only on the seed, the stratum and the slot, so a retry gives the same sample. Volume is
    replicates x rows, spread over (stratum, position) keys; no stratum is gathered in one task.
    """
    group = [*keys, *strata]
    order = stage(resample.number_rows(rows.select(*group, "entity", *values), group, [*values, "entity"]), "numbered")
    sizes = order.groupBy(*group).agg(F.max("_pos").alias("_n"))
    slots = order.join(sizes, group).select(*group, "_pos", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = F.floor(hash_uniform(seed, *group, "replicate", "_pos") * F.col("_n")) + 1
    counts = slots.select(*group, "replicate", drawn.alias("_pos")).groupBy(*group, "replicate", "_pos").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(order.drop("entity"), [*group, "_pos"]).drop("_pos")


def interval(replicates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """95% percentile interval over the estimable replicates and their number (replicates are a fixed number, so groups are small)."""
    return percentiles(replicates, keys, value, {"ci_low": 0.025, "ci_high": 0.975}, bounded=True).withColumnRenamed("n", "n_replicates").withColumns(
        {"ci_low": F.round("ci_low", 8), "ci_high": F.round("ci_high", 8)})


def bootstrap_shift(rows: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 25) -> DataFrame:
    """Interval of the shift of medians, strata = group x context."""
    per = resample.bootstrap_shifts(rows.where("context in ('context', 'reference')"), keys, replicates, seed)
    return interval(per.where("stat is not null").withColumn("stat", F.round("stat", DIGITS)), keys, "stat")


def bootstrap_rho(rows: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 25) -> DataFrame:
    """Interval of the adjusted rank correlation, strata = group."""
    per = resample.bootstrap_correlations(rows, keys, replicates, seed)
    return interval(per.where("stat is not null").withColumn("stat", F.round("stat", DIGITS)), keys, "stat")


def leave_one_out_shift(rows: DataFrame, keys: list[str], full: DataFrame) -> DataFrame:
    """Shift with each group held out, re-gated, and whether its sign matches the full shift."""
    sides = rows.where("context in ('context', 'reference')")
    held = resample.shifts_without_each_group(sides, keys)
    out = held.withColumn("shift", F.round("raw", DIGITS)).join(full.select(*keys, F.col("shift").alias("_full")), keys)
    ok = gates(F.col("n_context"), F.col("n_reference"), F.col("n_groups")) & F.col("shift").isNotNull()
    out = out.withColumn("estimable", ok)
    match = F.col("estimable") & (sign(F.col("_full")) != 0) & (sign(F.col("shift")) == sign(F.col("_full")))
    return out.select(*keys, "held_out", F.when(F.col("estimable"), F.col("shift")).alias("shift"), "estimable", match.alias("matches"), "n_context", "n_reference", "n_groups")


def consistency(loo: DataFrame, keys: list[str]) -> DataFrame:
    return loo.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("estimable"), F.col("matches").cast("double"))), DIGITS).alias("consistency"), F.count(F.when(F.col("estimable"), 1)).alias("n_holdouts"))


def route_status(estimable: Column, broad: Column, stat: Column, low: Column, high: Column, stable: Column, both_signs: bool = False) -> Column:
    """unavailable, exploratory (a broad or unknown target too), supported or contradicted."""
    firm = F.coalesce(stable >= STABLE, F.lit(False))
    up, down = F.coalesce((stat > 0) & (low > 0), F.lit(False)), F.coalesce((stat < 0) & (high < 0), F.lit(False))
    status = F.when(~F.coalesce(estimable, F.lit(False)), "unavailable").when(F.coalesce(broad, F.lit(True)), "exploratory")
    if both_signs:
        outside = F.coalesce((low > 0) | (high < 0), F.lit(False))
        return status.when(outside & firm, "supported").otherwise("exploratory")
    return status.when(up & firm, "supported").when(down & firm, "contradicted").otherwise("exploratory")


def eval_conditional(rows: DataFrame, targets: DataFrame, replicates: int = REPLICATES, seed: int = 25) -> DataFrame:
    """One row per task: shift, interval, hold-out consistency and status.

    ``rows`` is adjusted (task, entity, grp, context, value, value_adj); ``targets`` is (task, broad).
    """
    keys = ["task"]
    rows = stage(rows, "conditional")
    sides = rows.where("context in ('context', 'reference')")
    stat = side_medians(rows, keys, "value_adj")
    raw = side_medians(rows, keys, "value").select("task", F.col("shift").alias("raw_shift"))
    n_groups = sides.groupBy("task").agg(F.count_distinct("grp").alias("n_groups"))
    loo = consistency(leave_one_out_shift(rows, keys, stat), keys)
    boot = bootstrap_shift(rows, keys, replicates, seed)
    out = targets.join(stat, "task", "left").join(raw, "task", "left").join(n_groups, "task", "left").join(loo, "task", "left").join(boot, "task", "left")
    estimable = F.coalesce(gates(F.col("n_context"), F.col("n_reference"), F.col("n_groups")) & F.col("shift").isNotNull(), F.lit(False))
    out = out.withColumn("estimable", estimable)
    low, high, held = (F.when(F.col("estimable"), F.col(c)) for c in ("ci_low", "ci_high", "consistency"))
    return out.select(
        "task", "n_context", "n_reference", "n_groups", "raw_shift", "shift", "estimable", low.alias("ci_low"), high.alias("ci_high"), held.alias("consistency"),
        route_status(F.col("estimable"), F.col("broad"), F.col("shift"), F.col("ci_low"), F.col("ci_high"), F.col("consistency")).alias("status"))


def adjusted(rows: DataFrame, values: list[str] | None = None, min_group: int = MIN_GROUP) -> DataFrame:
    return group_residual(rows, ["task", "grp"], values or ["value"], min_group)


def pair_rows(effects: DataFrame, spine: DataFrame, tasks: list[tuple[str, str, str]]) -> DataFrame:
    """(task, entity, grp, x, y) for entities with both effects, a group and a clean flag. Tasks are (task, a, b)."""
    sides = small_frame(spine.sparkSession, [row for t, a, b in tasks for row in ((t, a, "x"), (t, b, "y"))], "task string, feature string, side string")
    cells = effects.where(F.col("feature").isin(sorted({f for _, a, b in tasks for f in (a, b)}))).join(sides, "feature").groupBy("task", "entity").agg(
        F.max(F.when(F.col("side") == "x", F.col("value"))).alias("x"), F.max(F.when(F.col("side") == "y", F.col("value"))).alias("y"))
    return stage(cells.where("x is not null and y is not null").join(spine.where("is_problematic = false and grp is not null").select("entity", "grp"), "entity"), "pairs")


def eval_codependency(rows: DataFrame, broad: DataFrame, replicates: int = REPLICATES, seed: int = 25) -> DataFrame:
    """One row per task: raw and adjusted rho, interval, hold-outs and status. ``broad`` is (task, broad)."""
    adj = stage(adjusted(rows, ["x", "y"]), "codependency")
    raw = spearman(adj, ["task"], "x", "y", "raw_rho").drop("n")
    full = spearman(adj, ["task"], "x_adj", "y_adj", "rho")
    n_groups = adj.groupBy("task").agg(F.count_distinct("grp").alias("n_groups"))
    held = resample.correlations_without_each_group(adj, ["task"])
    loo = held.join(full.select("task", F.col("rho").alias("_full")), "task")
    loo = loo.withColumn("estimable", (F.col("n") >= MIN_TOTAL) & (F.col("n_groups") >= MIN_GROUPS) & F.col("r").isNotNull())
    loo = loo.withColumn("matches", F.col("estimable") & (sign(F.col("_full")) != 0) & (sign(F.col("r")) == sign(F.col("_full"))))
    out = broad.join(full, "task", "left").join(raw, "task", "left").join(n_groups, "task", "left").join(consistency(loo, ["task"]), "task", "left").join(bootstrap_rho(adj, ["task"], replicates, seed), "task", "left")
    estimable = F.coalesce((F.col("n") >= MIN_TOTAL) & (F.col("n_groups") >= MIN_GROUPS) & F.col("rho").isNotNull() & F.col("raw_rho").isNotNull(), F.lit(False))
    out = out.withColumn("estimable", estimable)
    whole = F.col("estimable") & (F.col("n_replicates") == replicates)  # one replicate without variance voids the interval
    out = out.withColumns({"ci_low": F.when(whole, F.round("ci_low", 8)), "ci_high": F.when(whole, F.round("ci_high", 8)), "consistency": F.when(F.col("estimable"), F.col("consistency"))})
    return out.select("task", "n", "n_groups", F.round("raw_rho", 8).alias("raw_rho"), F.round("rho", 8).alias("rho"), "estimable", "ci_low", "ci_high",
                      "consistency", route_status(F.col("estimable"), F.col("broad"), F.col("rho"), F.col("ci_low"), F.col("ci_high"), F.col("consistency"), True).alias("status"))


def support_state(evaluable: Column, context: Column, value: Column) -> Column:
    """Per-entity state of a conditional relationship."""
    return (F.when(~evaluable, "unknown").when(context.isin("reference", "middle"), "not_applicable")
            .when(value <= SUPPORT_CUTOFF, "support").otherwise("conflict"))


def pair_support_state(x: Column, y: Column) -> Column:
    strong_x, strong_y = x <= SUPPORT_CUTOFF, y <= SUPPORT_CUTOFF
    return F.when(strong_x & strong_y, "support").when(strong_x | strong_y, "neutral").otherwise("conflict")


def policy_sensitivity(rows: DataFrame, grid: list[dict]) -> DataFrame:
    """High-value context re-evaluated under one-factor-at-a-time settings, keyed by scenario.

    ``rows`` is evaluable (task, entity, grp, source_value, value). Settings: scenario, low, high,
    min_group, min_side, min_total.
    """
    settings = F.array(*[F.struct(F.lit(g["scenario"]).alias("scenario"), *[F.lit(float(g[k])).alias(k) for k in ("low", "high")], *[F.lit(int(g[k])).alias(k) for k in ("min_group", "min_side", "min_total")]) for g in grid])
    probs = sorted({p for g in grid for p in (g["low"], g["high"])})
    q = percentiles(rows, ["task", "grp"], "source_value", {f"p{i}": p for i, p in enumerate(probs)})
    pick = {p: F.col(f"p{i}") for i, p in enumerate(probs)}
    chosen = F.array(*[F.struct(F.lit(g["scenario"]).alias("scenario"), F.round(pick[g["low"]], DIGITS).alias("q_low"), F.round(pick[g["high"]], DIGITS).alias("q_high")) for g in grid])
    asked = q.select(F.explode(settings).alias("_s"), "*").select("task", "grp", "n", "_s.*", F.explode(chosen).alias("_c")).where("_c.scenario = scenario")
    limits = stage(asked.select("*", "_c.q_low", "_c.q_high").where("n >= min_group and q_high > q_low").drop("_c", "n", "low", "high", "min_group"), "limits")
    # a scenario keeps a group whole or not at all, so its residuals are those of every scenario
    adj = stage(group_residual(rows, ["task", "grp"], ["value"], 1).select("task", "grp", "source_value", "value_adj"), "residuals")
    side = F.when(F.col("source_value") >= F.col("q_high"), "context").when(F.col("source_value") <= F.col("q_low"), "reference").otherwise("middle")
    run = adj.join(limits, ["task", "grp"]).select("scenario", "task", side.alias("context"), "value_adj")
    keys = ["scenario", "task"]
    stat = side_medians(run, keys, "value_adj")
    held = limits.join(adj.select("task", "grp").distinct(), ["task", "grp"])
    n_groups = held.groupBy(*keys).agg(F.count_distinct("grp").alias("n_groups"), F.any_value("min_side").alias("min_side"), F.any_value("min_total").alias("min_total"))
    out = stat.join(n_groups, keys)
    ok = (F.col("n_context") >= F.col("min_side")) & (F.col("n_reference") >= F.col("min_side")) & (F.col("n_context") + F.col("n_reference") >= F.col("min_total")) & (F.col("n_groups") >= MIN_GROUPS)
    return out.select(*keys, "n_context", "n_reference", "n_groups", "shift", ok.alias("estimable"))


# The six tasks of a pair in an automatic plan.
PLAN_TASKS = [("direct_fusion", "symmetric", None), ("crispr_codependency", "symmetric", None), ("conditional_dependency", "a_to_b", "mutation"),
              ("conditional_dependency", "b_to_a", "mutation"), ("conditional_dependency", "a_to_b", "high_expression"), ("conditional_dependency", "b_to_a", "high_expression")]


def plan_pairs(spark: SparkSession, features: list[str], keep: int = 10) -> DataFrame:
    """Sorted pairs of the requested features; the first ones get six tasks each, the rest are listed.

    The features are a request (a panel's inclusions), so their pairs are few.
    """
    ids = sorted(set(features))
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]]
    listed = small_frame(spark, [(n, a, b, n <= keep) for n, (a, b) in enumerate(pairs, 1)], "pair_no int, a string, b string, retained boolean")
    tasks = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(d).alias("direction"), F.lit(c).cast("string").alias("context_type")) for f, d, c in PLAN_TASKS])
    none = F.array(F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("context_type")))
    return listed.select("*", F.inline(F.when(F.col("retained"), tasks).otherwise(none)))


def masked_events(events: DataFrame, assayed: DataFrame, feature: str) -> DataFrame:
    """Per assayed entity the summary of its events on a feature; zero only where assayed."""
    per = events.where(F.col("feature") == feature).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("allele_fraction").alias("max_fraction"), F.max((F.col("impact") == "HIGH").cast("int")).alias("has_lof"))
    return assayed.select("entity").distinct().join(per, "entity", "left").na.fill(0, ["n_events", "max_fraction", "has_lof"])


def pair_table(spine: DataFrame, cells: DataFrame, events: DataFrame, fusions: DataFrame, a: str, b: str) -> DataFrame:
    """All layers of two features on every entity, loss proxies, and which routes can be observed.

    ``spine`` has entity, mutations_state, fusions_state.
    """
    both = cells.where(F.col("feature").isin(a, b))
    wide = both.groupBy("entity").agg(*[
        F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{side}_{c}") for side, f in (("a", a), ("b", b)) for c in ("rna", "effect", "copy_number")])
    moments = both.groupBy("feature").agg(F.avg("rna").alias("mean"), F.stddev_samp("rna").alias("sd"))
    assayed = spine.where("mutations_state <> 'not_assayed'")
    out = spine.join(wide, "entity", "left")
    for side, f in (("a", a), ("b", b)):
        out = out.join(masked_events(events, assayed, f).select("entity", F.col("n_events").alias(f"{side}_events"), F.col("has_lof").alias(f"{side}_lof")), "entity", "left")
        own = moments.where(F.col("feature") == f).select(F.struct("mean", "sd")).scalar()
        z = F.try_divide(F.col(f"{side}_rna") - own["mean"], own["sd"])
        parts = [F.col(f"{side}_lof") == 1, F.col(f"{side}_copy_number") < 1, F.round(z, DIGITS) < -1.5]
        lost = F.lit(False)
        seen = F.lit(False)
        for part in parts:
            lost, seen = lost | F.coalesce(part, F.lit(False)), seen | part.isNotNull()
        out = out.withColumn(f"{side}_z", F.round(z, DIGITS)).withColumn(f"{side}_loss", F.when(seen, lost.cast("int")))
    exact = (F.least("feature", "partner") == min(a, b)) & (F.greatest("feature", "partner") == max(a, b))
    calls = fusions.where(exact).groupBy("entity").agg(F.count(F.lit(1)).alias("_calls"))
    out = out.join(calls, "entity", "left").withColumn("direct_call", F.when(F.col("fusions_state") != "not_assayed", F.col("_calls").isNotNull().cast("int"))).drop("_calls")
    return (out.withColumn("codependency_observed", (F.col("a_effect").isNotNull() & F.col("b_effect").isNotNull()).cast("int"))
            .withColumn("a_loss_to_b_observed", (F.col("a_loss").isNotNull() & F.col("b_effect").isNotNull()).cast("int"))
            .withColumn("b_loss_to_a_observed", (F.col("b_loss").isNotNull() & F.col("a_effect").isNotNull()).cast("int")))


def conditional_summary(df: DataFrame, loss: str, effect: str) -> DataFrame:
    rows = df.where(F.col(loss).isNotNull() & F.col(effect).isNotNull())
    lost, intact = F.avg(F.when(F.col(loss) == 1, F.col(effect))), F.avg(F.when(F.col(loss) == 0, F.col(effect)))
    return rows.agg(F.count(F.lit(1)).alias("n_eligible"), F.count(F.when(F.col(loss) == 1, 1)).alias("n_lost"), F.round(lost, DIGITS).alias("mean_lost"),
                    F.round(intact, DIGITS).alias("mean_intact"), F.round(lost - intact, DIGITS).alias("difference"))


def safe_corr(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman with at least three complete rows, else null."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry")
    enough = F.count(F.lit(1)) >= 3
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.when(enough, guarded_corr(x, y)), 8).alias("pearson"), F.round(F.when(enough, guarded_corr("_rx", "_ry")), 8).alias("spearman"))


def group_comparison(rows: DataFrame, keys: list[str], min_context: int = MIN_SIDE) -> DataFrame:
    """Two-group comparison of `value`, raw and group-adjusted. ``rows``: keys, entity, grp, context, value."""
    sides = stage(rows.where("context in ('context', 'reference') and value is not null").withColumn("_is", F.col("context") == "context"), "sides")
    raw = side_medians(sides, keys, "value")
    effect = rank_biserial(sides, keys, "value", "_is", "_rb").select(*keys, (-F.col("_rb")).alias("rank_effect"))
    adj = stage(group_residual(sides, [*keys, "grp"], ["value"], MIN_GROUP), "adjusted")
    shifted = side_medians(adj, keys, "value_adj").select(*keys, F.col("shift").alias("adjusted_shift"), F.col("n_context").alias("adj_context"), F.col("n_reference").alias("adj_reference"))
    adj_effect = rank_biserial(adj, keys, "value_adj", "_is", "_rb").select(*keys, (-F.col("_rb")).alias("adjusted_rank_effect"))
    out = raw.join(effect, keys, "left").join(shifted, keys, "left").join(adj_effect, keys, "left")
    usable = (F.col("adj_context") >= min_context) & (F.col("adj_reference") >= MIN_SIDE) & (F.col("adj_context") + F.col("adj_reference") >= MIN_TOTAL)
    return out.select(
        *keys, "n_context", "n_reference", F.round("median_context", DIGITS).alias("median_context"), F.round("median_reference", DIGITS).alias("median_reference"), "shift",
        F.round("rank_effect", 8).alias("rank_effect"), F.coalesce("adj_context", F.lit(0)).alias("adj_context"), F.coalesce("adj_reference", F.lit(0)).alias("adj_reference"),
        F.when(usable, F.col("adjusted_shift")).alias("adjusted_shift"), F.when(usable, F.round("adjusted_rank_effect", 8)).alias("adjusted_rank_effect"))


def continuous_association(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Negated adjusted rho of context `x` and effect `y`, with at least 30 adjusted rows."""
    adj = stage(group_residual(rows.where("x is not null and y is not null"), [*keys, "grp"], ["x", "y"], MIN_GROUP), "adjusted")
    rho = spearman(adj, keys, "x_adj", "y_adj", "r")
    return rho.select(*keys, "n", F.when(F.col("n") >= MIN_TOTAL, F.round(-F.col("r"), 8)).alias("association"))


def threshold_context(value: Column, low: float = 1.0, high: float = 4.0) -> Column:
    return F.when(value <= low, "loss").when(value >= high, "gain").when(value.isNotNull(), "reference")


def pair_recurrence(events: DataFrame, entities: DataFrame, n_assayed: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """Entities, groups and reads of each catalogued pair, as a share of assayed entities."""
    spark = events.sparkSession
    catalogue = small_frame(spark, [(min(p), max(p)) for p in pairs], "a string, b string")
    cells = events.where("partner is not null").select(F.least("feature", "partner").alias("a"), F.greatest("feature", "partner").alias("b"), "entity", "reads")
    per = cells.join(catalogue, ["a", "b"], "left_semi").groupBy("a", "b", "entity").agg(F.sum("reads").alias("reads"), F.max("reads").alias("max_reads")).join(entities.select("entity", "grp"), "entity", "left")
    found = per.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_entities"), F.count_distinct("grp").alias("n_groups"), F.sum("reads").alias("total_reads"), F.max("max_reads").alias("max_reads"),
                                      F.concat_ws(" | ", F.sort_array(F.collect_set("grp"))).alias("groups"))
    out = catalogue.join(found, ["a", "b"], "left").na.fill(0, ["n_entities", "n_groups", "total_reads", "max_reads"]).na.fill("", ["groups"]).withColumn("n_assayed", n_assayed)
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("n_entities") / F.col("n_assayed"), 6)).withColumn(
        "state", F.when(F.col("n_entities") > 0, "direct_pair_observed").otherwise("assayed_no_retained_pair_call"))


def pair_dominant_group(events: DataFrame, entities: DataFrame) -> DataFrame:
    """The group with most entities of a pair event and its share; ties go to the first name."""
    cells = events.where("partner is not null").select(F.least("feature", "partner").alias("a"), F.greatest("feature", "partner").alias("b"), "entity").distinct()
    per = cells.join(entities.select("entity", "grp"), "entity").groupBy("a", "b", "grp").agg(F.count(F.lit(1)).alias("k"))
    out = per.groupBy("a", "b").agg(F.sum("k").alias("n_entities"), F.min_by(F.struct("grp", "k"), F.struct(-F.col("k"), "grp")).alias("_top"))
    return out.select("a", "b", "n_entities", F.col("_top.grp").alias("dominant_group"), F.round(F.lit(100.0) * F.col("_top.k") / F.col("n_entities"), 6).alias("dominant_pct"))


def stability_summary(loo: DataFrame, full: DataFrame) -> DataFrame:
    """Range of hold-out shifts per task, the largest change, and how often the direction stays."""
    rows = loo.where("estimable").join(full.select("task", F.col("shift").alias("full_shift")), "task")
    middle = medians(rows, ["task"], "shift", "median_shift", bounded=True).drop("n")
    out = rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_holdouts"), F.any_value("full_shift").alias("full_shift"), F.min("shift").alias("min_shift"), F.max("shift").alias("max_shift"),
        F.round(F.max(F.abs(F.col("shift") - F.col("full_shift"))), DIGITS).alias("max_change"), F.round(F.lit(100.0) * F.avg((sign(F.col("shift")) == sign(F.col("full_shift"))).cast("double")), 6).alias("direction_kept_pct"))
    return out.join(middle, "task").withColumn("median_shift", F.round("median_shift", DIGITS))


def explode_targets(treatments: DataFrame, name: str = "treatment", targets: str = "targets") -> DataFrame:
    """One row per annotated target, upper-cased, with the number of targets of the treatment."""
    parts = F.filter(F.transform(F.split(targets, ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    return treatments.select(name, parts.alias("_t")).select(name, F.size("_t").alias("n_targets"), F.explode("_t").alias("target"))


def effect_drug_concordance(effects: DataFrame, responses: DataFrame, targets: DataFrame, min_n: int = MIN_SIDE) -> DataFrame:
    """Spearman of effect and response over shared entities, per target and treatment."""
    rows = effects.join(targets, "feature").join(responses, ["treatment", "entity"]).select("feature", "treatment", F.col("value").alias("x"), F.col("response").alias("y"))
    rho = spearman(rows, ["feature", "treatment"], "x", "y")
    return rho.select("feature", "treatment", "n", F.when(F.col("n") >= min_n, F.round("rho", 8)).alias("rho"))


def concordance_by_target(concordance: DataFrame) -> DataFrame:
    usable = concordance.where("rho is not null")
    middle = medians(usable, ["feature"], "rho", "median_rho", bounded=True).drop("n")
    out = usable.groupBy("feature").agg(F.count(F.lit(1)).alias("n_treatments"), F.count(F.when(F.col("rho") > 0, 1)).alias("n_positive"), F.max("rho").alias("max_rho"))
    return out.join(middle, "feature").withColumn("median_rho", F.round("median_rho", 8))


def shift_state(n_context: Column, n_reference: Column, shift: Column, min_context: int = MIN_SIDE) -> Column:
    return F.when(shift.isNull(), "none").when((n_context >= min_context) & (n_reference >= MIN_SIDE), "evaluable").otherwise("insufficient")


def context_drug_shift(context: DataFrame, responses: DataFrame) -> DataFrame:
    """Response shift per treatment between context and reference entities."""
    rows = context.join(responses, "entity").select("treatment", "entity", "grp", "context", F.col("response").alias("value"))
    out = group_comparison(rows, ["treatment"])
    return out.withColumn("state", shift_state(F.col("n_context"), F.col("n_reference"), F.col("shift")))


def matched_shift(positives: DataFrame, spine: DataFrame, responses: DataFrame, min_context: int = 3) -> DataFrame:
    """Context against reference entities of the groups in which the context occurs."""
    labelled = positives.select("entity").distinct().join(spine.select("entity", "grp"), "entity")
    pool = spine.select("entity", "grp").join(labelled.select("grp").distinct(), "grp", "left_semi").join(labelled.select("entity"), "entity", "left_anti")
    rows = labelled.withColumn("context", F.lit("context")).unionByName(pool.withColumn("context", F.lit("reference")))
    values = rows.join(responses, "entity").select("treatment", "entity", "grp", "context", F.col("response").alias("value"))
    out = side_medians(values, ["treatment"], "value")
    return out.select("treatment", "n_context", "n_reference", F.round("median_context", DIGITS).alias("median_context"), F.round("median_reference", DIGITS).alias("median_reference"), "shift").withColumn(
        "state", shift_state(F.col("n_context"), F.col("n_reference"), F.col("shift"), min_context))


def qc_gap(screens: DataFrame, ids: DataFrame) -> DataFrame:
    """Screened entities that are absent from a layer, and whether any of their screens passes."""
    absent = screens.join(ids.select("entity").distinct(), "entity", "left_anti")
    return absent.groupBy("entity").agg(F.count(F.lit(1)).alias("n_screens"), F.bool_or("passes").alias("any_pass"))


def review_hypotheses(stats: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Category by rule, verdict by the sign of the statistic, summary per hypothesis and category.

    ``stats`` is (hypothesis, kind, expected, value); ``rules`` maps kind to category.
    """
    category = F.lit("other")
    for kind, name in rules.items():
        category = F.when(F.col("kind") == kind, F.lit(name)).otherwise(category)
    verdict = F.when(F.col("value").isNull(), "not_evaluable").when(sign(F.col("value")) == F.col("expected"), "agrees").when(sign(F.col("value")) == 0, "neutral").otherwise("disagrees")
    rows = stats.withColumn("category", category).withColumn("verdict", verdict)
    return rows.groupBy("hypothesis", "category").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("agrees", "disagrees", "neutral", "not_evaluable")])


def pair_summary(long: DataFrame) -> DataFrame:
    """One row per pair: the best conditional row (a positive one first) and the positive routes.

    ``long``: pair_id, route_family, direction, metric_value, state.
    """
    conditional = F.col("route_family") == "conditional_dependency"
    usable = conditional & F.col("metric_value").isNotNull()
    key = F.struct((F.col("metric_value") <= 0).cast("int"), -F.when(F.col("metric_value") > 0, F.col("metric_value")).otherwise(F.abs("metric_value")), "direction")
    out = long.groupBy("pair_id").agg(
        F.count(F.when(usable, 1)).alias("n_conditional"), F.min_by(F.when(usable, F.struct("direction", "metric_value")), F.when(usable, key)).alias("_best"),
        F.bool_or((F.col("route_family") == "direct_fusion") & (F.col("state") == "direct_pair_observed")).alias("_direct"),
        F.bool_or((F.col("route_family") == "crispr_codependency") & (F.col("state") == "positive_signal")).alias("_codep"),
        F.bool_or(conditional & (F.col("state") == "positive_signal")).alias("_cond"))
    labels = F.concat_ws(" | ", F.when(F.col("_direct"), "direct fusion"), F.when(F.col("_codep"), "codependency"), F.when(F.col("_cond"), "conditional dependency"))
    return out.select("pair_id", "n_conditional", F.col("_best.direction").alias("best_direction"), F.col("_best.metric_value").alias("best_value"), F.when(labels == "", "none").otherwise(labels).alias("positive_routes"))


def run_plan(tasks: list[dict], known: set[str], spine: DataFrame, effects: DataFrame, sources: DataFrame, mutations: DataFrame, fusions: DataFrame, broad: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Evaluate a request of tasks as one plan keyed by task; an invalid task is a row, not an error.

    A task is {task, family, a, b, context}. ``broad`` is (feature, broad).
    """
    spark = spine.sparkSession
    reasons, good = [], []
    for t in tasks:
        why = "same_feature" if t["a"] == t["b"] else None if {t["a"], t["b"]} <= known else "unknown_feature"
        (reasons if why else good).append({**t, "reason": why})
    columns = ["task", "family", "n", "statistic", "status"]
    parts = [small_frame(spark, [(t["task"], t["family"], None, None, f"failed: {t['reason']}") for t in reasons],
                                   "task string, family string, n bigint, statistic double, status string")]
    for t in good:
        if t["family"] == "direct_fusion":
            overall = eval_direct_pair(fusions, spine, t["a"], t["b"])[1]
            parts.append(overall.select(F.lit(t["task"]).alias("task"), F.lit(t["family"]).alias("family"), (F.col("n_support") + F.col("n_conflict")).alias("n"), F.col("n_events").cast("double").alias("statistic"), "status"))
    for family, kind in (("crispr_codependency", None), ("conditional_dependency", "mutation"), ("conditional_dependency", "high_expression")):
        some = [t for t in good if t["family"] == family and t.get("context") == kind]
        if not some:
            continue
        triples = [(t["task"], t["a"], t["b"]) for t in some]
        flags = task_frame(spine, triples, "a", "b")
        fb = broad.withColumnRenamed("feature", "b")
        if family == "crispr_codependency":
            fa = broad.select(F.col("feature").alias("a"), F.col("broad").alias("_a"))
            flags = flags.join(fb, "b", "left").join(fa, "a", "left").select("task", (F.coalesce("broad", F.lit(True)) | F.coalesce("_a", F.lit(True))).alias("broad"))
            out = eval_codependency(pair_rows(effects, spine, triples), flags, replicates).select("task", "n", F.col("rho").alias("statistic"), "status")
        else:
            flags = flags.join(fb, "b", "left").select("task", "broad")
            if kind == "mutation":
                rows = adjusted(attach_effect(event_context(mutations, spine, triples), effects, triples))
            else:
                rows = adjusted(quantile_context(attach_effect(value_context(sources, spine, triples), effects, triples))[0])
            out = eval_conditional(rows, flags, replicates).select("task", (F.col("n_context") + F.col("n_reference")).alias("n"), F.col("shift").alias("statistic"), "status")
        parts.append(out.withColumn("family", F.lit(family)).select(*columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def run_controls(results: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """Verdict per control: its status must be one of the expected ones."""
    allowed = small_frame(results.sparkSession, [(k, v) for k, v in expected.items()], "task string, expected array<string>")
    return results.join(allowed, "task").select("task", "status", F.array_join("expected", "|").alias("expected"), F.array_contains("expected", F.col("status")).alias("passed"))


def export_routes(ledger: DataFrame) -> DataFrame:
    """Ledger rows flattened for a file, in a fixed order."""
    return ledger.select("feature", "layer", F.col("entity").cast("string").alias("entity"), "evidence_state", F.coalesce("payload", F.lit("")).alias("payload"), "ordinal").orderBy("feature", "layer", "entity", "payload", "ordinal")

"""Profile similarity to an anchor, alternatives, side-by-side comparison and measured context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.distribution import value_positions
from panelgrid.session import stage

# View weights and minima of the similarity policy.
VIEW_WEIGHTS = {"rna": 0.2, "dependency": 0.25, "relative_copy_number": 0.15, "protein": 0.1}
MIN_REFERENCE = 3
MIN_JOINT = 0.5
MIN_VIEWS = 2
DIGITS = 9


def view_rows(cells: DataFrame, cohort: DataFrame, features: list[str]) -> DataFrame:
    """(view, feature, entity, value) of a fixed cohort; undetected protein is missing."""
    rows = cells.where(F.col("feature").isin(features)).join(cohort.select("entity"), "entity", "left_semi")
    wide = rows.select("entity", "feature", F.col("rna"), F.col("effect").alias("dependency"), F.col("copy_number").alias("relative_copy_number"), F.when(F.col("detected"), F.col("zscore")).alias("protein"))
    return wide.unpivot(["entity", "feature"], list(VIEW_WEIGHTS), "view", "value").where("value is not null")


def percentile_profiles(rows: DataFrame) -> DataFrame:
    """Percentile of each value in its (view, feature) cohort; null where the cohort does not discriminate."""
    keys = ["view", "feature"]
    places = stage(value_positions(rows, keys, "value"), "profiles")
    spread = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"), F.count(F.when(F.col("cnt") > 1, 1)).alias("n_tie_groups"))
    ranks = places.select(*keys, "value", "n", ((F.col("before") + (F.col("cnt") + 1) / 2.0) / F.col("n")).alias("_p"))
    out = rows.join(ranks, [*keys, "value"]).join(spread, keys)
    ok = (F.col("n") >= MIN_REFERENCE) & (F.col("n_distinct") >= 2)
    return out.select(*keys, "entity", F.round(F.when(ok, F.col("_p")), DIGITS).alias("percentile"), F.col("n").alias("observed_n"), "n_tie_groups")


def view_scores(profiles: DataFrame, anchor: int, n_features: int) -> DataFrame:
    """1 - mean percentile gap to the anchor, per candidate and view with enough joint features."""
    usable = profiles.where("percentile is not null")
    mine = usable.where(F.col("entity") == anchor).select("view", "feature", F.col("percentile").alias("_a"))
    joint = usable.where(F.col("entity") != anchor).join(mine, ["view", "feature"])
    out = joint.groupBy("entity", "view").agg(F.count(F.lit(1)).alias("n_joint"), F.avg(F.abs(F.col("percentile") - F.col("_a"))).alias("_gap"))
    return out.where(F.col("n_joint") >= MIN_JOINT * n_features).select("entity", "view", "n_joint", F.round(1.0 - F.col("_gap"), 11).alias("score"))


def weighted(scores: DataFrame, keys: list[str], weight: str, minimum: int = MIN_VIEWS) -> DataFrame:
    out = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_views"), F.try_divide(F.sum(F.col(weight) * F.col("score")), F.sum(weight)).alias("S"))
    return out.where(F.col("n_views") >= minimum).withColumn("S", F.round("S", 8))


def with_weights(scores: DataFrame) -> DataFrame:
    weight = F.lit(None).cast("double")
    for view, w in VIEW_WEIGHTS.items():
        weight = F.when(F.col("view") == view, F.lit(w)).otherwise(weight)
    return scores.withColumn("weight", weight)


def similarity(scores: DataFrame) -> DataFrame:
    return weighted(with_weights(scores), ["entity"], "weight")


def leave_one_view_out(scores: DataFrame) -> DataFrame:
    """Lowest and highest similarity when one available view is omitted.

    The sums over all views are known, so leaving one out is a subtraction per row.
    """
    rows = with_weights(scores)
    total = rows.groupBy("entity").agg(F.sum(F.col("weight") * F.col("score")).alias("_s"), F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_k"))
    rest = rows.join(total, "entity").where("_k > 1").withColumn("_o", F.round((F.col("_s") - F.col("weight") * F.col("score")) / (F.col("_w") - F.col("weight")), 8))
    return rest.groupBy("entity").agg(F.min("_o").alias("S_min"), F.max("_o").alias("S_max"))


def alternatives(scores: DataFrame, eligible: DataFrame, k: int = 3) -> DataFrame:
    """The k most similar entities among those ranked positive, unvetoed and well supported."""
    rows = similarity(scores).join(eligible.select("entity", "D", "tier"), "entity")
    return rows.orderBy(F.desc("S"), "entity").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("S"), "entity")))


def alternative_sensitivity(scores: DataFrame, k: int = 3) -> DataFrame:
    """Overlap of the first k with the policy's, under equal weights and with each view omitted."""
    rows = with_weights(scores)
    runs = [("baseline", None, False), ("equal_view_weights", None, True), *[(f"omit_{v}", v, False) for v in VIEW_WEIGHTS]]
    cells = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(v).cast("string").alias("omitted"), F.lit(e).alias("equal")) for n, v, e in runs])
    long = rows.select("*", F.inline(cells)).where("omitted is null or omitted <> view").withColumn("weight", F.when(F.col("equal"), 1.0).otherwise(F.col("weight")))
    ranked = weighted(long, ["scenario", "entity"], "weight").withColumn("_r", F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("S"), "entity"))).where(F.col("_r") <= k)
    tops = ranked.groupBy("scenario").agg(F.array_sort(F.collect_list("entity")).alias("_top"))
    base = tops.where("scenario = 'baseline'").select(F.col("_top")).scalar()
    both, either = F.size(F.array_intersect("_top", "_base")), F.size(F.array_union("_top", "_base"))
    return tops.where("scenario <> 'baseline'").withColumn("_base", base).select("scenario", both.alias("overlap"), F.round(both / either, DIGITS).alias("jaccard"))


def compare(attributes: DataFrame, entities: list[int]) -> DataFrame:
    """One row per attribute, one column per entity; values keep their own units as text.

    ``attributes`` is long: entity, section, label, value (string).
    """
    if not 2 <= len(entities) <= 3 or len(set(entities)) != len(entities):
        raise ValueError("a comparison takes two or three different entities")
    rows = attributes.where(F.col("entity").isin(entities))
    return rows.groupBy("section", "label").agg(*[F.max(F.when(F.col("entity") == e, F.col("value"))).alias(f"entity_{i}") for i, e in enumerate(entities, 1)])


def event_context(events: DataFrame, entities: list[int], features: list[str], payload: str, cap: int) -> DataFrame:
    """The first `cap` event rows of each (entity, feature) with the total number of them."""
    rows = events.where(F.col("entity").isin(entities) & F.col("feature").isin(features)).select("entity", "feature", F.col(payload).alias("payload"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("entity", "feature").orderBy("payload"))).where(F.col("place") <= cap)
    total = rows.groupBy("entity", "feature").agg(F.count(F.lit(1)).alias("total"))
    return first.join(total, ["entity", "feature"]).withColumn("truncated", F.col("total") > cap)


# Caveat per (state, layer); None stands for any layer.
CAVEATS = [("not_assayed", None, "not_assayed"), ("non_detected", None, "non_detected"), ("measured_absent", "mutation", "measured_absent_not_confirmed_absence"),
           ("measured_absent", "fusion", "measured_absent_not_confirmed_absence"), ("measured", "copy_number", "relative_not_absolute"), ("measured", "protein", "mixed_scale")]


def layer_caveats(layers: DataFrame) -> DataFrame:
    caveat = F.lit(None).cast("string")
    for state, layer, name in CAVEATS:
        hit = F.col("state") == state
        caveat = F.when(hit if layer is None else hit & (F.col("layer") == layer), F.lit(name)).otherwise(caveat)
    return layers.withColumn("caveat", caveat)


def layer_missingness(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer", "state").agg(F.count(F.lit(1)).alias("n"))


def assert_invariant(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two runs has; both counts are 0 for the same result.

    Rows are compared as a multiset by one grouping, not row by row.
    """
    cols = first.columns
    tagged = first.withColumn("_w", F.lit(1)).unionByName(second.withColumn("_w", F.lit(-1)))
    diff = tagged.groupBy(*cols).agg(F.sum("_w").alias("_d"))
    return diff.agg(F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("only_second"))


def largest_group(entities: DataFrame) -> DataFrame:
    return entities.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp").limit(1)

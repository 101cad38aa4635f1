"""Calibration constants, flags, burdens, recurrence and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.distribution import percentiles

# Calibration percentiles and gates.
LOW, HIGH = 0.1, 0.9
MIN_GROUP_N = 15
MIN_FEATURE_N = 30
STRONG_CUTOFF = -1.0
BROAD_FRACTION = 0.90


def calibrate(layer: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Unrounded floor `L`, target `T` and count `n` per key."""
    return percentiles(layer, keys, value, {"L": LOW, "T": HIGH})


def calibrate_global(layer: DataFrame) -> DataFrame:
    return calibrate(layer, ["feature"])


def calibrate_group(layer: DataFrame, entities: DataFrame) -> DataFrame:
    """Constants of each group; entities without a group belong to none."""
    return calibrate(layer.join(entities.where("grp is not null").select("entity", "grp"), "entity"), ["grp", "feature"])


def gate(quantiles: DataFrame, min_n: int = 0) -> DataFrame:
    """Keep constants that separate (T > L) and rest on enough rows; round to 4 digits."""
    kept = quantiles.where((F.col("T") > F.col("L")) & (F.col("n") >= min_n))
    return kept.withColumn("L", F.round("L", 4)).withColumn("T", F.round("T", 4))


def calibrate_pooled(layer: DataFrame, detected: str = "detected") -> DataFrame:
    return calibrate(layer.where(F.col(detected)), [])


def calibrate_strength(layer: DataFrame) -> DataFrame:
    return calibrate(layer.withColumn("value", -F.col("value")), ["feature"])


def broad_counts(layer: DataFrame, cutoff: float = STRONG_CUTOFF) -> DataFrame:
    return layer.groupBy("feature").agg(F.count("value").alias("n"), F.count(F.when(F.col("value") < cutoff, 1)).alias("n_strong")).withColumn(
        "fraction", F.col("n_strong") / F.col("n"))


def flag_broad(layer: DataFrame, cutoff: float = STRONG_CUTOFF, fraction: float = BROAD_FRACTION, min_n: int = MIN_FEATURE_N) -> DataFrame:
    """Features whose effect is strong in nearly all measured entities."""
    return broad_counts(layer, cutoff).where((F.col("n") >= min_n) & (F.col("fraction") >= fraction))


def regate(constants: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Stored low-floor constants under several count gates, without new quantiles."""
    gates = F.array(*[F.struct(F.lit(k).alias("sample_id"), F.lit(v).alias("min_n")) for k, v in thresholds.items()])
    return constants.select("*", F.inline(gates)).where(F.col("n") >= F.col("min_n"))


def flag_broad_many(layer: DataFrame, samples: list[tuple[str, float, float, int]]) -> DataFrame:
    """Broad features under many (id, cutoff, fraction, min_n) settings in one pass.

    Each distinct cutoff is one conditional count, so the rows are read and shuffled once.
    """
    cutoffs = sorted({s[1] for s in samples})
    counted = layer.groupBy("feature").agg(
        F.count("value").alias("n"), *[F.count(F.when(F.col("value") < c, 1)).alias(f"k{i}") for i, c in enumerate(cutoffs)])
    settings = F.array(*[
        F.struct(F.lit(name).alias("sample_id"), F.lit(float(fraction)).alias("min_fraction"), F.lit(min_n).alias("min_n"), F.col(f"k{cutoffs.index(c)}").alias("n_strong"))
        for name, c, fraction, min_n in samples])
    out = counted.select("feature", "n", F.inline(settings)).withColumn("fraction", F.col("n_strong") / F.col("n"))
    return out.where((F.col("n") >= F.col("min_n")) & (F.col("fraction") >= F.col("min_fraction"))).select("sample_id", "feature", "n", "fraction")


def calibrate_without(layer: DataFrame, entities: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Global constants with each group held out in turn (those listed, else all), as one plan keyed by the group."""
    known = entities.where("grp is not null")
    labelled = layer.join(known.select("entity", "grp"), "entity")
    names = F.array(*[F.lit(g) for g in groups]) if groups is not None else known.agg(F.sort_array(F.collect_set("grp"))).scalar()
    held = labelled.select("feature", "value", "grp", F.explode(names).alias("held_out")).where("held_out != grp")
    return calibrate(held.drop("grp"), ["held_out", "feature"])


def matrix_summary(layer: DataFrame, by: str, strong: Column) -> DataFrame:
    return layer.groupBy(by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
                                 (F.lit(100.0) * F.avg(strong.cast("double"))).alias("strong_pct"))


def pair_evidence(events: DataFrame, a: str, b: str) -> DataFrame:
    """Evidence per entity and unordered pair; orientations and annotations as sorted sets."""
    low, high = F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b))
    keyed = events.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        "*", low.alias("feature_low"), high.alias("feature_high"), F.concat(F.col(a), F.lit("->"), F.col(b)).alias("_way"))
    return keyed.groupBy("entity", "feature_low", "feature_high").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("reads").alias("total_reads"), F.max("reads").alias("max_reads"),
        F.bool_or("flag").alias("any_flag"), F.concat_ws("|", F.sort_array(F.collect_set("_way"))).alias("orientations"),
        F.concat_ws("|", F.sort_array(F.collect_set(F.when(F.trim("annotation") != "", F.trim("annotation"))))).alias("annotations"))


def burden(events: DataFrame, assayed: DataFrame) -> DataFrame:
    """Events per assayed entity, zero only there, flagged above q3 + 1.5 IQR."""
    counts = events.groupBy("entity").agg(F.count(F.lit(1)).alias("n_events"))
    rows = assayed.select("entity").distinct().join(counts, "entity", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    q = percentiles(rows, [], "n_events", {"q1": 0.25, "q3": 0.75})
    limit = q.select(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).scalar()
    return rows.withColumn("review", F.col("n_events") > limit)


def iqr_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier flag per metric by the 1.5 IQR rule, and the number of flags."""
    long = df.select("entity", *columns).unpivot(["entity"], columns, "metric", "value").where("value is not null")
    q = percentiles(long, ["metric"], "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    flagged = long.join(q.drop("n"), "metric").select("entity", "metric", out.alias("outlier"))
    return flagged.groupBy("entity").agg(
        *[F.coalesce(F.bool_or(F.when(F.col("metric") == c, F.col("outlier"))), F.lit(False)).alias(f"{c}_outlier") for c in columns],
        F.count(F.when(F.col("outlier"), 1)).alias("n_flags"))


def recurrence(events: DataFrame, assayed: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Altered entities per feature (and group), as a share of the assayed ones.

    (entity, feature) is made distinct first, so a hot feature is counted, not shuffled whole.
    """
    cells = events.select("entity", "feature").distinct().join(assayed.select("entity").distinct(), "entity", "left_semi")
    if groups is None:
        total = assayed.select("entity").distinct().agg(F.count(F.lit(1)).alias("t")).scalar()
        out = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n_altered")).withColumn("n_assayed", total)
    else:
        label = groups.select("entity", "grp")
        sizes = assayed.select("entity").distinct().join(label, "entity").groupBy("grp").agg(F.count(F.lit(1)).alias("n_assayed"))
        out = cells.join(label, "entity").groupBy("grp", "feature").agg(F.count(F.lit(1)).alias("n_altered")).join(sizes, "grp")
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("n_altered") / F.col("n_assayed"), 6))


def definition_counts(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Altered entities and features under several event rules: flags per cell, then counts."""
    cells = events.groupBy("entity", "feature").agg(*[F.bool_or(rule).alias(name) for name, rule in rules.items()])
    per = cells.groupBy("entity").agg(*[F.bool_or(n).alias(n) for n in rules], *[F.count(F.when(F.col(n), 1)).alias(f"c_{n}") for n in rules])
    out = per.agg(*[F.count(F.when(F.col(n), 1)).alias(f"e_{n}") for n in rules], *[F.sum(f"c_{n}").alias(f"s_{n}") for n in rules])
    return out.select(F.inline(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(f"e_{n}").alias("n_entities"), F.col(f"s_{n}").alias("n_cells")) for n in rules])))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts with margins, marked by grouping level (0 cell, 1 row, 2 column, 3 total)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def sample_skewness(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, distinct, centre and spread of each numeric column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_id", F.lit(0)).unpivot(["_id"], columns, "column_name", "value")
    base = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), sample_skewness("value").alias("skew"))
    distinct = long.where("value is not null").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    middle = percentiles(long, ["column_name"], "value", {"median": 0.5}).drop("n")
    return base.join(distinct, "column_name", "left").join(middle, "column_name", "left").withColumn(
        "missing_pct", F.round(F.lit(100.0) * F.col("n_missing") / F.col("n_rows"), 6))


def top_variable(layer: DataFrame, k: int) -> DataFrame:
    return layer.groupBy("feature").agg(F.count("value").alias("n"), F.round(F.stddev_samp("value"), 9).alias("sd")).orderBy(F.desc("sd"), "feature").limit(k)


def rate_by_decile(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Flag rate in equal-frequency bins; bins are closed on the right and equal edges merge."""
    probs = {f"e{i}": i / 10.0 for i in range(1, 10)}
    edges = percentiles(df, [], value, probs).select(F.array_distinct(F.array(*[F.round(e, 9) for e in probs]))).scalar()
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.col(flag).alias("_f"), edges.alias("_edges"))
    binned = rows.select(F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("bin"), "_f", "_v")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"), F.round(F.avg(F.col("_f").cast("double")), 9).alias("rate"))


def feature_by_subgroup(layer: DataFrame, entities: DataFrame, feature: str, min_n: int) -> DataFrame:
    """Box statistics of one feature per subgroup, with unmeasured subgroups kept."""
    totals = entities.where("subgroup is not null").groupBy("subgroup").agg(F.count(F.lit(1)).alias("n_entities"))
    measured = layer.where(F.col("feature") == feature).join(entities.select("entity", "subgroup"), "entity")
    stats = percentiles(measured.where("subgroup is not null"), ["subgroup"], "value", {"iqr_low": 0.25, "median": 0.5, "iqr_high": 0.75}).withColumnRenamed("n", "n_measured")
    out = totals.join(stats, "subgroup", "left").withColumn("n_measured", F.coalesce("n_measured", F.lit(0)))
    return out.withColumn("flagged", F.col("n_measured") < min_n).orderBy(F.desc("n_measured"), "subgroup")


def group_subgroup_counts(entities: DataFrame, group: str | None = None) -> DataFrame:
    scoped = entities if group is None else entities.where(F.col("grp") == group)
    return scoped.where("grp is not null and subgroup is not null").groupBy("grp", "subgroup").agg(F.count(F.lit(1)).alias("n"))


def feature_points(layer: DataFrame, entities: DataFrame, feature: str, limit: int) -> DataFrame:
    """The first points of one feature with entity labels; `n_measured` counts all of them."""
    rows = layer.where(F.col("feature") == feature)
    total = rows.agg(F.count(F.lit(1)).alias("t")).scalar()
    first = rows.orderBy("entity").limit(limit).join(entities.select("entity", "name", "grp"), "entity", "left")
    return first.withColumn("n_measured", total)


def group_medians(layer: DataFrame, entities: DataFrame, min_n: int) -> DataFrame:
    """The cells of a heat table: the median of each feature in each group with enough rows."""
    known = entities.where("grp is not null").select("entity", "grp")
    return percentiles(layer.join(known, "entity"), ["feature", "grp"], "value", {"m": 0.5}).where(F.col("n") >= min_n).select("feature", "grp", "m")


def shape_stats(layer: DataFrame) -> DataFrame:
    """Bias-corrected skewness and kurtosis per feature, and the 99th percentile tail cap."""
    caps = percentiles(layer, ["feature"], "value", {"cap": 0.99}).drop("n")
    shape = layer.groupBy("feature").agg(F.count("value").alias("n"), sample_skewness("value").alias("skew"), sample_kurtosis("value").alias("kurt"))
    clipped = layer.join(caps, "feature").groupBy("feature").agg(F.max("cap").alias("cap"), F.avg(F.least("value", "cap")).alias("clipped_mean"))
    return shape.join(clipped, "feature")


def mirror_audit(events: DataFrame) -> DataFrame:
    """How many directed event rows have their mirror row in the same entity."""
    keyed = events.where("partner is not null").groupBy("entity", "feature", "partner").agg(F.count(F.lit(1)).alias("k"))
    mirror = keyed.select("entity", F.col("partner").alias("feature"), F.col("feature").alias("partner"), F.col("k").alias("mk"))
    both = keyed.join(mirror, ["entity", "feature", "partner"], "left")
    return both.agg(F.sum("k").alias("n_directed"), F.sum(F.when(F.col("mk").isNotNull(), F.col("k"))).alias("n_mirrored"),
                    F.count(F.when(F.col("k") == F.col("mk"), 1)).alias("n_equal_keys"), F.count(F.when(F.col("feature") == F.col("partner"), 1)).alias("n_self_keys"))


def top_rows(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """First k rows per key; Spark cuts each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

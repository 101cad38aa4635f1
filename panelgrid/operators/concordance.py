"""Concordance of sources and layers, per entity and per feature."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.functions.distribution import (
    group_residual, guarded_corr, medians, percentiles, rank_biserial, spearman,
)
from panelgrid.operators.relations import DIGITS, MIN_TOTAL, threshold_context
from panelgrid.session import small_frame, stage
from panelgrid.sources.tables import union_all


def entity_concordance(a: DataFrame, b: DataFrame, min_features: int = 30) -> DataFrame:
    """Spearman of two sources over the features an entity has in both; repeats are averaged first.

    After averaging, an entity has one row per feature, so its group is bounded by the features.
    """
    x = a.groupBy("entity", "feature").agg(F.avg("value").alias("x"))
    y = b.groupBy("entity", "feature").agg(F.avg("value").alias("y"))
    rho = spearman(x.join(y, ["entity", "feature"]), ["entity"], "x", "y", bounded=True)
    return rho.where(F.col("n") >= min_features).select("entity", F.round("rho", 8).alias("rho"), F.col("n").alias("n_features"))


def summarise_rho(scored: DataFrame, n_overlap: Column) -> DataFrame:
    q = percentiles(scored.where("rho is not null"), [], "rho", {"iqr_low": 0.25, "median_rho": 0.5, "iqr_high": 0.75}).withColumnRenamed("n", "n_scored")
    return q.select("n_scored", *[F.round(c, 4).alias(c) for c in ("median_rho", "iqr_low", "iqr_high")]).withColumn("n_overlap", n_overlap)


def rho_by_group(scored: DataFrame, entities: DataFrame, min_n: int = 30) -> DataFrame:
    rows = scored.where("rho is not null").join(entities.where("grp is not null").select("entity", "grp"), "entity")
    return medians(rows, ["grp"], "rho", "median_rho").where(F.col("n") >= min_n).withColumn("median_rho", F.round("median_rho", DIGITS))


def detection_gap(rows: DataFrame, value: str, detected: str) -> DataFrame:
    """Medians of detected and undetected rows, U statistic and common-language effect size."""
    one = rows.withColumn("_k", F.lit(1))
    m = percentiles(one, ["_k", detected], value, {"m": 0.5})
    mid = m.groupBy("_k").agg(F.max(F.when(F.col(detected), F.col("m"))).alias("median_detected"), F.max(F.when(~F.col(detected), F.col("m"))).alias("median_undetected"))
    u = rank_biserial(one, ["_k"], value, detected)
    return mid.join(u, "_k").select(F.col("n_first").alias("n_detected"), F.col("n_second").alias("n_undetected"), F.round("median_detected", DIGITS).alias("median_detected"), F.round("median_undetected", DIGITS).alias("median_undetected"),
                                    F.col("u"), F.round((F.col("rank_biserial") + 1) / 2, 8).alias("effect_size"))


def layer_correlation(rows: DataFrame, x: str, y: str, min_group: int = 15) -> DataFrame:
    """Per feature the raw and group-adjusted rank correlation of two layers. ``rows``: entity, feature, grp, x, y."""
    both = stage(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("entity", "feature", "grp", F.col(x).alias("x"), F.col(y).alias("y")), "layers")
    raw = spearman(both, ["feature"], "x", "y", "raw")
    adj = spearman(stage(group_residual(both, ["feature", "grp"], ["x", "y"], min_group), "adjusted"), ["feature"], "x_adj", "y_adj", "adj").withColumnRenamed("n", "n_adjusted")
    out = raw.join(adj, "feature", "left")
    return out.select("feature", "n", F.when(F.col("n") >= 3, F.round("raw", 8)).alias("rho"), F.coalesce("n_adjusted", F.lit(0)).alias("n_adjusted"), F.when(F.col("n_adjusted") >= MIN_TOTAL, F.round("adj", 8)).alias("adjusted_rho"))


def chain_consistency(rows: DataFrame, a: str, b: str, c: str, min_n: int = 30) -> DataFrame:
    """Three rank correlations per feature over rows with all three layers; consistent if a-b and b-c are positive."""
    full = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull())
    links = F.array(*[F.struct(F.lit(name).alias("link"), F.col(x).alias("x"), F.col(y).alias("y")) for name, x, y in (("ab", a, b), ("bc", b, c), ("ac", a, c))])
    rho = spearman(full.select("feature", F.inline(links)), ["feature", "link"], "x", "y")
    wide = rho.where(F.col("n") >= min_n).groupBy("feature").agg(F.max("n").alias("n"), *[F.round(F.max(F.when(F.col("link") == k, F.col("rho"))), 8).alias(f"rho_{k}") for k in ("ab", "bc", "ac")])
    return wide.withColumn("consistent", (F.col("rho_ab") > 0) & (F.col("rho_bc") > 0))


def event_effect(values: DataFrame, events: DataFrame, definitions: dict[str, Column], assayed: DataFrame) -> DataFrame:
    """Effect of an event on a value, per feature and event definition, among assayed entities."""
    flags = events.groupBy("entity", "feature").agg(*[F.bool_or(c).alias(n) for n, c in definitions.items()])
    rows = values.join(assayed.select("entity").distinct(), "entity", "left_semi").join(flags, ["entity", "feature"], "left")
    cells = F.array(*[F.struct(F.lit(n).alias("definition"), F.coalesce(F.col(n), F.lit(False)).alias("altered")) for n in definitions])
    long = stage(rows.select("feature", "value", F.inline(cells)), "event_effect")
    keys = ["feature", "definition"]
    m = percentiles(long, [*keys, "altered"], "value", {"m": 0.5}).groupBy(*keys).agg(F.max(F.when(F.col("altered"), F.col("m"))).alias("a"), F.max(F.when(~F.col("altered"), F.col("m"))).alias("r"))
    out = m.join(rank_biserial(long, keys, "value", "altered"), keys)
    return out.select(*keys, F.col("n_first").alias("n_altered"), F.col("n_second").alias("n_reference"), F.round(F.col("a") - F.col("r"), DIGITS).alias("median_difference"), F.round("rank_biserial", 8).alias("rank_biserial"))


def value_by_state(rows: DataFrame, x: str, value: str, low: float, high: float) -> DataFrame:
    """Median of a value by threshold state of another, per feature."""
    tagged = rows.where(F.col(x).isNotNull() & F.col(value).isNotNull()).withColumn("state", threshold_context(F.col(x), low, high))
    return medians(tagged, ["feature", "state"], value, "median_value").withColumn("median_value", F.round("median_value", DIGITS))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of column pairs over complete rows of each pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.inline(cells)).where("x is not null and y is not null")
    return long.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(guarded_corr("x", "y"), 8).alias("r"))


def pca(layer: DataFrame, features: list[str] | None = None, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores, loadings) of the principal components of an entity x feature layer; signs are arbitrary.

    Features are those asked for (else all); one that any entity lacks is left out, as a component needs full columns.
    Columns are centred, not scaled. ``loadings`` has component, feature, loading and the explained share of variance.
    """
    cells = layer.where("value is not null").groupBy("entity", "feature").agg(F.avg("value").alias("value"))
    wanted = cells if features is None else cells.where(F.col("feature").isin(features))
    n = cells.select("entity").distinct().agg(F.count(F.lit(1))).scalar()
    names = [r.feature for r in wanted.groupBy("feature").count().where(F.col("count") == n).orderBy("feature").collect()]  # the catalogue of features
    if len(names) < k:
        raise ValueError(f"{len(names)} features are complete; {k} components need as many")
    wide = cells.where(F.col("feature").isin(names)).groupBy("entity").pivot("feature", names).agg(F.first("value"))
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(wide)
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    scores = model.transform(centred).select("entity", vector_to_array("pc").alias("_pc")).select("entity", *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])
    weights, shares = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(i + 1, f, float(weights[j, i]), float(shares[i])) for i in range(k) for j, f in enumerate(names)]
    return scores, small_frame(layer.sparkSession, rows, "component int, feature string, loading double, explained double")


def overlap_spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation of two sources over all shared (entity, feature) cells."""
    rows = a.select("entity", "feature", F.col("value").alias("x")).join(b.select("entity", "feature", F.col("value").alias("y")), ["entity", "feature"]).withColumn("_k", F.lit(1))
    return spearman(rows, ["_k"], "x", "y").select("n", F.round("rho", 8).alias("rho"))


def feature_all_layers(layers: dict[str, tuple[DataFrame, str]], feature: str) -> DataFrame:
    """(layer, unit, entity, value) of one feature across layers."""
    return union_all([df.where(F.col("feature") == feature).select(F.lit(name).alias("layer"), F.lit(unit).alias("unit"), "entity", "value") for name, (df, unit) in layers.items()])

"""Panel scoring: one lazy plan from candidates to ranked buckets.

The grid is (scenario, query, entity, panel feature). Evidence and constants are joined to it,
every layer value becomes a desirability column, and one grouping per entity gives the score.
Panels and scenarios are requests: short literal lists that are exploded, never joined blindly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.columns import flip_role, ramp
from panelgrid.functions.distribution import in_ranges, percentiles, spearman, spearman_in_ranges, split_points
from panelgrid.operators import calibrate as cal
from panelgrid.operators.identity import resolve_strict
from panelgrid.operators.reshape import filter_candidates
from panelgrid.operators.runs import Request
from panelgrid.session import small_frame, stage

# Layer weights, in fifteenths, and the order in which layers are added up.
LAYER_WEIGHTS = {"rna": 4 / 15, "protein": 2 / 15, "dependency": 4 / 15, "copy_number": 2 / 15, "mutation": 2 / 15, "fusion": 1 / 15}
LAYERS = list(LAYER_WEIGHTS)
# Scores are rounded before they are compared, so equal scores stay equal on any partitioning.
SCORE_DIGITS = 10
SPREAD_ROWS = 500_000  # rows of a task after they are spread; its groups are then aggregated in memory

# Fixed values: (event category, class, desirability as inclusion, as exclusion).
EVENT_TABLE = [
    ("driver_hotspot", "oncogene", 1.0, 0.0), ("driver_hotspot", "tumour_suppressor", 1.0, 0.0),
    ("high_lof", "oncogene", 0.0, 1.0), ("high_lof", "tumour_suppressor", 1.0, 0.0),
    ("moderate_vus", "oncogene", 0.5, 0.5), ("moderate_vus", "tumour_suppressor", 0.5, 0.5),
    ("low_or_modifier", "oncogene", 1.0, 1.0), ("low_or_modifier", "tumour_suppressor", 1.0, 1.0),
    ("none_sequenced_clean", "oncogene", 1.0, 1.0), ("none_sequenced_clean", "tumour_suppressor", 1.0, 1.0),
]
# Weight factor by number of supporting marks (high confidence, in frame).
PRESENCE_FACTORS = {2: 1.0, 1: 0.5, 0: 0.25}


@dataclass(frozen=True)
class Panel:
    """A query: features wanted present, features wanted absent, and an optional group."""

    query_id: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    group: str | None = None

    @property
    def items(self) -> list[tuple[str, str]]:
        return [(f, "inclusion") for f in self.include] + [(f, "exclusion") for f in self.exclude]

    @property
    def features(self) -> list[str]:
        return [*self.include, *self.exclude]


@dataclass(frozen=True)
class Scenario:
    """Layer weights and thresholds of one scoring run."""

    scenario_id: str = "default"
    weights: dict = field(default_factory=lambda: dict(LAYER_WEIGHTS))
    min_group_n: int = 15
    min_calibration_n: int = 30
    insufficient_fraction: float = 0.5
    fraction_threshold: float = 0.8
    strong_cutoff: float = -1.0
    broad_fraction: float = 0.90
    high_min_layers: int = 3
    moderate_min_layers: int = 2


def validate_query(panel: Panel, ploidy_min: float | None = None, ploidy_max: float | None = None, top_k: int = 10) -> None:
    """A request needs an inclusion, disjoint roles, an ordered ploidy range and 1 to 100 results."""
    if not panel.include:
        raise ValueError("at least one inclusion feature is required")
    both = sorted(set(panel.include) & set(panel.exclude))
    if both:
        raise ValueError(f"features cannot be both included and excluded: {both}")
    if ploidy_min is not None and ploidy_max is not None and ploidy_min > ploidy_max:
        raise ValueError("ploidy_min must not exceed ploidy_max")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be between 1 and 100")


def panel_features(panels: list[Panel]) -> list[str]:
    return sorted({f for p in panels for f in p.features})


def candidate_grid(candidates: DataFrame, panels: list[Panel]) -> DataFrame:
    """One row per query, candidate and panel feature."""
    items = F.array(*[
        F.struct(F.lit(p.query_id).alias("query_id"), F.lit(p.group).cast("string").alias("want"), F.lit(i).alias("ordinal"),
                 F.lit(feature).alias("feature"), F.lit(role).alias("role"))
        for p in panels for i, (feature, role) in enumerate(p.items)])
    return candidates.select("*", F.inline(items)).where("want is null or want = grp").drop("want")


def spread_scenarios(rows: DataFrame, scenarios: list[Scenario] | None = None) -> DataFrame:
    """Each row once per scenario, with its weights and thresholds; evidence is joined before, so it is read once."""
    runs = F.array(*[
        F.struct(
            F.lit(s.scenario_id).alias("scenario_id"),
            F.struct(*[F.lit(float(s.weights.get(layer, 0.0))).alias(layer) for layer in LAYERS]).alias("w"),
            F.lit(s.min_group_n).alias("min_group_n"), F.lit(s.min_calibration_n).alias("min_calibration_n"),
            F.lit(float(s.insufficient_fraction)).alias("insufficient_fraction"), F.lit(float(s.fraction_threshold)).alias("fraction_threshold"),
            F.lit(s.high_min_layers).alias("high_min"), F.lit(s.moderate_min_layers).alias("moderate_min"))
        for s in (scenarios or [Scenario()])])
    out = rows.select("*", F.inline(runs))
    if "only_scenario" in out.columns:
        out = out.where("only_scenario = scenario_id").drop("only_scenario")
    return out


def classify_events(events: DataFrame) -> DataFrame:
    """Per (entity, feature): the severity flags of its variant rows, collapsed before any join."""
    return events.groupBy("entity", "feature").agg(
        F.bool_or(F.col("is_driver") | F.col("is_hotspot")).alias("any_driver"),
        F.bool_or(F.col("impact") == "HIGH").alias("any_high"), F.bool_or(F.col("impact") == "MODERATE").alias("any_moderate"))


def event_category(assayed: Column) -> Column:
    return (F.when(~assayed, "no_sequencing").when(F.col("any_driver").isNull(), "none_sequenced_clean").when(F.col("any_driver"), "driver_hotspot")
            .when(F.col("any_high"), "high_lof").when(F.col("any_moderate"), "moderate_vus").otherwise("low_or_modifier"))


def score_events(category: Column, role: Column, gene_class: Column) -> Column:
    """Desirability of a variant category; null for an unknown class or an unsequenced entity."""
    out = F.lit(None).cast("double")
    for cat, cls, wanted, unwanted in EVENT_TABLE:
        out = F.when((category == cat) & (gene_class == cls), F.when(role == "inclusion", wanted).otherwise(unwanted)).otherwise(out)
    return out


def summarise_presence(fusions: DataFrame) -> DataFrame:
    return fusions.groupBy("entity", "feature").agg(
        F.count(F.lit(1)).alias("n_fusions"), F.bool_or("confidence_high").alias("any_confident"), F.bool_or("in_frame").alias("any_in_frame"))


def score_presence(state: Column, role: Column) -> tuple[Column, Column]:
    """(desirability, weight factor) of a pair-event layer from its state."""
    d = F.when(state == "measured", F.when(role == "inclusion", 1.0).otherwise(0.0)).when(state == "measured_absent", F.when(role == "inclusion", 0.0).otherwise(1.0))
    marks = F.col("any_confident").cast("int") + F.col("any_in_frame").cast("int")
    factor = F.lit(1.0)
    for n, value in PRESENCE_FACTORS.items():
        factor = F.when((state == "measured") & (marks == n), F.lit(value)).otherwise(factor)
    return d, factor


def layer_constants(measures: DataFrame) -> DataFrame:
    """Per feature the global constants of every calibrated layer: g (rna), e (effect), c (copies), each with L, T and n."""
    long = measures.select("feature", F.col("rna").alias("g"), (-F.col("effect")).alias("e"), F.col("copy_number").alias("c")).unpivot(["feature"], ["g", "e", "c"], "kind", "value")
    kept = cal.gate(cal.calibrate(long, ["feature", "kind"]))
    return kept.groupBy("feature").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("g", "e", "c") for c in ("L", "T", "n")])


def build_constants(measures: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The calibration tables, which depend on the measures only; a build stores them and requests read them."""
    return {"layers": layer_constants(measures), "groups": group_constants(measures, entities), "protein": protein_constants(measures)}


def feature_constants(measures: DataFrame, roles: DataFrame, features: list[str], scenarios: list[Scenario] | None = None, layers: DataFrame | None = None) -> DataFrame:
    """Per (scenario, feature): global constants (stored ones if given), broad fraction and role class.

    Only rows of the panel features are read, so this costs a few features, not the whole table.
    """
    scenarios = scenarios or [Scenario()]
    rows = measures.where(F.col("feature").isin(features))
    wide = layer_constants(rows) if layers is None else layers.where(F.col("feature").isin(features))
    settings = [(s.scenario_id, s.strong_cutoff, s.broad_fraction, s.min_calibration_n) for s in scenarios]
    broad = cal.flag_broad_many(rows.select("feature", F.col("effect").alias("value")).where("value is not null"), settings).select(
        F.col("sample_id").alias("scenario_id"), "feature", F.col("fraction").alias("broad_fraction"))
    runs = [(s.scenario_id, f) for s in scenarios for f in features]
    base = small_frame(measures.sparkSession, runs, "scenario_id string, feature string")
    out = base.join(wide, "feature", "left")
    return out.join(broad, ["scenario_id", "feature"], "left").join(roles.select("feature", "gene_class"), "feature", "left")


def rename_constants(df: DataFrame, prefix: str, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    return df.select(*keys, F.col("L").alias(f"{prefix}_L"), F.col("T").alias(f"{prefix}_T"), F.col("n").alias(f"{prefix}_n"))


def group_constants(measures: DataFrame, entities: DataFrame, features: list[str] | None = None) -> DataFrame:
    rows = (measures if features is None else measures.where(F.col("feature").isin(features))).select("entity", "feature", F.col("rna").alias("value"))
    return rename_constants(cal.gate(cal.calibrate_group(rows, entities)), "l", ("grp", "feature"))


def protein_constants(measures: DataFrame) -> DataFrame:
    """One row (p_L, p_T) pooled over detected values of all features."""
    pooled = percentiles(measures.where("detected"), [], "zscore", {"L": 0.1, "T": 0.9})
    return pooled.select(F.round("L", 4).alias("p_L"), F.round("T", 4).alias("p_T"))


def spread_parts(entities: DataFrame, panels: list[Panel], scenarios: list[Scenario] | None) -> int:
    """Parts to deal entities to, so that each holds about `SPREAD_ROWS` rows once these are spread over features and scenarios."""
    rows = entities.count() * sum(len(p.items) for p in panels) * len(scenarios or [Scenario()])
    return max(entities.sparkSession.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS))


def gather_evidence(candidates: DataFrame, measures: DataFrame, mutations: DataFrame, fusions: DataFrame, features: list[str], parts: int) -> DataFrame:
    """Candidates with the panel cells of every layer as lists. Every side is dealt once, by entity; a list is bounded by the panels' features."""
    wanted = F.col("feature").isin(features)
    out = candidates.repartition(parts, "entity")
    for name, layer, collapse in (("_cells", measures, None), ("_variants", mutations, classify_events), ("_presence", fusions, summarise_presence)):
        rows = layer.where(wanted).repartition(parts, "entity")
        rows = collapse(rows) if collapse else rows
        lists = rows.groupBy("entity").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "entity"))).alias(name))
        out = out.join(lists, "entity", "left")
    return out


def pick_evidence(grid: DataFrame) -> DataFrame:
    """The cells of a grid row's feature as columns; a row stays where there are none, and is repeated for repeated cells."""
    rest = [c for c in grid.columns if c not in ("_cells", "_variants", "_presence")]
    own = lambda name: F.filter(name, lambda x: x["feature"] == F.col("feature"))
    fields = lambda name: [f.name for f in grid.schema[name].dataType.elementType.fields if f.name != "feature"]
    rows = grid.select(*rest, F.explode_outer(own("_cells")).alias("_cell"), F.get(own("_variants"), F.lit(0)).alias("_variant"), F.get(own("_presence"), F.lit(0)).alias("_present"))
    return rows.select(*rest, *(F.col(at)[f].alias(f) for name, at in (("_cells", "_cell"), ("_variants", "_variant"), ("_presence", "_present")) for f in fields(name)))


def score_layers(rows: DataFrame) -> DataFrame:
    """Desirability, state and weight per layer as columns, and the feature score `d_gene`."""
    role, cls = F.col("role"), F.coalesce("gene_class", F.lit("unknown"))
    own = F.col("l_n") >= F.col("min_group_n")
    low = F.when(own, F.col("l_L")).otherwise(F.col("g_L"))
    high = F.when(own, F.col("l_T")).otherwise(F.col("g_T"))
    broad = F.col("broad_fraction").isNotNull()
    category = event_category(F.coalesce(F.col("mutations_state"), F.lit("not_assayed")) != "not_assayed")
    fusion_state = (F.when(F.coalesce(F.col("fusions_state"), F.lit("not_assayed")) == "not_assayed", "not_assayed")
                    .when(F.col("n_fusions") > 0, "measured").otherwise("measured_absent"))
    d_fusion, factor = score_presence(fusion_state, role)
    enough_e = F.col("e_n") >= F.col("min_calibration_n")
    enough_c = F.col("c_n") >= F.col("min_calibration_n")
    copy_role = F.when(cls == "oncogene", role).otherwise(flip_role(role))
    out = rows.withColumns({
        "gene_class": cls,
        "d_rna": ramp(F.col("rna"), low, high, role),
        "d_protein": F.when(F.col("detected"), ramp(F.col("zscore"), F.col("p_L"), F.col("p_T"), role)),
        "d_dependency": F.when(~broad & enough_e, ramp(-F.col("effect"), F.col("e_L"), F.col("e_T"), role)),
        "d_copy_number": F.when((cls != "unknown") & enough_c, ramp(F.col("copy_number"), F.col("c_L"), F.col("c_T"), copy_role)),
        "mutation_category": category,
        "d_mutation": score_events(category, role, cls),
        "d_fusion": d_fusion,
        "fusion_state": fusion_state,
        "s_rna": F.when(F.col("rna").isNotNull(), "measured").otherwise("not_assayed"),
        "s_protein": F.when(F.col("zscore").isNull(), "not_assayed").when(F.col("detected"), "measured").otherwise("non_detected"),
        "s_dependency": F.when(F.col("effect").isNull(), "not_assayed").when(broad, "excluded_pan_essential").otherwise("measured"),
        "s_copy_number": F.when(F.col("copy_number").isNotNull(), "measured").otherwise("not_assayed"),
        "s_mutation": F.when(category == "no_sequencing", "not_assayed").when(category == "none_sequenced_clean", "measured_absent").otherwise("measured"),
        "w_fusion": F.when(fusion_state == "measured", F.lit(LAYER_WEIGHTS["fusion"]) * factor)
        .when((role == "exclusion") & (fusion_state == "measured_absent"), 0.0).otherwise(F.col("w.fusion")),
    }).withColumnRenamed("fusion_state", "s_fusion")
    return out.withColumn("d_gene", combine_layers({layer: F.col(f"d_{layer}") for layer in LAYERS}, {
        layer: F.col("w_fusion") if layer == "fusion" else F.col(f"w.{layer}") for layer in LAYERS}))


def combine_layers(d: dict[str, Column], w: dict[str, Column]) -> Column:
    """Weighted mean over present layers; null when none is present or they weigh nothing."""
    top = bottom = F.lit(0.0)
    for layer in LAYERS:
        top = top + F.coalesce(w[layer] * d[layer], F.lit(0.0))
        bottom = bottom + F.when(d[layer].isNotNull(), w[layer]).otherwise(0.0)
    return F.when(bottom > 0, F.try_divide(top, bottom))


def n_layers() -> Column:
    return sum((F.col(f"d_{layer}").isNotNull().cast("int") for layer in LAYERS), F.lit(0))


def panel_pairs(panels: list[Panel]) -> list[tuple[str, str]]:
    return sorted({(a, b) for p in panels for a in p.features for b in p.features if a < b})


def pair_spearman(layer: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, n, rho) of requested feature pairs over all entities.

    The few panel features become columns of one entity row; each requested pair is read off it. A feature is cut into ranges of values
    once, and the ranks in all its pairs are counts of these ranges, so no pair's entities meet in one task.
    """
    features = sorted({f for pair in pairs for f in pair})
    rows = layer.where(F.col("feature").isin(features))
    points = split_points(rows, ["feature"], "value")
    cells = rows.select("entity", "feature", "value").repartition("entity").groupBy("entity", "feature").agg(F.avg("value").alias("value"))
    cells = in_ranges(cells, points, ["feature"], "value", "at")
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))  # noqa: E731  a cell has one value
    wide = cells.groupBy("entity").agg(*[pick(f, c).alias(f"{f} {c}") for f in features for c in ("value", "at")])
    wide = wide.select("entity", *[F.struct(*(F.col(f"`{f} {c}`").alias(c) for c in ("value", "at"))).alias(f) for f in features])
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f)[k].alias(n) for f, names in ((a, ("x", "xr")), (b, ("y", "yr"))) for k, n in zip(("value", "at"), names))) for a, b in pairs])
    rows = stage(wide.select(F.inline(both)).where("x is not null and y is not null"), "panel-pairs")
    return spearman_in_ranges(rows, ["a", "b"], ("x", "xr"), ("y", "yr"))


def correlation_weights(layer: DataFrame, panels: list[Panel]) -> DataFrame:
    """(query_id, feature, rho_bar, weight): features that repeat each other count for less.

    A feature without any estimable correlation keeps weight 1 and a null rho_bar.
    """
    spark = layer.sparkSession
    asked = small_frame(spark, [(p.query_id, f, len(p.features)) for p in panels for f in p.features], "query_id string, feature string, m int")
    pairs = panel_pairs(panels)
    if not pairs:
        return asked.select("query_id", "feature", F.lit(None).cast("double").alias("rho_bar"), F.lit(1.0).alias("weight"))
    rho = pair_spearman(layer, pairs)
    sides = rho.select(F.col("a").alias("feature"), F.col("b").alias("other"), "rho").unionByName(rho.select(F.col("b").alias("feature"), F.col("a").alias("other"), "rho"))
    links = small_frame(spark, [(p.query_id, f, g) for p in panels for f in p.features for g in p.features if f != g], "query_id string, feature string, other string")
    mean = links.join(sides, ["feature", "other"]).groupBy("query_id", "feature").agg(F.avg("rho").alias("_mean"))
    out = asked.join(mean, ["query_id", "feature"], "left").withColumn("rho_bar", F.greatest(F.col("_mean"), F.lit(0.0)))
    out = out.withColumn("rho_bar", F.when(F.col("_mean").isNotNull(), F.col("rho_bar")))
    return out.select("query_id", "feature", "rho_bar", F.coalesce(1.0 / (1.0 + (F.col("m") - 1) * F.col("rho_bar")), F.lit(1.0)).alias("weight"))


def corroboration(value: str) -> Column:
    """Whether a second source agrees on presence wherever both have a value; null if nowhere."""
    shared = F.col("d_rna").isNotNull() & F.col(value).isNotNull()
    agree = F.coalesce((F.col("rna") >= F.col("g_L")) == (F.col(value) > 0), F.lit(True))
    return F.when(F.count(F.when(shared, 1)) > 0, F.bool_and(F.when(shared, agree)))


def confidence_tier() -> Column:
    """Tier over the grouped columns of `combine_features`."""
    high = F.try_divide(F.col("n_high").cast("double"), F.col("n_scored"))
    moderate = F.try_divide(F.col("n_moderate").cast("double"), F.col("n_scored"))
    return (F.when((F.col("abstained") >= F.col("insufficient_fraction")) | (F.col("n_scored") == 0), "Insufficient")
            .when((high >= F.col("fraction_threshold")) & F.coalesce("hpa_agreement", F.lit(True)), "High")
            .when(moderate >= F.col("fraction_threshold"), "Moderate").otherwise("Low"))


KEYS = ["scenario_id", "query_id", "entity"]


def veto_names(panels: list[Panel]) -> Column:
    """The (feature, role) of the veto's ordinal, read off the request."""
    items = [x for p in panels for x in (F.lit(p.query_id), F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("role")) for f, r in p.items]))]
    return F.get(F.element_at(F.create_map(*items), F.col("query_id")), F.col("_at"))


@dataclass(frozen=True)
class Evidence:
    """A scored grid that is not spread over features and scenarios: a row per candidate, its panel cells as lists, and what is asked."""

    rows: DataFrame
    panels: list[Panel]
    scenarios: list[Scenario]
    constants: DataFrame
    weights: DataFrame
    pooled: DataFrame


def combine_runs(evidence: Evidence, best: int | None = None) -> DataFrame:
    """The sums of `combine_features` for all scenarios in one pass over the candidates.

    An entity's candidates are brought together and worked on as arrays. Constants and weights have a row for each panel feature (and scenario)
    and go along with the request. With ``best`` a task leaves out entities that at least that many of its own come before in `partition_results`.
    """
    panels, runs = [p for p in evidence.panels if p.items], evidence.scenarios
    features = panel_features(panels)
    at = {s.scenario_id: i for i, s in enumerate(runs)}
    constants: list[dict[int, list]] = [{} for _ in runs]
    for r in evidence.constants.collect():
        if r["scenario_id"] in at and r["feature"] in features:
            constants[at[r["scenario_id"]]].setdefault(features.index(r["feature"]), []).append(r.asDict())
    weights, sizes = {}, {}
    for r in evidence.weights.collect():
        weights.setdefault((r["query_id"], r["feature"]), []).append(r["weight"])
        sizes[r["query_id"]] = r["m_eff"]
    pooled = evidence.pooled.select("p_L", "p_T").first() or (None, None)
    rules = {"layers": LAYERS, "events": EVENT_TABLE, "factors": PRESENCE_FACTORS, "fusion": LAYER_WEIGHTS["fusion"]}
    request = Request(panels, runs, features, constants, weights, tuple(pooled), rules)
    rows = evidence.rows.select("entity", "grp", "mutations_state", "fusions_state", "_cells", "_variants", "_presence", "_own").sortWithinPartitions("entity")
    entity = rows.schema["entity"].dataType.simpleString()
    schema = f"_scenario int, _query int, entity {entity}, n_scored long, n_high long, n_moderate long, abstained double, _at int, _log double, _sum double, hpa_agreement boolean, geo_agreement boolean"
    of = lambda index, values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(index))
    return rows.mapInArrow(request.run(best), schema).select(
        of("_scenario", [s.scenario_id for s in runs], "string").alias("scenario_id"), of("_query", [p.query_id for p in panels], "string").alias("query_id"), "entity",
        of("_scenario", [float(s.insufficient_fraction) for s in runs], "double").alias("insufficient_fraction"), of("_scenario", [float(s.fraction_threshold) for s in runs], "double").alias("fraction_threshold"),
        "n_scored", "n_high", "n_moderate", "abstained", "_at", F.col("_at").isNotNull().alias("_vetoed"), F.exp(F.try_divide("_log", "_sum")).alias("_mean"),
        of("_query", [sizes.get(p.query_id) for p in panels], "double").alias("m_eff"), "hpa_agreement", "geo_agreement")


def combine_features(scored: DataFrame | Evidence, panels: list[Panel] | None = None, best: int | None = None) -> DataFrame:
    """One row per scenario, query and entity: score `D`, veto, tier and agreement.

    With the ``panels`` (of different ids) of the grid a veto is aggregated as its ordinal, so all states but `grp`'s have a fixed width and groups are hashed,
    not sorted, where `grp` is not asked for. A grid that is not spread (`Evidence`) gives the same rows without `grp`; ``best`` says that
    only the first so many of each scenario and query are displayed and nothing else of it is read.
    """
    if isinstance(scored, Evidence):
        return finish_scores(combine_runs(scored, best).withColumn("_veto", veto_names(scored.panels)))
    d, w = F.col("d_gene"), F.coalesce("weight", F.lit(1.0))
    veto = (d == 0) & (w > 0)
    panels = [p for p in panels or [] if p.items]
    listed = panels and len({p.query_id for p in panels}) == len(panels)
    first = F.min(F.when(veto, F.col("ordinal"))).alias("_at") if listed else F.min_by(F.when(veto, F.struct("feature", "role")), F.when(veto, F.col("ordinal"))).alias("_veto")
    inclusion = F.col("role") == "inclusion"
    grouped = scored.groupBy(*KEYS).agg(
        F.any_value("grp").alias("grp"), F.any_value("insufficient_fraction").alias("insufficient_fraction"), F.any_value("fraction_threshold").alias("fraction_threshold"),
        F.count(d).alias("n_scored"),
        F.count(F.when(d.isNotNull() & (n_layers() >= F.col("high_min")), 1)).alias("n_high"),
        F.count(F.when(d.isNotNull() & (n_layers() >= F.col("moderate_min")), 1)).alias("n_moderate"),
        F.coalesce(F.avg(F.when(inclusion, d.isNull().cast("double"))), F.lit(1.0)).alias("abstained"),
        first,
        F.bool_or(F.coalesce(veto, F.lit(False))).alias("_vetoed"),
        F.exp(F.try_divide(F.sum(F.when(d > 0, w * F.ln(d))), F.sum(F.when(d.isNotNull(), w)))).alias("_mean"),
        F.any_value("m_eff").alias("m_eff"),
        corroboration("hpa").alias("hpa_agreement"), corroboration("geo").alias("geo_agreement"))
    if listed:
        grouped = grouped.withColumn("_veto", veto_names(panels))
    return finish_scores(grouped)


def finish_scores(grouped: DataFrame) -> DataFrame:
    """Score, tier and veto of the grouped columns."""
    score = F.when(F.col("n_scored") > 0, F.when(F.col("_vetoed"), 0.0).otherwise(F.round("_mean", SCORE_DIGITS)))
    reason = F.when(F.col("_veto.role") == "exclusion", "exclusion_expressed").when(F.col("_veto.role") == "inclusion", "inclusion_below_floor")
    return grouped.withColumn("D", score).withColumn("tier", confidence_tier()).select(
        *KEYS, *(["grp"] if "grp" in grouped.columns else []), "D", "tier", F.col("_veto.feature").alias("veto_feature"), reason.alias("veto_reason"),
        "hpa_agreement", "geo_agreement", F.col("n_scored").alias("m"), "m_eff", "abstained")


def score_features(
    candidates: DataFrame, measures: DataFrame, mutations: DataFrame, fusions: DataFrame, entities: DataFrame, roles: DataFrame,
    panels: list[Panel], scenarios: list[Scenario] | None = None, constants: DataFrame | None = None, stored: dict[str, DataFrame] | None = None, spread: bool = True,
) -> DataFrame | Evidence:
    """The scored grid: one row per scenario, query, candidate and panel feature.

    Without ``spread`` it is handed on as `Evidence` for `combine_features`, which needs no such rows; the panels then have different ids.

    ``candidates`` has entity, grp, mutations_state, fusions_state; ``measures`` is the wide cell
    table. A column `only_scenario` on candidates keeps a candidate row to one scenario.
    ``stored`` are the tables of `build_constants`, else they are built for the panel features.
    ``constants`` replaces the per-feature constants (for controls that change them). A
    column `cal_grp` on candidates replaces the group used for calibration only.
    """
    features = panel_features(panels)
    if "cal_grp" not in candidates.columns:
        candidates = candidates.withColumn("cal_grp", F.col("grp"))
    if constants is None:
        constants = feature_constants(measures, roles, features, scenarios, stored and stored["layers"])
    own = stored["groups"].where(F.col("feature").isin(features)) if stored else group_constants(measures, entities, features)
    own = own.withColumnRenamed("grp", "cal_grp")
    pooled = stored["protein"] if stored else protein_constants(measures)
    weights = correlation_weights(measures.select("entity", "feature", F.col("rna").alias("value")), panels)
    weights = weights.withColumn("m_eff", F.round(F.sum("weight").over(Window.partitionBy("query_id")), 9))
    # rows are dealt by entity once, before they are spread over features and scenarios, which serves the later grouping by scenario, query and
    # entity too; a group's constants come as one list, and weights and constants have a row for each panel feature (and scenario), so they are broadcast
    own = own.groupBy("cal_grp").agg(F.collect_list(F.struct("feature", "l_L", "l_T", "l_n")).alias("_own"))
    if not spread:
        rows = gather_evidence(candidates.join(own, "cal_grp", "left"), measures, mutations, fusions, features, spread_parts(entities, [Panel("", tuple(features))], None))
        return Evidence(rows, panels, scenarios or [Scenario()], constants, weights, pooled)
    parts = spread_parts(entities, panels, scenarios)
    rows = gather_evidence(candidates.join(own, "cal_grp", "left"), measures, mutations, fusions, features, parts)
    rows = pick_evidence(candidate_grid(rows, panels))
    rows = rows.withColumn("_o", F.get(F.filter("_own", lambda x: x["feature"] == F.col("feature")), F.lit(0)))
    rows = rows.withColumns({c: F.col("_o")[c] for c in ("l_L", "l_T", "l_n")}).drop("_o", "_own")
    rows = rows.join(F.broadcast(weights), ["query_id", "feature"], "left")
    rows = spread_scenarios(rows, scenarios).join(F.broadcast(constants), ["scenario_id", "feature"], "left")
    rows = rows.withColumn("_p", pooled.select(F.struct("p_L", "p_T")).scalar())
    return score_layers(rows.withColumns({"p_L": F.col("_p.p_L"), "p_T": F.col("_p.p_T")}).drop("_p"))


def partition_results(results: DataFrame, top_n: int = 10, shown_only: bool = False) -> DataFrame:
    """Bucket per row and the rank of the displayed ones; with ``shown_only`` these rows alone, for callers that read no other bucket.

    Only the best `top_n` of each query are ranked (Spark cuts every partition to that many before the shuffle) and joined back,
    so the results are read twice and therefore written once. The displayed rows alone need neither.
    """
    results = results if shown_only else stage(results, "results")
    listed = F.col("tier").isin("High", "Moderate") & (F.col("D") > 0) & F.col("veto_feature").isNull()
    order = Window.partitionBy("scenario_id", "query_id").orderBy(F.desc("D"), "entity")
    best = results.where(listed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    if shown_only:
        return best.where("entity is not null").withColumn("bucket", F.lit("ranked"))
    best = best.select(*KEYS, "rank")
    rows = results.join(best, KEYS, "left")
    bucket = (F.when(F.col("D").isNull() | (F.col("tier") == "Insufficient"), "insufficient").when((F.col("D") <= 0) | F.col("veto_feature").isNotNull(), "disqualified")
              .when(F.col("tier") == "Low", "low_confidence").when(F.col("rank").isNotNull(), "ranked").otherwise("ranked_beyond_top_n"))
    return rows.withColumn("bucket", bucket)


def bucket_counts(parted: DataFrame) -> DataFrame:
    n = {name: F.count(F.when(F.col("bucket") == name, 1)).alias(name) for name in ("ranked", "ranked_beyond_top_n", "low_confidence", "insufficient", "disqualified")}
    out = parted.groupBy("scenario_id", "query_id").agg(F.count(F.lit(1)).alias("evaluated"), *n.values())
    return out.withColumn("eligible", F.col("ranked") + F.col("ranked_beyond_top_n")).withColumnRenamed("ranked", "displayed")


def diagnose(parted: DataFrame) -> DataFrame:
    """Veto counts of queries in which every scored candidate has score 0, most frequent first."""
    keys = ["scenario_id", "query_id"]
    scored = F.col("bucket") != "insufficient"
    over = parted.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(scored, F.col("D") == 0)), F.lit(True)).alias("_all_zero"), F.count(F.when(F.col("D") == 0, 1)).alias("n_zero"))
    over = over.where("_all_zero and n_zero > 0").drop("_all_zero")
    counts = parted.where("D = 0 and veto_feature is not null").groupBy(*keys, "veto_feature").agg(F.count(F.lit(1)).alias("n_vetoed"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_vetoed"), "veto_feature")) == 1
    return over.join(counts, keys).withColumn("most_disqualifying", first)


def similar_entities(ranked: DataFrame, layer: DataFrame, k: int = 3) -> DataFrame:
    """The k most similar displayed entities of each displayed entity, by Spearman over the panel.

    ``ranked`` is (query_id, entity, D, rank, feature): the displayed list, at most 100 per query,
    so its pairs are bounded by the request.
    """
    cells = stage(ranked.join(layer, ["entity", "feature"]), "displayed")
    a = cells.select("query_id", "feature", F.col("entity").alias("entity"), F.col("value").alias("x"))
    b = cells.where("D > 0").select("query_id", "feature", F.col("entity").alias("other"), F.col("D").alias("other_D"), F.col("rank").alias("other_rank"), F.col("value").alias("y"))
    pairs = a.join(b, ["query_id", "feature"]).where("entity <> other")
    rho = spearman(pairs, ["query_id", "entity", "other", "other_D", "other_rank"], "x", "y", "correlation", bounded=True).where("correlation is not null")
    rho = rho.withColumn("correlation", F.round("correlation", 9))
    place = F.row_number().over(Window.partitionBy("query_id", "entity").orderBy(F.desc("correlation"), "other_rank"))
    return rho.withColumn("place", place).where(F.col("place") <= k).select("query_id", "entity", "place", "other", "other_D", "correlation")


def missing_evidence(scored: DataFrame, collisions: DataFrame | None = None) -> DataFrame:
    """Long rows for evidence that was withheld, lost to identity, or never measured."""
    base = ["query_id", "entity", "feature", "role"]
    parts = []
    for layer in ("mutation", "copy_number"):
        withheld = F.col(f"d_{layer}").isNull() & (F.col(f"s_{layer}") != "not_assayed") & (F.col("gene_class") == "unknown")
        parts.append((withheld, "gene_role_unknown", layer))
    parts.append((F.col("d_gene").isNull() & (F.col("role") == "exclusion"), "cannot_certify_absence", None))
    parts.append((F.col("d_gene").isNull() & (F.col("role") == "inclusion"), "untested", None))
    rows = scored
    if collisions is not None:
        lost = collisions.groupBy("feature").agg(F.collect_set("layer").alias("_lost"))
        rows = rows.join(lost, "feature", "left")
        for layer in ("protein", "dependency", "copy_number"):
            parts.append(((F.col(f"s_{layer}") == "not_assayed") & F.coalesce(F.array_contains("_lost", layer), F.lit(False)), "measured_unresolvable", layer))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(severity).alias("severity"), F.lit(layer).cast("string").alias("layer"))) for c, severity, layer in parts]))
    return rows.select(*base, F.inline(found))


def warnings(scored: DataFrame) -> DataFrame:
    """Per entity the withheld broad features and the correlation-scope note."""
    rows = scored.groupBy("query_id", "entity").agg(
        F.sort_array(F.collect_list(F.when(F.col("s_dependency") == "excluded_pan_essential", F.struct("ordinal", "feature", F.round("broad_fraction", 4).alias("fraction"))))).alias("_broad"), F.count("d_gene").alias("_m"))
    broad = F.transform("_broad", lambda x: F.struct(F.lit("pan_essential").alias("type"), x["feature"].alias("feature"), x["fraction"].alias("fraction")))
    scope = F.when(F.col("_m") > 1, F.array(F.struct(F.lit("correlation_layer_scope").alias("type"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("fraction")))).otherwise(
        F.expr("array()").cast("array<struct<type:string,feature:string,fraction:double>>"))
    return rows.select("query_id", "entity", F.inline(F.concat(broad, scope)))


def evidence_text(scored: DataFrame) -> DataFrame:
    """One sentence per feature, built from its fields."""
    parts = [F.when(F.col(f"d_{layer}").isNotNull(), F.format_string(f"{layer} (d=%.2f)", F.round(f"d_{layer}", SCORE_DIGITS))) for layer in LAYERS]
    missing = [F.when(F.col(f"s_{layer}").isin("not_assayed", "non_detected"), F.lit(layer)) for layer in LAYERS]
    gaps = F.concat_ws(", ", *missing)
    note = F.when(F.col("s_fusion") == "not_assayed", " Fusion status unknown: absent call is missing evidence, not a negative.").otherwise("")
    broad = F.when(F.col("s_dependency") == "excluded_pan_essential", F.concat(F.lit(" Dependency evidence withheld: broadly essential in "), F.format_string("%.0f%%", F.round(100 * F.col("broad_fraction"), SCORE_DIGITS)), F.lit(" of entities."))).otherwise("")
    fusions = F.when(F.col("n_fusions") > 0, F.concat(F.lit(" Fusion evidence: "), F.col("n_fusions").cast("string"), F.lit(" event(s)."))).otherwise("")
    head = F.concat("feature", F.lit(" ("), "role", F.lit(")"))
    scored_text = F.concat(head, F.lit(": d_gene="), F.format_string("%.2f", F.round("d_gene", SCORE_DIGITS)), F.lit(", from "), F.concat_ws(", ", *parts), F.when(gaps != "", F.concat(F.lit(". Missing: "), gaps, F.lit("."))).otherwise(""))
    text = F.when(F.col("d_gene").isNull(), F.concat(head, F.lit(": no evidence in any measured layer, not scored."))).otherwise(scored_text)
    return scored.select("query_id", "entity", "feature", F.concat(text, note, broad, F.when(F.col("d_gene").isNotNull(), fusions).otherwise("")).alias("text"))


def long_layers(scored: DataFrame) -> DataFrame:
    """(query_id, entity, feature, role, layer, d, state) of a scored grid."""
    cells = F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(f"d_{layer}").alias("d"), F.col(f"s_{layer}").alias("state")) for layer in LAYERS])
    return scored.select("scenario_id", "query_id", "entity", "feature", "role", F.inline(cells))


def check_request(panel: Panel, reference: DataFrame, ploidy_min: float | None = None, ploidy_max: float | None = None, top_k: int = 10) -> Panel:
    """The panel with its tokens resolved to ids. An unknown or ambiguous token is an error, and so is a feature that
    is included and excluded under two spellings."""
    found = resolve_strict(panel.features, reference)
    ids = Panel(panel.query_id, tuple(found[t] for t in panel.include), tuple(found[t] for t in panel.exclude), panel.group)
    validate_query(ids, ploidy_min, ploidy_max, top_k)
    return ids


def nested_results(scored: DataFrame, parted: DataFrame, expression: DataFrame, collisions: DataFrame | None = None, similar: int = 3) -> DataFrame:
    """One row per candidate with its scores, and as arrays its evidence sentences, warnings, missing evidence and, if
    displayed, its similar entities. A candidate's arrays are bounded by the panel."""
    keys = ["query_id", "entity"]

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    order = scored.select(*keys, "feature", "ordinal")
    sentences = listed(evidence_text(scored).join(order, [*keys, "feature"]), "evidence", "ordinal", "feature", "text")
    noted = listed(warnings(scored), "warnings", "type", "feature", "fraction")
    gaps = listed(missing_evidence(scored, collisions), "missing", "feature", "role", "severity", "layer")
    shown = parted.where("bucket = 'ranked'").select(*keys, "D", "rank").join(order.drop("ordinal"), keys)
    near = listed(similar_entities(shown, expression, similar), "similar", "place", "other", "correlation")
    out = parted
    for part in (sentences, noted, gaps, near):
        out = out.join(part, keys, "left")
    return out


def score_request(
    panel: Panel, reference: DataFrame, coverage: DataFrame, measures: DataFrame, mutations: DataFrame, fusions: DataFrame, entities: DataFrame, roles: DataFrame, expression: DataFrame,
    filters: dict | None = None, top_n: int = 10, similar: int = 3, scenario: Scenario | None = None, collisions: DataFrame | None = None, stored: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """A whole request: tokens are resolved and validated, candidates filtered (arguments of `filter_candidates`), scored,
    ranked, and returned with their nested explanations."""
    filters = dict(filters or {})
    panel = check_request(panel, reference, filters.get("ploidy_min"), filters.get("ploidy_max"), top_n)
    wanted = filter_candidates(entities, coverage, **filters).select("entity")
    candidates = coverage.select("entity", "grp", "mutations_state", "fusions_state").join(wanted, "entity", "left_semi")
    scored = stage(score_features(candidates, measures, mutations, fusions, entities, roles, [panel], [scenario or Scenario()], stored=stored), "scored")
    parted = partition_results(combine_features(scored, [panel]).drop("grp"), top_n).drop("scenario_id")
    return nested_results(scored, parted, expression, collisions, similar)

"""Registered queries for panel scoring and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.session import small_frame, stage
from panelgrid.functions import columns as c
from panelgrid.operators import calibrate as cal
from panelgrid.operators import identity
from panelgrid.operators import score as op
from panelgrid.operators.score import Panel, Scenario
from panelgrid.plans import panel_sql as ps
from panelgrid.plans.registry import query, rd
from panelgrid.sources.tables import union_all

FLAGSHIP = [Panel("flagship", ("F03", "F10"), ("F21",))]
# The broad-feature cutoff is lowered so that some features of the test tables pass it.
BASE = [Scenario(broad_fraction=0.145)]
BATTERY = [
    Panel("single", ("F04",)), Panel("single_in_group", ("F04",), group="BUILDING"), Panel("flagship", ("F03", "F10"), ("F21",)),
    Panel("wide", ("F01", "F03", "F06", "F07", "F09"), ("F12", "F15")), Panel("suppressor", ("F07", "F13"), ("F16",), group="MACHINERY"),
    Panel("no_inclusion", (), ("F06", "F09")), Panel("unknown_feature", ("F99",), ("F03",)),
]
WIDE = [BATTERY[3]]


def candidates(b):
    return b("coverage").select("entity", "grp", "mutations_state", "fusions_state")


def constants(b):
    """The stored calibration tables."""
    return {name: b.kept(f"constants_{name}", lambda name=name: op.build_constants(b("cells"), b("entities"))[name]) for name in ("layers", "groups", "protein")}


def scored_grid(b, panels, scenarios=None, **kw):
    kw.setdefault("stored", constants(b))
    cand = kw.pop("candidates", None)
    return op.score_features(cand if cand is not None else candidates(b), b("cells"), b("mutations"), b("fusions"), b("entities"), b("roles"), panels, scenarios or BASE, **kw)


def results(b, panels, scenarios=None, with_group=False, best=None, **kw):
    """Scores of the panels, for all scenarios in one pass over the candidates. Few queries ask for the group, for which the grid is spread.

    With ``best`` only the displayed rows of a list of that length are asked for.
    """
    out = op.combine_features(scored_grid(b, panels, scenarios, spread=with_group, **kw), panels, best)
    return out if with_group else out.drop("grp")


@query("f1_desirability", f"""SELECT entity, feature, {rd(ps.ramp('value', '10.0::DOUBLE', '16.0::DOUBLE', "'inclusion'"), 10)} AS d_in, {rd(ps.ramp('value', '10.0::DOUBLE', '16.0::DOUBLE', "'exclusion'"), 10)} AS d_out,
    {rd("least(greatest((value - 10.0) / 6.0, 0.0), 1.0) * least(greatest((value - 10.0) / 6.0, 0.0), 1.0)", 12)} AS d_squared, CAST(NULL AS DOUBLE) AS d_flat FROM expression_rna""")
def _(b):
    y, lo, hi = F.col("value"), F.lit(10.0), F.lit(16.0)
    return b("expression_rna").select(
        "entity", "feature", F.round(c.ramp(y, lo, hi, F.lit("inclusion")), 10).alias("d_in"), F.round(c.ramp(y, lo, hi, F.lit("exclusion")), 10).alias("d_out"),
        F.round(c.ramp(y, lo, hi, F.lit("inclusion"), 2.0), 12).alias("d_squared"), c.ramp(y, hi, hi, F.lit("inclusion")).alias("d_flat"))


@query("f2_constant_lookup", f"""WITH kg AS (SELECT feature, {ps.lt4('rna')} FROM cells GROUP BY feature {ps.gated('rna')}),
    kl AS (SELECT e.grp, c.feature, {ps.lt4('c.rna')} FROM cells c JOIN entities e ON c.entity = e.entity GROUP BY 1, 2 {ps.gated('c.rna')})
    SELECT e.grp, kg.feature, CASE WHEN kl.n >= 235 THEN kl.L ELSE kg.L END AS L, CASE WHEN kl.n >= 235 THEN kl.T ELSE kg.T END AS T FROM (SELECT DISTINCT grp FROM entities WHERE grp IS NOT NULL) e JOIN kg ON true LEFT JOIN kl ON kl.grp = e.grp AND kl.feature = kg.feature""")
def _(b):
    own = op.group_constants(b("cells"), b("entities")).where("l_n >= 235")
    whole = op.rename_constants(cal.gate(cal.calibrate_global(b("expression_rna"))), "g")
    groups = b("entities").where("grp is not null").agg(F.sort_array(F.collect_set("grp"))).scalar()
    out = whole.withColumn("grp", F.explode(groups)).join(own, ["grp", "feature"], "left")
    pair = F.coalesce(F.when(F.col("l_n").isNotNull(), F.struct(F.col("l_L").alias("L"), F.col("l_T").alias("T"))), F.struct(F.col("g_L").alias("L"), F.col("g_T").alias("T")))
    return out.select("grp", "feature", pair.alias("k")).select("grp", "feature", "k.L", "k.T")


_LAYER_COLS = ["d_rna", "d_protein", "d_dependency", "d_copy_number", "d_mutation", "d_fusion"]


@query("f3_score_layers", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT query_id, entity, feature, role, cls AS gene_class, " + ", ".join(f"{rd(d, 10)} AS {d}" for d in _LAYER_COLS) + " FROM sf")
def _(b):
    return scored_grid(b, WIDE).select("query_id", "entity", "feature", "role", "gene_class", *[F.round(d, 10).alias(d) for d in _LAYER_COLS])


@query("f4_abstain_broad", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT entity, feature, effect, s_dependency, {rd('d_dependency', 10)} AS d_dependency FROM sf")
def _(b):
    return scored_grid(b, WIDE).select("entity", "feature", "effect", "s_dependency", F.round("d_dependency", 10).alias("d_dependency"))


@query("f5_classify_events", """SELECT entity, feature, CASE WHEN bool_or(is_driver OR is_hotspot) THEN 'driver_hotspot' WHEN bool_or(impact = 'HIGH') THEN 'high_lof' WHEN bool_or(impact = 'MODERATE') THEN 'moderate_vus' ELSE 'low_or_modifier' END AS category
    FROM mutations GROUP BY 1, 2""")
def _(b):
    return op.classify_events(b("mutations")).select("entity", "feature", op.event_category(F.lit(True)).alias("category"))


@query("f6_score_events", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT entity, feature, mutation_category, s_mutation, d_mutation FROM sf")
def _(b):
    return scored_grid(b, WIDE).select("entity", "feature", "mutation_category", "s_mutation", "d_mutation")


@query("f7_score_presence", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT entity, feature, s_fusion, d_fusion, {rd('w5')} AS w_fusion, coalesce(n_fusions, 0) AS n_fusions FROM sf")
def _(b):
    return scored_grid(b, WIDE).select("entity", "feature", "s_fusion", "d_fusion", F.round("w_fusion", 9).alias("w_fusion"), F.coalesce("n_fusions", F.lit(0)).alias("n_fusions"))


@query("f8_combine_layers", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT query_id, entity, feature, role, {rd('d_gene', 10)} AS d_gene, CAST(nl AS INT) AS n_layers FROM sf")
def _(b):
    return scored_grid(b, WIDE).select("query_id", "entity", "feature", "role", F.round("d_gene", 10).alias("d_gene"), op.n_layers().alias("n_layers"))


_ONE = [Scenario("custom", {"rna": 0.5, "protein": 0.1, "dependency": 0.0, "copy_number": 0.1, "mutation": 0.1, "fusion": 0.2})]


@query("f9_layer_weights", f"WITH {ps.panel_ctes(WIDE, _ONE)} SELECT query_id, entity, feature, role, s_fusion, {rd('w5')} AS w_fusion, {rd('d_gene', 10)} AS d_gene FROM sf")
def _(b):
    return scored_grid(b, WIDE, _ONE).select("query_id", "entity", "feature", "role", "s_fusion", F.round("w_fusion", 9).alias("w_fusion"), F.round("d_gene", 10).alias("d_gene"))


@query("f10_correlation_weights", f"WITH {ps.panel_ctes(BATTERY, BASE)} SELECT cw.query_id, cw.feature, {rd('rho_bar', 8)} AS rho_bar, {rd('weight', 8)} AS weight, m_eff FROM cw JOIN me ON me.query_id = cw.query_id")
def _(b):
    w = op.correlation_weights(b("expression_rna"), BATTERY)
    total = w.groupBy("query_id").agg(F.round(F.sum("weight"), 9).alias("m_eff"))
    return w.join(total, "query_id").select("query_id", "feature", F.round("rho_bar", 8).alias("rho_bar"), F.round("weight", 8).alias("weight"), "m_eff")


_SCORE_COLS = ["query_id", "entity", "D", "veto_feature", "veto_reason", "m"]


@query("f11_combine_features", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT {', '.join(_SCORE_COLS)} FROM sc")
def _(b):
    return results(b, WIDE).select(*_SCORE_COLS)


@query("f12_corroborate", f"WITH {ps.panel_ctes(WIDE, BASE)} SELECT entity, hpa_agreement, geo_agreement FROM sc")
def _(b):
    return results(b, WIDE).select("entity", "hpa_agreement", "geo_agreement")


@query("f13_confidence_tier", f"WITH {ps.panel_ctes(BATTERY, BASE)} SELECT query_id, tier, count(*) AS n, {rd('avg(abstained)')} AS mean_abstained FROM sc GROUP BY 1, 2")
def _(b):
    return results(b, BATTERY).groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("abstained"), 9).alias("mean_abstained"))


_MIXED = [Panel("mixed", ("F02", "F05"), ("F08",))]


@query("f14_missing_evidence", f"""WITH {ps.panel_ctes(_MIXED, BASE)}
    SELECT query_id, entity, feature, role, 'gene_role_unknown' AS severity, 'mutation' AS layer FROM sf WHERE d_mutation IS NULL AND s_mutation <> 'not_assayed' AND cls = 'unknown'
    UNION ALL SELECT query_id, entity, feature, role, 'gene_role_unknown', 'copy_number' FROM sf WHERE d_copy_number IS NULL AND s_copy_number <> 'not_assayed' AND cls = 'unknown'
    UNION ALL SELECT query_id, entity, feature, role, 'measured_unresolvable', 'protein' FROM sf WHERE s_protein = 'not_assayed' AND feature = 'F05'
    UNION ALL SELECT query_id, entity, feature, role, CASE WHEN role = 'exclusion' THEN 'cannot_certify_absence' ELSE 'untested' END, NULL FROM sf WHERE d_gene IS NULL""")
def _(b):
    lost = b("features").where("feature = 'F05'").select(F.lit("protein").alias("layer"), "feature")
    return op.missing_evidence(scored_grid(b, _MIXED), lost)


@query("f15_veto_and_warnings", f"""WITH {ps.panel_ctes(WIDE, BASE)}, w AS (SELECT query_id, entity, 'pan_essential' AS type, feature, {rd('broad', 4)} AS fraction FROM sf WHERE s_dependency = 'excluded_pan_essential'
    UNION ALL SELECT query_id, entity, 'correlation_layer_scope', NULL, NULL FROM sc WHERE m > 1) SELECT * FROM w""")
def _(b):
    return op.warnings(scored_grid(b, WIDE))


SENTENCES = f"""t AS (SELECT *, concat_ws(', ', {", ".join(f"CASE WHEN d_{x} IS NOT NULL THEN '{x} (d=' || printf('%.2f', round(round(CAST(d_{x} AS DECIMAL(30,16)), 10), 2)) || ')' END" for x in op.LAYERS)}) AS parts,
      concat_ws(', ', {", ".join(f"CASE WHEN s_{x} IN ('not_assayed', 'non_detected') THEN '{x}' END" for x in op.LAYERS)}) AS gaps FROM sf),
    tx AS (SELECT query_id, entity, feature, ordinal, CASE WHEN d_gene IS NULL THEN feature || ' (' || role || '): no evidence in any measured layer, not scored.'
      ELSE feature || ' (' || role || '): d_gene=' || printf('%.2f', round(round(CAST(d_gene AS DECIMAL(30,16)), 10), 2)) || ', from ' || parts || CASE WHEN gaps <> '' THEN '. Missing: ' || gaps || '.' ELSE '' END END
      || CASE WHEN s_fusion = 'not_assayed' THEN ' Fusion status unknown: absent call is missing evidence, not a negative.' ELSE '' END
      || CASE WHEN s_dependency = 'excluded_pan_essential' THEN ' Dependency evidence withheld: broadly essential in ' || printf('%.0f', round(CAST(100 * broad AS DECIMAL(18,12)), 0)) || '% of entities.' ELSE '' END
      || CASE WHEN d_gene IS NOT NULL AND n_fusions > 0 THEN ' Fusion evidence: ' || CAST(n_fusions AS VARCHAR) || ' event(s).' ELSE '' END AS text FROM t)"""


@query("f16_evidence_text", f"WITH {ps.panel_ctes(FLAGSHIP, BASE)}, {SENTENCES} SELECT query_id, entity, feature, text FROM tx")
def _(b):
    return op.evidence_text(scored_grid(b, FLAGSHIP))


_PARTED = ["query_id", "entity", "D", "tier", "veto_feature", "veto_reason", "hpa_agreement", "geo_agreement", "m", "m_eff", "bucket", "rank"]


@query("f17_partition", f"WITH {ps.panel_ctes(BATTERY, BASE)}, {ps.parted_cte()} SELECT query_id, count(*) AS evaluated, count(CASE WHEN bucket = 'ranked' THEN 1 END) AS displayed, " + ", ".join(
    f"count(CASE WHEN bucket = '{x}' THEN 1 END) AS {x}" for x in ("ranked_beyond_top_n", "low_confidence", "insufficient", "disqualified")) + ", count(CASE WHEN bucket IN ('ranked', 'ranked_beyond_top_n') THEN 1 END) AS eligible FROM parted GROUP BY 1")
def _(b):
    return op.bucket_counts(op.partition_results(results(b, BATTERY))).drop("scenario_id")


_HARD = [Panel("over", ("F04", "F07"), ("F04", "F07")), FLAGSHIP[0]]
_DRY = [Scenario("presence_only", {"fusion": 1.0})]


@query("f18_diagnose", f"""WITH {ps.panel_ctes(_HARD, _DRY)}, {ps.parted_cte()}, o AS (SELECT query_id, count(CASE WHEN D = 0 THEN 1 END) AS n_zero FROM parted GROUP BY 1 HAVING bool_and(bucket = 'insufficient' OR D = 0) AND count(CASE WHEN D = 0 THEN 1 END) > 0),
    v AS (SELECT query_id, veto_feature, count(*) AS n_vetoed FROM parted WHERE D = 0 AND veto_feature IS NOT NULL GROUP BY 1, 2)
    SELECT o.query_id, o.n_zero, v.veto_feature, v.n_vetoed, row_number() OVER (PARTITION BY o.query_id ORDER BY v.n_vetoed DESC, v.veto_feature) = 1 AS most_disqualifying FROM o JOIN v ON v.query_id = o.query_id""")
def _(b):
    return op.diagnose(op.partition_results(results(b, _HARD, _DRY))).drop("scenario_id")


def displayed(b, panels, top_n=10):
    ranked = stage(op.partition_results(results(b, panels, best=top_n), top_n, shown_only=True).select("query_id", "entity", "D", "rank"), "displayed")
    return union_all([ranked.where(F.col("query_id") == p.query_id).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in p.features]))) for p in panels])


@query("f19_similar_entities", f"""WITH {ps.panel_ctes(WIDE, BASE)}, {ps.parted_cte()}, r AS (SELECT p.query_id, p.entity, p.D, p.rank, x.feature, x.rna FROM parted p JOIN panel q ON q.query_id = p.query_id JOIN cells x ON x.entity = p.entity AND x.feature = q.feature WHERE p.bucket = 'ranked'),
    k AS (SELECT a.query_id, a.entity, b.entity AS other, b.D AS other_D, b.rank AS other_rank, a.rna AS x, b.rna AS y FROM r a JOIN r b ON a.query_id = b.query_id AND a.feature = b.feature AND a.entity <> b.entity),
    kr AS (SELECT *, rank() OVER (PARTITION BY query_id, entity, other ORDER BY x) + (count(*) OVER (PARTITION BY query_id, entity, other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY query_id, entity, other ORDER BY y) + (count(*) OVER (PARTITION BY query_id, entity, other, y) - 1) / 2.0 AS ry FROM k),
    s AS (SELECT query_id, entity, other, other_D, other_rank, {rd('CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END')} AS correlation FROM kr GROUP BY 1, 2, 3, 4, 5),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY correlation DESC, other_rank) AS place FROM s WHERE correlation IS NOT NULL)
    SELECT query_id, entity, CAST(place AS INT) AS place, other, other_D, correlation FROM t WHERE place <= 3""")
def _(b):
    return op.similar_entities(displayed(b, WIDE), b("expression_rna"), 3)


@query("f20_score_panel", f"WITH {ps.panel_ctes(FLAGSHIP, BASE)}, {ps.parted_cte()} SELECT {', '.join(_PARTED)} FROM parted")
def _(b):
    for p in FLAGSHIP:
        op.validate_query(p)
    return op.partition_results(results(b, FLAGSHIP)).select(*_PARTED)


@query("f21_validate_query", """SELECT t.token, f.feature, CASE WHEN t.token IN ('Brand#3', 'F10') THEN 'inclusion' ELSE 'exclusion' END AS role, count(*) OVER (PARTITION BY f.feature) > 1 AS in_both
    FROM (VALUES ('Brand#3'), ('F10'), ('F03'), ('Brand#21')) t(token) JOIN features f ON f.feature = t.token OR f.symbol = t.token""")
def _(b):
    asked = [("Brand#3", "inclusion"), ("F10", "inclusion"), ("F03", "exclusion"), ("Brand#21", "exclusion")]
    tokens = small_frame(b.spark, asked, "token string, role string")
    resolved = identity.resolve(tokens, b("features")).where("status = 'resolved'")
    roles = resolved.groupBy("feature").agg(F.count_distinct("role").alias("_k"))
    return resolved.join(roles, "feature").select("token", "feature", "role", (F.col("_k") > 1).alias("in_both"))


@query("f22_score_battery", f"WITH {ps.panel_ctes(BATTERY, BASE)}, {ps.parted_cte()} SELECT {', '.join(_PARTED)} FROM parted")
def _(b):
    return op.partition_results(results(b, BATTERY)).select(*_PARTED)


# A request as a user states it: symbols and ids mixed, and filters on candidates.
REQUEST = Panel("request", ("Brand#12", "F03"), ("Brand#21",))
FILTERS = {"exclude_problematic": True, "ploidy_min": 2.0, "ploidy_max": 5.5, "require": ("mirna",)}
_RESOLVED = """rq AS (SELECT t.token, t.role, t.ordinal, f.feature FROM (VALUES ('Brand#12', 'inclusion', 0), ('F03', 'inclusion', 1), ('Brand#21', 'exclusion', 2)) t(token, role, ordinal) JOIN (SELECT DISTINCT feature, symbol FROM features) f ON f.feature = t.token OR f.symbol = t.token),
    panel AS (SELECT 'request' AS query_id, CAST(ordinal AS INT) AS ordinal, feature, role, CAST(NULL AS VARCHAR) AS want, 3 AS m_all FROM rq)"""
_FILTERED = "SELECT c.entity, c.grp, c.grp AS cal_grp, c.mutations_state, c.fusions_state FROM coverage c JOIN entities e ON e.entity = c.entity WHERE NOT e.is_problematic AND c.ploidy >= 2.0 AND c.ploidy <= 5.5 AND c.mirna_available"
_SIMILAR = f"""sr AS (SELECT p.query_id, p.entity, p.D, p.rank, x.feature, x.rna FROM parted p JOIN panel q ON q.query_id = p.query_id JOIN cells x ON x.entity = p.entity AND x.feature = q.feature WHERE p.bucket = 'ranked'),
    sk AS (SELECT a.query_id, a.entity, b.entity AS other, b.rank AS other_rank, a.rna AS x, b.rna AS y FROM sr a JOIN sr b ON a.query_id = b.query_id AND a.feature = b.feature AND a.entity <> b.entity),
    sq AS (SELECT *, rank() OVER (PARTITION BY query_id, entity, other ORDER BY x) + (count(*) OVER (PARTITION BY query_id, entity, other, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY query_id, entity, other ORDER BY y) + (count(*) OVER (PARTITION BY query_id, entity, other, y) - 1) / 2.0 AS ry FROM sk),
    ss AS (SELECT query_id, entity, other, other_rank, {rd('CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END')} AS correlation FROM sq GROUP BY 1, 2, 3, 4),
    st AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY correlation DESC, other_rank) AS place FROM ss WHERE correlation IS NOT NULL),
    sl AS (SELECT query_id, entity, string_agg(CAST(other AS VARCHAR), '|' ORDER BY place) AS similar FROM st WHERE place <= 3 GROUP BY 1, 2)"""


@query("f20_score_request", f"""WITH {_RESOLVED.split('),')[0]}), {ps.panel_ctes([], BASE, _FILTERED, panel=_RESOLVED.split('),', 1)[1].strip())}, {ps.parted_cte()}, {SENTENCES}, {_SIMILAR},
    ev AS (SELECT query_id, entity, md5(string_agg(text, '|' ORDER BY ordinal)) AS evidence FROM tx GROUP BY 1, 2), wn AS (SELECT query_id, entity, count(CASE WHEN s_dependency = 'excluded_pan_essential' THEN 1 END) + CASE WHEN count(d_gene) > 1 THEN 1 ELSE 0 END AS n_warnings FROM sf GROUP BY 1, 2),
    ms AS (SELECT query_id, entity, sum(CASE WHEN d_mutation IS NULL AND s_mutation <> 'not_assayed' AND cls = 'unknown' THEN 1 ELSE 0 END + CASE WHEN d_copy_number IS NULL AND s_copy_number <> 'not_assayed' AND cls = 'unknown' THEN 1 ELSE 0 END + CASE WHEN d_gene IS NULL THEN 1 ELSE 0 END) AS n_missing FROM sf GROUP BY 1, 2)
    SELECT {', '.join('p.' + c for c in _PARTED)}, ev.evidence, CAST(wn.n_warnings AS INT) AS n_warnings, CAST(ms.n_missing AS INT) AS n_missing, sl.similar FROM parted p JOIN ev ON ev.query_id = p.query_id AND ev.entity = p.entity JOIN wn ON wn.query_id = p.query_id AND wn.entity = p.entity
      JOIN ms ON ms.query_id = p.query_id AND ms.entity = p.entity LEFT JOIN sl ON sl.query_id = p.query_id AND sl.entity = p.entity""")
def _(b):
    out = op.score_request(REQUEST, b("features"), b("coverage"), b("cells"), b("mutations"), b("fusions"), b("entities"), b("roles"), b("expression_rna"), FILTERS, scenario=BASE[0], stored=constants(b))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(*_PARTED, F.md5(F.array_join(F.transform("evidence", lambda x: x["text"]), "|")).alias("evidence"), size("warnings").alias("n_warnings"), size("missing").alias("n_missing"),
                      F.array_join(F.transform("similar", lambda x: x["other"].cast("string")), "|").alias("similar"))

"""Registered queries for similarity, comparison and context."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelgrid.operators import score
from panelgrid.operators import similarity as op
from panelgrid.plans import panel_sql as ps
from panelgrid.plans.ranking import BASE, WIDE, results, scored_grid
from panelgrid.plans.registry import query, rd
from panelgrid.session import stage

ANCHOR = 13
FEATS = WIDE[0].features
INLIST = ", ".join(f"'{f}'" for f in FEATS)
VW = "vw AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', {w}::DOUBLE)" for v, w in op.VIEW_WEIGHTS.items()) + ") t(view, weight))"
PROF = f"""{VW}, co AS (SELECT entity FROM entities WHERE grp = (SELECT grp FROM entities WHERE entity = {ANCHOR})),
    vr AS (SELECT * FROM (SELECT 'rna' AS view, feature, entity, rna AS value FROM cells UNION ALL SELECT 'dependency', feature, entity, effect FROM cells UNION ALL SELECT 'relative_copy_number', feature, entity, copy_number FROM cells
      UNION ALL SELECT 'protein', feature, entity, zscore FROM cells WHERE detected) q WHERE feature IN ({INLIST}) AND entity IN (SELECT entity FROM co)),
    vt AS (SELECT view, feature, value, count(*) AS c FROM vr GROUP BY 1, 2, 3), vs AS (SELECT view, feature, count(*) AS n_distinct, count(CASE WHEN c > 1 THEN 1 END) AS n_tie_groups FROM vt GROUP BY 1, 2),
    vp AS (SELECT r.view, r.feature, r.entity, CASE WHEN count(*) OVER k >= 3 AND s.n_distinct >= 2 THEN {rd("(rank() OVER (PARTITION BY r.view, r.feature ORDER BY value) + (count(*) OVER (PARTITION BY r.view, r.feature, value) - 1) / 2.0) / count(*) OVER k")} END AS percentile,
      count(*) OVER k AS observed_n, s.n_tie_groups FROM vr r JOIN vs s ON s.view = r.view AND s.feature = r.feature WINDOW k AS (PARTITION BY r.view, r.feature)),
    sc_ AS (SELECT c.entity, c.view, count(*) AS n_joint, {rd('1.0 - avg(abs(c.percentile - a.percentile))', 11)} AS score FROM vp c JOIN vp a ON a.view = c.view AND a.feature = c.feature AND a.entity = {ANCHOR} WHERE c.entity <> {ANCHOR} AND c.percentile IS NOT NULL AND a.percentile IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {op.MIN_JOINT * len(FEATS)}),
    sw AS (SELECT s.*, v.weight FROM sc_ s JOIN vw v ON v.view = s.view), sim AS (SELECT entity, count(*) AS n_views, {rd('sum(weight * score) / sum(weight)', 8)} AS S FROM sw GROUP BY 1 HAVING count(*) >= 2)"""


def profiles(b):
    e = b("entities")
    own = e.where(F.col("entity") == ANCHOR).select("grp")
    return op.percentile_profiles(op.view_rows(b("cells"), e.join(own, "grp", "left_semi"), FEATS))


def scores(b):
    return stage(op.view_scores(stage(profiles(b), "profiles"), ANCHOR, len(FEATS)), "view_scores")


@query("h1_percentile_profiles", f"WITH {PROF} SELECT * FROM vp")
def _(b):
    return profiles(b)


@query("h2_view_scores", f"WITH {PROF} SELECT * FROM sc_")
def _(b):
    return scores(b)


@query("h3_similarity", f"WITH {PROF} SELECT * FROM sim")
def _(b):
    return op.similarity(scores(b))


@query("h4_leave_one_view_out", f"""WITH {PROF}, t AS (SELECT a.entity, b.view, {rd('sum(a.weight * a.score) / sum(a.weight)', 8)} AS o FROM sw a JOIN sw b ON a.entity = b.entity AND a.view <> b.view GROUP BY 1, 2) SELECT entity, min(o) AS S_min, max(o) AS S_max FROM t GROUP BY 1""")
def _(b):
    return op.leave_one_view_out(scores(b))


@query("h5_alternatives", f"""WITH {ps.panel_ctes(WIDE, BASE)}, {PROF}, r AS (SELECT sim.entity, sim.n_views, sim.S, sc.D, sc.tier, CAST(row_number() OVER (ORDER BY sim.S DESC, sim.entity) AS INT) AS rank FROM sim JOIN sc ON sc.entity = sim.entity WHERE sc.D > 0 AND sc.veto_feature IS NULL AND sc.tier IN ('High', 'Moderate')) SELECT * FROM r WHERE rank <= 3""")
def _(b):
    eligible = results(b, WIDE).where("D > 0 and veto_feature is null and tier in ('High', 'Moderate')")
    return op.alternatives(scores(b), eligible, 3)


@query("h6_alternative_sensitivity", f"""WITH {PROF}, run AS (SELECT 'baseline' AS scenario, entity, weight, score FROM sw UNION ALL SELECT 'equal_view_weights', entity, 1.0::DOUBLE, score FROM sw UNION ALL SELECT 'omit_' || v.view, s.entity, s.weight, s.score FROM sw s JOIN vw v ON v.view <> s.view),
    k AS (SELECT scenario, entity, {rd('sum(weight * score) / sum(weight)', 8)} AS S FROM run GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY S DESC, entity) AS r FROM k),
    o AS (SELECT a.scenario, count(b.entity) AS n, count(*) AS ka, (SELECT count(*) FROM t WHERE scenario = 'baseline' AND r <= 3) AS kb FROM t a LEFT JOIN t b ON b.scenario = 'baseline' AND b.r <= 3 AND b.entity = a.entity WHERE a.r <= 3 AND a.scenario <> 'baseline' GROUP BY 1)
    SELECT scenario, CAST(n AS INT) AS overlap, {rd('CAST(n AS DOUBLE) / (ka + kb - n)')} AS jaccard FROM o""")
def _(b):
    return op.alternative_sensitivity(scores(b))


CMP = [101, 202, 303]


@query("h7_compare", f"""WITH {ps.panel_ctes(WIDE, BASE)}, a AS (SELECT entity, 'model' AS section, 'name' AS label, name AS value FROM entities UNION ALL SELECT entity, 'model', 'grp', grp FROM entities UNION ALL SELECT entity, 'native', 'tier', tier FROM sc UNION ALL SELECT entity, 'native', 'veto', veto_feature FROM sc
      UNION ALL SELECT entity, 'layer', feature || ':mutation:state', s_mutation FROM sf UNION ALL SELECT entity, 'layer', feature || ':rna:state', s_rna FROM sf)
    SELECT section, label, {", ".join(f"max(CASE WHEN entity = {e} THEN value END) AS entity_{i}" for i, e in enumerate(CMP, 1))} FROM a WHERE entity IN ({', '.join(map(str, CMP))}) GROUP BY 1, 2""")
def _(b):
    chosen = F.col("entity").isin(CMP)
    cand = b("coverage").where(chosen).select("entity", "grp", "mutations_state", "fusions_state")
    grid = stage(scored_grid(b, WIDE, candidates=cand), "compare")
    res = score.combine_features(grid)
    layers = score.long_layers(grid).where("layer in ('mutation', 'rna')").select("entity", F.lit("layer").alias("section"), F.concat_ws(":", "feature", "layer", F.lit("state")).alias("label"), F.col("state").alias("value"))
    meta = b("entities").where(chosen).select("entity", F.lit("model").alias("section"), F.inline(F.array(F.struct(F.lit("name").alias("label"), F.col("name").alias("value")), F.struct(F.lit("grp").alias("label"), F.col("grp").alias("value")))))
    native = res.select("entity", F.lit("native").alias("section"), F.inline(F.array(F.struct(F.lit("tier").alias("label"), F.col("tier").alias("value")), F.struct(F.lit("veto").alias("label"), F.col("veto_feature").alias("value")))))
    return op.compare(meta.unionByName(native).unionByName(layers), CMP)


@query("h8_event_context", f"""WITH r AS (SELECT entity, feature, impact || ':' || CAST(sample AS VARCHAR) AS payload FROM mutations WHERE entity IN (101, 202, 303) AND feature IN ({INLIST})), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity, feature ORDER BY payload) AS INT) AS place, count(*) OVER (PARTITION BY entity, feature) AS total FROM r)
    SELECT *, total > 1 AS truncated FROM k WHERE place <= 1""")
def _(b):
    rows = b("mutations").withColumn("payload", F.concat("impact", F.lit(":"), F.col("sample").cast("string")))
    return op.event_context(rows, CMP, FEATS, "payload", 1)


_LONG = " UNION ALL ".join(f"SELECT '{layer}' AS layer, s_{layer} AS state FROM sf" for layer in score.LAYERS)


@query("h8_layer_caveats", f"""WITH {ps.panel_ctes(WIDE, BASE)}, l AS ({_LONG}) SELECT layer, state, CASE WHEN state IN ('not_assayed', 'non_detected') THEN state WHEN state = 'measured_absent' AND layer IN ('mutation', 'fusion') THEN 'measured_absent_not_confirmed_absence'
    WHEN state = 'measured' AND layer = 'copy_number' THEN 'relative_not_absolute' WHEN state = 'measured' AND layer = 'protein' THEN 'mixed_scale' END AS caveat, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def _(b):
    return op.layer_caveats(score.long_layers(scored_grid(b, WIDE))).groupBy("layer", "state", "caveat").agg(F.count(F.lit(1)).alias("n"))


@query("h9_layer_missingness", f"WITH {ps.panel_ctes(WIDE, BASE)}, l AS ({_LONG}) SELECT layer, state, count(*) AS n FROM l GROUP BY 1, 2")
def _(b):
    return op.layer_missingness(score.long_layers(scored_grid(b, WIDE)))


def _shown(n: int) -> str:
    """The partition with n displayed entities, under names of its own."""
    sql = ps.parted_cte(n)
    for name in ("parted", "pl", "pn"):
        sql = re.sub(rf"\b{name}\b(?= AS \()|(?<=FROM ){name}\b", f"{name}{n}", sql)
    return sql


_SAME = "query_id, entity, D, tier, veto_feature"


@query("h10_invariance", f"""WITH {ps.panel_ctes(WIDE, BASE)}, {_shown(5)}, {_shown(20)} SELECT (SELECT count(*) FROM (SELECT {_SAME} FROM parted5 EXCEPT ALL SELECT {_SAME} FROM parted20) q) AS only_first,
    (SELECT count(*) FROM (SELECT {_SAME} FROM parted20 EXCEPT ALL SELECT {_SAME} FROM parted5) q) AS only_second""")
def _(b):
    res = stage(results(b, WIDE), "results")
    cols = ["query_id", "entity", "D", "tier", "veto_feature"]
    return op.assert_invariant(score.partition_results(res, 5).select(*cols), score.partition_results(res, 20).select(*cols))


@query("h11_largest_group", "SELECT grp, count(*) AS n FROM entities GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(b):
    return op.largest_group(b("entities"))

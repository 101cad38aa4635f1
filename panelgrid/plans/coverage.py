"""Registered queries for coverage and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import coverage as op
from panelgrid.plans.registry import query, rd
from panelgrid.plans.sources import STATES

QUESTIONS = {
    "direct": ["fusions"], "codependency": ["dependency", "copy_number"], "mutation_conditioned": ["mutations", "dependency"],
    "multi": ["mutations", "expression_rna_hpa", "copy_number", "dependency"], "rna_protein": ["expression_rna_geo", "protein"],
}
DEFS = "defs AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{layer}', {i})" for q, ls in QUESTIONS.items() for i, layer in enumerate(ls, 1)) + ") d(question, layer, step))"
READY = f"{DEFS}, rdy AS (SELECT d.question, c.grp, c.entity, bool_and(c.state <> 'not_assayed') AS ready FROM coverage_long c JOIN defs d ON c.layer = d.layer GROUP BY 1, 2, 3)"
GRP = f"{READY}, g AS (SELECT question, grp, count(*) AS n_group, count(CASE WHEN ready THEN 1 END) AS n_ready FROM rdy GROUP BY 1, 2)"
GC = "gc AS (SELECT grp, layer, count(*) AS n_entities, count(CASE WHEN state <> 'not_assayed' THEN 1 END) AS n_measured FROM coverage_long GROUP BY 1, 2)"


@query("d1_coverage2", "SELECT e.entity, CASE WHEN t.entity IS NULL THEN 'not_assayed' ELSE 'measured' END AS state FROM entities e LEFT JOIN (SELECT DISTINCT entity FROM treatments) t ON e.entity = t.entity")
def _(b):
    return op.coverage2(b("entities").select("entity"), b("treatments"))


@query("d2_coverage3", """SELECT entity, mutations_state AS state FROM coverage""")
def _(b):
    e = b("entities")
    return op.coverage3(e.select("entity"), e.where("acctbal >= 0"), b("mutations"))


@query("d3_layer_count", "SELECT entity, CAST(sum(CASE WHEN state <> 'not_assayed' THEN 1 ELSE 0 END) AS INT) AS n_layers FROM coverage_long GROUP BY entity")
def _(b):
    return op.layer_count(b("coverage"), STATES).select("entity", "n_layers")


@query("d4_coverage_counts", "SELECT layer || '_state' AS column_name, state, count(*) AS n FROM coverage_long GROUP BY layer, state")
def _(b):
    return op.coverage_counts(b("coverage"), STATES)


@query("d5_group_coverage", f"WITH {GC} SELECT *, round(CAST(n_measured AS DOUBLE) / n_entities, 4) AS fraction, n_entities < 15 AS low_n FROM gc")
def _(b):
    return op.group_coverage(b("coverage_long"))


@query("d6_presence_patterns", """WITH p AS (SELECT entity, concat_ws('+', """ + ", ".join(f"CASE WHEN {s} <> 'not_assayed' THEN '{s[:-6]}' END" for s in STATES) + """) AS pattern FROM coverage),
    l AS (SELECT entity, CAST(sum(CASE WHEN state <> 'not_assayed' THEN 1 ELSE 0 END) AS INT) AS n_layers FROM coverage_long GROUP BY entity)
    SELECT pattern, n_layers, count(*) AS n, round(100.0E0 * count(*) / (SELECT count(*) FROM coverage), 4) AS share_pct FROM p JOIN l ON p.entity = l.entity GROUP BY 1, 2""")
def _(b):
    return op.presence_patterns(b("coverage"), STATES)


@query("d7_co_presence", "SELECT protein_state <> 'not_assayed' AS has_a, mutations_state <> 'not_assayed' AS has_b, count(*) AS n FROM coverage GROUP BY CUBE(1, 2)")
def _(b):
    return op.co_presence(b("coverage"), "protein_state", "mutations_state")


@query("d8_route_cohorts", f"""WITH {READY}, q AS (SELECT question, count(*) AS n_spine, count(CASE WHEN ready THEN 1 END) AS n_ready FROM rdy GROUP BY 1),
    k AS (SELECT d.question, d.layer, count(CASE WHEN c.state <> 'not_assayed' THEN 1 END) AS k FROM coverage_long c JOIN defs d ON c.layer = d.layer GROUP BY 1, 2),
    m AS (SELECT question, count(*) AS n_layers, min(k) AS n_limiting FROM k GROUP BY 1)
    SELECT q.question, q.n_spine, q.n_ready, m.n_layers, m.n_limiting, (SELECT min(layer) FROM k WHERE k.question = q.question AND k.k = m.n_limiting) AS limiting_layer,
      round(100.0E0 * n_ready / n_spine, 4) AS pct_of_spine, round(100.0E0 * n_ready / n_limiting, 4) AS retention_pct FROM q JOIN m ON q.question = m.question""")
def _(b):
    return op.route_cohorts(b("coverage_long"), QUESTIONS)


@query("d9_waterfall", f"""WITH {DEFS}, st AS (SELECT 0 AS step, 'spine' AS layer UNION ALL SELECT step, layer FROM defs WHERE question = 'multi'),
    lost AS (SELECT c.entity, coalesce(min(CASE WHEN c.state = 'not_assayed' THEN d.step END), 5) AS s FROM coverage_long c JOIN defs d ON c.layer = d.layer AND d.question = 'multi' GROUP BY 1),
    n AS (SELECT st.step, st.layer, (SELECT count(*) FROM lost WHERE lost.s > st.step) AS n_left FROM st)
    SELECT step, layer, n_left, coalesce(lag(n_left) OVER (ORDER BY step) - n_left, 0) AS n_lost FROM n""")
def _(b):
    return op.waterfall(b("coverage_long"), QUESTIONS["multi"])


@query("d10_share_shift", f"""WITH {GRP}, s AS (SELECT *, 100.0E0 * n_group / sum(n_group) OVER (PARTITION BY question) AS sp, 100.0E0 * n_ready / sum(n_ready) OVER (PARTITION BY question) AS cp FROM g)
    SELECT question, grp, n_group, n_ready, round(sp, 6) AS spine_pct, round(cp, 6) AS cohort_pct, round(cp - sp, 6) AS shift_pp FROM s""")
def _(b):
    return op.share_shift(b("coverage_long"), QUESTIONS)


@query("d11_suitability", f"""WITH {GRP} SELECT question, count(CASE WHEN n_ready >= 30 THEN 1 END) AS groups_30_or_more, count(CASE WHEN n_ready BETWEEN 15 AND 29 THEN 1 END) AS groups_15_to_29,
    count(CASE WHEN n_ready < 15 THEN 1 END) AS groups_below_15, max(n_ready) AS largest_group FROM g GROUP BY question""")
def _(b):
    return op.suitability(b("coverage_long"), QUESTIONS)


CONC = f"""{GC}, r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n_measured DESC, grp) AS rn FROM gc),
    cc AS (SELECT layer, CAST(sum(CASE WHEN rn <= 3 THEN n_measured END) AS DOUBLE) / sum(n_measured) AS ts, CAST(sum(CASE WHEN rn <= 3 THEN n_entities END) AS DOUBLE) / sum(n_entities) AS es FROM r GROUP BY layer)"""


@query("d12_concentration", f"WITH {CONC} SELECT layer, round(ts, 6) AS top_share, round(es, 6) AS expected_share, round(ts / es, 6) AS ratio FROM cc")
def _(b):
    return op.concentration(b("coverage_long"))


@query("d13_small_cells", f"WITH {GC} SELECT grp, layer, n_entities, n_measured FROM gc WHERE n_entities >= 290 AND n_measured < 270")
def _(b):
    return op.small_cells(b("coverage_long"), 290, 270)


_SETS = {"expression": "cells", "dna": "entities WHERE acctbal >= 0", "fusion_assay": "entities WHERE acctbal <= 8000", "effect": "dependency WHERE value > 0.5", "dependency": "dependency WHERE value < -0.8", "copy_number": "copy_number WHERE value > 1.4"}


@query("d14_entity_master", "WITH " + ", ".join(f"s_{n} AS (SELECT DISTINCT entity FROM {t})" for n, t in _SETS.items()) + """, mc AS (SELECT entity, count(*) AS n FROM mutations GROUP BY entity)
    SELECT e.entity, """ + ", ".join(f"CAST(CASE WHEN s_{n}.entity IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_{n}" for n in _SETS) + """, coalesce(mc.n, 0) AS n_mutations,
      CASE WHEN s_fusion_assay.entity IS NOT NULL THEN 1 ELSE 0 END AS eligible_direct, CASE WHEN s_effect.entity IS NOT NULL AND s_dependency.entity IS NOT NULL THEN 1 ELSE 0 END AS eligible_codependency,
      CASE WHEN s_effect.entity IS NOT NULL AND (s_expression.entity IS NOT NULL OR s_copy_number.entity IS NOT NULL OR s_dna.entity IS NOT NULL) THEN 1 ELSE 0 END AS eligible_conditional
    FROM entities e """ + " ".join(f"LEFT JOIN s_{n} ON s_{n}.entity = e.entity" for n in _SETS) + " LEFT JOIN mc ON mc.entity = e.entity")
def _(b):
    e, d = b("entities"), b("dependency")
    sets = {"expression": b("cells"), "dna": e.where("acctbal >= 0"), "fusion_assay": e.where("acctbal <= 8000"), "effect": d.where("value > 0.5"),
            "dependency": d.where("value < -0.8"), "copy_number": b("copy_number").where("value > 1.4")}
    return op.entity_master(e.select("entity"), {k: v.select("entity") for k, v in sets.items()}, {"mutations": b("mutations").select("entity")})


@query("d15_screen_context", f"""SELECT o_custkey AS entity, count(*) AS n_screens, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_passing, CAST(bool_or(o_orderstatus = 'F') AS INT) AS any_passes,
    CAST(bool_and(o_orderstatus = 'F') AS INT) AS all_pass, {rd('avg(o_totalprice)', 6)} AS mean_score, {rd('quantile_cont(o_totalprice, 0.5)', 6)} AS median_doubling,
    string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS libraries, count(DISTINCT o_orderpriority) AS n_libraries FROM orders GROUP BY 1""")
def _(b):
    s = b("orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderstatus") == "F").alias("passes"), F.col("o_totalprice").alias("score"), F.col("o_totalprice").alias("doubling"), F.col("o_orderpriority").alias("library"))
    return op.screen_context(s).withColumn("mean_score", F.round("mean_score", 6)).withColumn("median_doubling", F.round("median_doubling", 6))


@query("d16_admission_gate", f"""WITH {CONC}, m AS (SELECT layer, layer <> 'fusions' AS addressable, round(CAST(sum(n_measured) AS DOUBLE) / sum(n_entities), 6) AS coverage, count(CASE WHEN n_measured >= 230 THEN 1 END) AS n_calibratable FROM gc GROUP BY layer)
    SELECT m.layer, m.addressable, m.coverage, round(ts / es, 6) AS bias_ratio, m.n_calibratable, CASE WHEN NOT addressable THEN 'reject: no feature key' WHEN coverage < 0.6 THEN 'defer: low coverage'
      WHEN round(ts / es, 6) > 1.02 THEN 'defer: concentrated' WHEN n_calibratable < 5 THEN 'defer: not calibratable' ELSE 'admit' END AS verdict FROM m JOIN cc ON m.layer = cc.layer""")
def _(b):
    long = b("coverage_long")
    per = op.group_coverage(long).groupBy("layer").agg(
        F.round(F.sum("n_measured").cast("double") / F.sum("n_entities"), 6).alias("coverage"), F.count(F.when(F.col("n_measured") >= 230, 1)).alias("n_calibratable"))
    metrics = per.join(op.concentration(long).select("layer", F.col("ratio").alias("bias_ratio")), "layer").withColumn("addressable", F.col("layer") != "fusions")
    return op.admission_gate(metrics, 0.6, 1.02, 5)


@query("d17_assay_combinations", "SELECT o_custkey AS entity, count(*) AS n_samples, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS combination FROM orders GROUP BY 1")
def _(b):
    return op.assay_combinations(b("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("datatype")))

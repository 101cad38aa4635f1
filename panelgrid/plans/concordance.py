"""Registered queries for concordance and multi-layer profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import concordance as op
from panelgrid.plans.registry import query, rd
from panelgrid.plans.relations import rho_sql

RHO = f"xy AS (SELECT entity, feature, rna AS x, hpa AS y FROM cells WHERE hpa IS NOT NULL), {rho_sql('xy', 'entity', 'x', 'y', 'k0')}, kc AS (SELECT entity, {rd('rho', 8)} AS rho, n AS n_features FROM k0 WHERE n >= 12)"


def scored(b):
    return op.entity_concordance(b("expression_rna"), b("expression_rna_hpa"), 12)


@query("k1_entity_concordance", f"WITH {RHO} SELECT * FROM kc")
def _(b):
    return scored(b)


@query("k2_summarise_rho", f"WITH {RHO} SELECT count(rho) AS n_scored, {rd('quantile_cont(rho, 0.5)', 4)} AS median_rho, {rd('quantile_cont(rho, 0.25)', 4)} AS iqr_low, {rd('quantile_cont(rho, 0.75)', 4)} AS iqr_high, (SELECT count(DISTINCT entity) FROM xy) AS n_overlap FROM kc WHERE rho IS NOT NULL")
def _(b):
    overlap = b("expression_rna_hpa").agg(F.count_distinct("entity")).scalar()
    return op.summarise_rho(scored(b), overlap)


@query("k3_rho_by_group", f"WITH {RHO} SELECT e.grp, {rd('quantile_cont(rho, 0.5)')} AS median_rho, count(*) AS n FROM kc JOIN entities e ON e.entity = kc.entity WHERE rho IS NOT NULL GROUP BY 1 HAVING count(*) >= 30")
def _(b):
    return op.rho_by_group(scored(b), b("entities"))


@query("k4_detection_gap", f"""WITH r AS (SELECT detected, rna, rank() OVER (ORDER BY rna) + (count(*) OVER (PARTITION BY rna) - 1) / 2.0 AS rk FROM cells), s AS (SELECT count(CASE WHEN detected THEN 1 END) AS n1, count(CASE WHEN NOT detected THEN 1 END) AS n2, sum(CASE WHEN detected THEN rk END) AS r1,
      quantile_cont(CASE WHEN detected THEN rna END, 0.5) AS m1, quantile_cont(CASE WHEN NOT detected THEN rna END, 0.5) AS m2 FROM r)
    SELECT n1 AS n_detected, n2 AS n_undetected, {rd('m1')} AS median_detected, {rd('m2')} AS median_undetected, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS u, {rd('(r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n2)', 8)} AS effect_size FROM s""")
def _(b):
    return op.detection_gap(b("cells").select("rna", "detected"), "rna", "detected")


XY = "lx AS (SELECT c.entity, c.feature, e.grp, c.copy_number AS x, c.rna AS y FROM cells c JOIN entities e ON e.entity = c.entity)"


def grouped_cells(b):
    return b("cells").join(b("entities").select("entity", "grp"), "entity")


@query("k5_layer_correlation", f"""WITH {XY}, la AS (SELECT * FROM (SELECT *, {rd('x - quantile_cont(x, 0.5) OVER (PARTITION BY feature, grp)')} AS xa, {rd('y - quantile_cont(y, 0.5) OVER (PARTITION BY feature, grp)')} AS ya, count(*) OVER (PARTITION BY feature, grp) AS gn FROM lx) q WHERE gn >= 15),
    {rho_sql('lx', 'feature', 'x', 'y', 'r1')}, {rho_sql('la', 'feature', 'xa', 'ya', 'r2')} SELECT r1.feature, r1.n, {rd('r1.rho', 8)} AS rho, coalesce(r2.n, 0) AS n_adjusted, CASE WHEN r2.n >= 30 THEN {rd('r2.rho', 8)} END AS adjusted_rho FROM r1 LEFT JOIN r2 ON r2.feature = r1.feature""")
def _(b):
    return op.layer_correlation(grouped_cells(b), "copy_number", "rna")


@query("k6_chain_consistency", f"""WITH f AS (SELECT * FROM cells WHERE detected), {rho_sql('f', 'feature', 'copy_number', 'rna', 'r1')}, {rho_sql('f', 'feature', 'rna', 'zscore', 'r2')}, {rho_sql('f', 'feature', 'copy_number', 'zscore', 'r3')}
    SELECT r1.feature, r1.n, {rd('r1.rho', 8)} AS rho_ab, {rd('r2.rho', 8)} AS rho_bc, {rd('r3.rho', 8)} AS rho_ac, r1.rho > 0 AND r2.rho > 0 AS consistent FROM r1 JOIN r2 ON r2.feature = r1.feature JOIN r3 ON r3.feature = r1.feature WHERE r1.n >= 30""")
def _(b):
    return op.chain_consistency(b("cells").withColumn("protein", F.when(F.col("detected"), F.col("zscore"))), "copy_number", "rna", "protein")


@query("k7_event_effect", f"""WITH a AS (SELECT entity FROM entities WHERE acctbal >= 0), m AS (SELECT entity, feature, true AS any_event, bool_or(is_driver OR is_hotspot) AS driver FROM mutations GROUP BY 1, 2),
    v AS (SELECT c.feature, c.rna AS value, d.definition, CASE d.definition WHEN 'any' THEN coalesce(m.any_event, false) ELSE coalesce(m.driver, false) END AS altered FROM cells c JOIN a ON a.entity = c.entity LEFT JOIN m ON m.entity = c.entity AND m.feature = c.feature, (VALUES ('any'), ('driver')) d(definition)),
    r AS (SELECT *, rank() OVER (PARTITION BY feature, definition ORDER BY value) + (count(*) OVER (PARTITION BY feature, definition, value) - 1) / 2.0 AS rk FROM v),
    s AS (SELECT feature, definition, count(CASE WHEN altered THEN 1 END) AS n1, count(CASE WHEN NOT altered THEN 1 END) AS n2, sum(CASE WHEN altered THEN rk END) AS r1, quantile_cont(CASE WHEN altered THEN value END, 0.5) - quantile_cont(CASE WHEN NOT altered THEN value END, 0.5) AS md FROM r GROUP BY 1, 2)
    SELECT feature, definition, n1 AS n_altered, n2 AS n_reference, {rd('md')} AS median_difference, {rd('2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n2) - 1.0', 8)} AS rank_biserial FROM s""")
def _(b):
    return op.event_effect(b("expression_rna"), b("mutations"), {"any": F.lit(True), "driver": F.col("is_driver") | F.col("is_hotspot")}, b("entities").where("acctbal >= 0"))


@query("k8_value_by_state", f"SELECT feature, CASE WHEN copy_number <= 0.7 THEN 'loss' WHEN copy_number >= 1.3 THEN 'gain' ELSE 'reference' END AS state, {rd('quantile_cont(rna, 0.5)')} AS median_value, count(*) AS n FROM cells GROUP BY 1, 2")
def _(b):
    return op.value_by_state(b("cells"), "copy_number", "rna", 0.7, 1.3)


_COLS = ["rna", "hpa", "geo", "zscore", "effect", "copy_number"]


@query("k9_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, count(*) AS n, {rd(f'covar_pop({a}, {c}) / (stddev_pop({a}) * stddev_pop({c}))', 8)} AS r FROM cells WHERE {a} IS NOT NULL AND {c} IS NOT NULL" for i, a in enumerate(_COLS) for c in _COLS[i + 1:]))
def _(b):
    return op.correlation_matrix(b("cells"), _COLS)


# Mean value of each feature by nation: a matrix without gaps. Components come from power iteration, the second one after the first is taken out.
_MATRIX = """mx AS (SELECT c.c_nationkey AS entity, x.feature, avg(x.value) AS value FROM expression_rna x JOIN customer c ON c.c_custkey = x.entity GROUP BY 1, 2),
    ft AS (SELECT feature FROM mx GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT entity) FROM mx)),
    cn AS (SELECT entity, feature, value - avg(value) OVER (PARTITION BY feature) AS x, row_number() OVER (PARTITION BY entity ORDER BY feature) AS i FROM mx SEMI JOIN ft USING (feature)),
    cv AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM cn a JOIN cn b USING (entity) GROUP BY 1, 2),
    ma AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY 1) q), tr AS (SELECT sum(c) AS t FROM cv WHERE i = j)"""


def _power(name: str, matrix: str) -> str:
    step = "list_transform(m, lambda r: list_inner_product(r, v))"
    return f"""{name}_it(n, v) AS (SELECT 0, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i) FROM {matrix} UNION ALL SELECT n + 1, list_transform({step}, lambda x: x / sqrt(list_inner_product({step}, {step}))) FROM {name}_it, {matrix} WHERE n < 3000),
    {name} AS (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS value FROM {name}_it, {matrix} WHERE n = 3000)"""


_PCA = f"""RECURSIVE {_MATRIX}, {_power('e1', 'ma')},
    mb AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - value * v[i] * v[j])) AS m FROM ma, e1), {_power('e2', 'mb')}"""


def _pca(b):
    rows = b("expression_rna").join(b("customer").select(F.col("c_custkey").alias("entity"), "c_nationkey"), "entity")
    return op.pca(rows.groupBy(F.col("c_nationkey").alias("entity"), "feature").agg(F.avg("value").alias("value")))


@query("k10_pca", f"WITH {_PCA} SELECT entity, round(pow(list_inner_product(xs, e1.v), 2), 5) AS squared_1, round(pow(list_inner_product(xs, e2.v), 2), 5) AS squared_2 FROM (SELECT entity, list(x ORDER BY i) AS xs FROM cn GROUP BY 1) q, e1, e2")
def _(b):
    return _pca(b)[0].select("entity", *[F.round(F.pow(f"pc{i}", F.lit(2.0)), 5).alias(f"squared_{i}") for i in (1, 2)])


@query("k10_pca_loadings", f"""WITH {_PCA}, fl AS (SELECT list(feature ORDER BY feature) AS f FROM ft), lo AS (SELECT 1 AS component, f, v, value FROM e1, fl UNION ALL SELECT 2, f, v, value FROM e2, fl)
    SELECT component, unnest(f) AS feature, round(abs(unnest(v)), 6) AS loading, round(value / t, 6) AS explained FROM lo, tr""")
def _(b):
    return _pca(b)[1].select("component", "feature", F.round(F.abs("loading"), 6).alias("loading"), F.round("explained", 6).alias("explained"))


@query("k11_overlap_spearman", f"WITH o AS (SELECT 1 AS k, zscore AS x, effect AS y FROM cells WHERE detected), {rho_sql('o', 'k', 'x', 'y', 'r')} SELECT n, {rd('rho', 8)} AS rho FROM r")
def _(b):
    return op.overlap_spearman(b("protein").where("detected"), b("dependency"))


_LAYERS = {"rna": ("rna", "log2(value+1)"), "rna_hpa": ("hpa", "log2(value+1)"), "dependency": ("effect", "effect score"), "copy_number": ("copy_number", "relative copies")}


@query("k12_feature_all_layers", " UNION ALL ".join(f"SELECT '{n}' AS layer, '{u}' AS unit, entity, {c} AS value FROM cells WHERE feature = 'F07' AND {c} IS NOT NULL" for n, (c, u) in _LAYERS.items()))
def _(b):
    names = {"rna": "expression_rna", "rna_hpa": "expression_rna_hpa", "dependency": "dependency", "copy_number": "copy_number"}
    return op.feature_all_layers({n: (b(names[n]), u) for n, (_c, u) in _LAYERS.items()}, "F07")

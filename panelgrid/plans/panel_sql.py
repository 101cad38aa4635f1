"""SQL equivalents of the panel plan, as WITH parts that other queries extend."""

from __future__ import annotations

from panelgrid.operators.score import EVENT_TABLE, LAYERS, Panel, Scenario
from panelgrid.plans.registry import rd


def panel_values(panels: list[Panel]) -> str:
    rows = [f"('{p.query_id}', {i}, '{f}', '{r}', {'NULL' if p.group is None else repr(p.group)}, {len(p.items)})" for p in panels for i, (f, r) in enumerate(p.items)]
    return "panel AS (SELECT query_id, CAST(ordinal AS INT) AS ordinal, feature, role, CAST(want AS VARCHAR) AS want, m_all FROM (VALUES " + ", ".join(rows) + ") t(query_id, ordinal, feature, role, want, m_all))"


def scenario_values(scenarios: list[Scenario] | None = None) -> str:
    rows = []
    for s in scenarios or [Scenario()]:
        w = ", ".join(f"{s.weights.get(layer, 0.0)!r}::DOUBLE" for layer in LAYERS)
        rows.append(f"('{s.scenario_id}', {w}, {s.min_group_n}, {s.min_calibration_n}, {s.insufficient_fraction!r}::DOUBLE, {s.fraction_threshold!r}::DOUBLE, "
                    f"{s.strong_cutoff!r}::DOUBLE, {s.broad_fraction!r}::DOUBLE, {s.high_min_layers}, {s.moderate_min_layers})")
    return "scen AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(scenario_id, " + ", ".join(f"w_{layer}" for layer in LAYERS) + (
        ", min_group_n, min_calibration_n, insufficient_fraction, fraction_threshold, strong_cutoff, broad_fraction, high_min, moderate_min))")


def lt4(expr: str) -> str:
    return f"{rd(f'quantile_cont({expr}, 0.1)', 4)} AS L, {rd(f'quantile_cont({expr}, 0.9)', 4)} AS T, count({expr}) AS n"


def gated(expr: str) -> str:
    return f"HAVING quantile_cont({expr}, 0.9) > quantile_cont({expr}, 0.1)"


def ramp(y: str, low: str, high: str, role: str) -> str:
    f = f"least(greatest(({y} - {low}) / nullif({high} - {low}, 0), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"CASE WHEN {y} IS NOT NULL AND {high} > {low} THEN CASE WHEN {role} = 'exclusion' THEN 1.0::DOUBLE - {f} ELSE {f} END END"


EVENT_CASE = "CASE " + " ".join(
    f"WHEN mutation_category = '{c}' AND cls = '{k}' THEN CASE WHEN role = 'inclusion' THEN {i}::DOUBLE ELSE {x}::DOUBLE END" for c, k, i, x in EVENT_TABLE) + " END"

GLOBAL_CONSTANTS = f"""kg AS (SELECT scen.scenario_id, q.* FROM (SELECT feature, {lt4('rna')} FROM cells GROUP BY feature {gated('rna')}) q, scen)"""


def panel_ctes(panels: list[Panel], scenarios: list[Scenario] | None = None, candidates: str = "SELECT entity, grp, grp AS cal_grp, mutations_state, fusions_state FROM coverage",
               global_constants: str = GLOBAL_CONSTANTS, candidate_join: str = "true", panel: str | None = None, scenario: str | None = None) -> str:
    """WITH parts ending in `sf` (scored grid), `sc` (scores) and `parted` inputs; `panel` and `scenario` replace the listed values."""
    top = " + ".join(f"coalesce(w{i} * d_{layer}, 0.0)" for i, layer in enumerate(LAYERS))
    bottom = " + ".join(f"CASE WHEN d_{layer} IS NOT NULL THEN w{i} ELSE 0.0 END" for i, layer in enumerate(LAYERS))
    n_layers = "(" + " + ".join(f"CASE WHEN d_{layer} IS NOT NULL THEN 1 ELSE 0 END" for layer in LAYERS) + ")"
    weights = ", ".join(f"w_{layer} AS w{i}" if layer != "fusion" else
                        f"CASE WHEN s_fusion = 'measured' THEN {1/15!r}::DOUBLE * CASE WHEN any_confident AND any_in_frame THEN 1.0 WHEN any_confident OR any_in_frame THEN 0.5 ELSE 0.25 END "
                        f"WHEN role = 'exclusion' AND s_fusion = 'measured_absent' THEN 0.0 ELSE w_fusion END AS w{i}" for i, layer in enumerate(LAYERS))
    return f"""{panel or panel_values(panels)}, {scenario or scenario_values(scenarios)},
    pf AS (SELECT DISTINCT feature FROM panel),
    {global_constants},
    kl AS (SELECT e.grp, c.feature, {lt4('c.rna')} FROM cells c JOIN entities e ON c.entity = e.entity WHERE c.feature IN (SELECT feature FROM pf) GROUP BY e.grp, c.feature {gated('c.rna')}),
    ke AS (SELECT feature, {lt4('-effect')} FROM cells GROUP BY feature {gated('-effect')}),
    kc AS (SELECT feature, {lt4('copy_number')} FROM cells GROUP BY feature {gated('copy_number')}),
    kp AS (SELECT {lt4('zscore')} FROM cells WHERE detected),
    kb AS (SELECT s.scenario_id, c.feature, avg(CASE WHEN c.effect < s.strong_cutoff THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS broad FROM cells c, scen s GROUP BY s.scenario_id, c.feature, s.min_calibration_n, s.broad_fraction, s.strong_cutoff
      HAVING count(*) >= s.min_calibration_n AND CAST(count(CASE WHEN c.effect < s.strong_cutoff THEN 1 END) AS DOUBLE) / count(*) >= s.broad_fraction),
    mv AS (SELECT entity, feature, bool_or(is_driver OR is_hotspot) AS drv, bool_or(impact = 'HIGH') AS hi, bool_or(impact = 'MODERATE') AS md FROM mutations GROUP BY 1, 2),
    fv AS (SELECT entity, feature, count(*) AS n_fusions, bool_or(confidence_high) AS any_confident, bool_or(in_frame) AS any_in_frame FROM fusions GROUP BY 1, 2),
    pr AS (SELECT a.feature AS a, b.feature AS b, x.rna AS x, y.rna AS y FROM (SELECT DISTINCT p.feature, q.feature AS other FROM panel p JOIN panel q ON p.query_id = q.query_id AND p.feature < q.feature) a
      JOIN pf b ON a.other = b.feature JOIN cells x ON x.feature = a.feature JOIN cells y ON y.feature = b.feature AND y.entity = x.entity),
    prk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pr),
    rho AS (SELECT a, b, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho, count(*) AS n FROM prk GROUP BY a, b),
    rb AS (SELECT p.query_id, p.feature, p.m_all, avg(r.rho) AS mean_rho FROM panel p LEFT JOIN panel q ON p.query_id = q.query_id AND p.feature <> q.feature
      LEFT JOIN rho r ON r.a = least(p.feature, q.feature) AND r.b = greatest(p.feature, q.feature) GROUP BY 1, 2, 3),
    cw AS (SELECT query_id, feature, CASE WHEN mean_rho IS NOT NULL THEN greatest(mean_rho, 0.0) END AS rho_bar, coalesce(1.0 / (1.0 + (m_all - 1) * greatest(mean_rho, 0.0)), 1.0) AS weight FROM rb),
    me AS (SELECT query_id, {rd('sum(weight)')} AS m_eff FROM cw GROUP BY query_id),
    g AS (SELECT s.*, p.query_id, p.ordinal, p.feature, p.role, c.entity, c.grp, c.cal_grp, c.mutations_state, c.fusions_state FROM ({candidates}) c JOIN panel p ON p.want IS NULL OR p.want = c.grp JOIN scen s ON {candidate_join}),
    j AS (SELECT g.*, coalesce(r.gene_class, 'unknown') AS cls, x.rna, x.hpa, x.geo, x.zscore, x.detected, x.effect, x.copy_number, f.n_fusions, f.any_confident, f.any_in_frame, kb.broad,
        kg.L AS gl, CASE WHEN kl.n >= g.min_group_n THEN kl.L ELSE kg.L END AS lo, CASE WHEN kl.n >= g.min_group_n THEN kl.T ELSE kg.T END AS hi_t, kp.L AS pl, kp.T AS pt,
        CASE WHEN ke.n >= g.min_calibration_n THEN ke.L END AS el, CASE WHEN ke.n >= g.min_calibration_n THEN ke.T END AS et, CASE WHEN kc.n >= g.min_calibration_n THEN kc.L END AS cl, CASE WHEN kc.n >= g.min_calibration_n THEN kc.T END AS ct,
        CASE WHEN coalesce(g.mutations_state, 'not_assayed') = 'not_assayed' THEN 'no_sequencing' WHEN mv.drv IS NULL THEN 'none_sequenced_clean' WHEN mv.drv THEN 'driver_hotspot' WHEN mv.hi THEN 'high_lof' WHEN mv.md THEN 'moderate_vus' ELSE 'low_or_modifier' END AS mutation_category,
        CASE WHEN coalesce(g.fusions_state, 'not_assayed') = 'not_assayed' THEN 'not_assayed' WHEN f.n_fusions > 0 THEN 'measured' ELSE 'measured_absent' END AS s_fusion
      FROM g JOIN kp ON true LEFT JOIN cells x ON x.entity = g.entity AND x.feature = g.feature LEFT JOIN mv ON mv.entity = g.entity AND mv.feature = g.feature LEFT JOIN fv f ON f.entity = g.entity AND f.feature = g.feature
        LEFT JOIN kg ON kg.feature = g.feature AND kg.scenario_id = g.scenario_id LEFT JOIN kl ON kl.feature = g.feature AND kl.grp = g.cal_grp LEFT JOIN ke ON ke.feature = g.feature LEFT JOIN kc ON kc.feature = g.feature
        LEFT JOIN kb ON kb.feature = g.feature AND kb.scenario_id = g.scenario_id LEFT JOIN roles r ON r.feature = g.feature),
    d AS (SELECT *, {ramp('rna', 'lo', 'hi_t', 'role')} AS d_rna, CASE WHEN detected THEN {ramp('zscore', 'pl', 'pt', 'role')} END AS d_protein,
        CASE WHEN broad IS NULL THEN {ramp('(-effect)', 'el', 'et', 'role')} END AS d_dependency,
        CASE WHEN cls <> 'unknown' THEN {ramp('copy_number', 'cl', 'ct', "CASE WHEN cls = 'oncogene' THEN role WHEN role = 'inclusion' THEN 'exclusion' ELSE 'inclusion' END")} END AS d_copy_number,
        {EVENT_CASE} AS d_mutation, CASE s_fusion WHEN 'measured' THEN CASE WHEN role = 'inclusion' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 'measured_absent' THEN CASE WHEN role = 'inclusion' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS d_fusion,
        CASE WHEN rna IS NOT NULL THEN 'measured' ELSE 'not_assayed' END AS s_rna, CASE WHEN zscore IS NULL THEN 'not_assayed' WHEN detected THEN 'measured' ELSE 'non_detected' END AS s_protein,
        CASE WHEN effect IS NULL THEN 'not_assayed' WHEN broad IS NOT NULL THEN 'excluded_pan_essential' ELSE 'measured' END AS s_dependency, CASE WHEN copy_number IS NOT NULL THEN 'measured' ELSE 'not_assayed' END AS s_copy_number,
        CASE mutation_category WHEN 'no_sequencing' THEN 'not_assayed' WHEN 'none_sequenced_clean' THEN 'measured_absent' ELSE 'measured' END AS s_mutation FROM j),
    dw AS (SELECT *, {weights} FROM d),
    sf AS (SELECT *, CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END AS d_gene, {n_layers} AS nl FROM dw),
    ag AS (SELECT sf.scenario_id, sf.query_id, sf.entity, any_value(sf.grp) AS grp, any_value(insufficient_fraction) AS insf, any_value(fraction_threshold) AS thr, count(d_gene) AS m,
        count(CASE WHEN d_gene IS NOT NULL AND nl >= high_min THEN 1 END) AS nh, count(CASE WHEN d_gene IS NOT NULL AND nl >= moderate_min THEN 1 END) AS nm,
        coalesce(avg(CASE WHEN role = 'inclusion' THEN CASE WHEN d_gene IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 1.0) AS abstained,
        min(CASE WHEN d_gene = 0 AND cw.weight > 0 THEN ordinal END) AS veto_at, exp(sum(CASE WHEN d_gene > 0 THEN cw.weight * ln(d_gene) END) / sum(CASE WHEN d_gene IS NOT NULL THEN cw.weight END)) AS mean_d,
        CASE WHEN count(CASE WHEN d_rna IS NOT NULL AND hpa IS NOT NULL THEN 1 END) > 0 THEN bool_and(CASE WHEN d_rna IS NOT NULL AND hpa IS NOT NULL THEN coalesce((rna >= gl) = (hpa > 0), true) END) END AS hpa_agreement,
        CASE WHEN count(CASE WHEN d_rna IS NOT NULL AND geo IS NOT NULL THEN 1 END) > 0 THEN bool_and(CASE WHEN d_rna IS NOT NULL AND geo IS NOT NULL THEN coalesce((rna >= gl) = (geo > 0), true) END) END AS geo_agreement
      FROM sf JOIN cw ON cw.query_id = sf.query_id AND cw.feature = sf.feature GROUP BY 1, 2, 3),
    sc AS (SELECT ag.scenario_id, ag.query_id, ag.entity, ag.grp, CASE WHEN m > 0 THEN CASE WHEN veto_at IS NOT NULL THEN 0.0::DOUBLE ELSE {rd('mean_d', 10)} END END AS D,
        CASE WHEN abstained >= insf OR m = 0 THEN 'Insufficient' WHEN CAST(nh AS DOUBLE) / m >= thr AND coalesce(hpa_agreement, true) THEN 'High' WHEN CAST(nm AS DOUBLE) / m >= thr THEN 'Moderate' ELSE 'Low' END AS tier,
        p.feature AS veto_feature, CASE p.role WHEN 'exclusion' THEN 'exclusion_expressed' WHEN 'inclusion' THEN 'inclusion_below_floor' END AS veto_reason, hpa_agreement, geo_agreement, m, me.m_eff, abstained
      FROM ag LEFT JOIN panel p ON p.query_id = ag.query_id AND p.ordinal = ag.veto_at JOIN me ON me.query_id = ag.query_id)"""


def parted_cte(top_n: int = 10) -> str:
    return f"""pl AS (SELECT *, coalesce(tier IN ('High', 'Moderate') AND D > 0 AND veto_feature IS NULL, false) AS listed FROM sc),
    pn AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, query_id, listed ORDER BY D DESC, entity) AS place FROM pl),
    parted AS (SELECT scenario_id, query_id, entity, grp, D, tier, veto_feature, veto_reason, hpa_agreement, geo_agreement, m, m_eff, abstained, CASE WHEN listed AND place <= {top_n} THEN CAST(place AS INT) END AS rank,
      CASE WHEN D IS NULL OR tier = 'Insufficient' THEN 'insufficient' WHEN D <= 0 OR veto_feature IS NOT NULL THEN 'disqualified' WHEN tier = 'Low' THEN 'low_confidence' WHEN listed AND place <= {top_n} THEN 'ranked' ELSE 'ranked_beyond_top_n' END AS bucket FROM pn)"""

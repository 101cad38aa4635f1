"""Registered queries for pairwise relationship evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import relations as op
from panelgrid.plans.registry import query, rd
from panelgrid.session import stage
from panelgrid.sources import sinks

TASKS = [("t1", "F03", "F10"), ("t2", "F07", "F12"), ("t3", "F15", "F04")]
TASK_SQL = "tasks AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}', '{b}')" for t, a, b in TASKS) + ") t(task, a, b))"
SPINE = "spine AS (SELECT e.entity, e.grp, e.is_problematic, c.mutations_state, c.fusions_state FROM entities e JOIN coverage c ON c.entity = e.entity)"
MUT = "hits AS (SELECT entity, feature, bool_or(is_driver OR is_hotspot OR impact = 'HIGH') AS hit FROM mutations GROUP BY 1, 2)"
EVENT = f"""{TASK_SQL}, {SPINE}, {MUT}, ev0 AS (SELECT t.task, t.b, s.entity, s.grp, s.is_problematic, CASE WHEN coalesce(h.hit, false) THEN 'context' ELSE 'reference' END AS context FROM spine s JOIN tasks t ON true
      LEFT JOIN hits h ON h.entity = s.entity AND h.feature = t.a WHERE s.mutations_state <> 'not_assayed'),
    ev AS (SELECT v.task, v.entity, v.grp, v.context, x.effect AS value FROM ev0 v JOIN cells x ON x.entity = v.entity AND x.feature = v.b WHERE NOT v.is_problematic)"""


def adj(src: str, out: str = "adj", min_n: int = 15, extra: str = "") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, {rd(f"value - quantile_cont(value, 0.5) OVER (PARTITION BY {extra}task, grp)")} AS value_adj, count(*) OVER (PARTITION BY {extra}task, grp) AS group_n FROM {src}) q WHERE group_n >= {min_n})"""


def med(value: str, side: str) -> str:
    return f"quantile_cont(CASE WHEN context = '{side}' THEN {value} END, 0.5)"


def shift(value: str) -> str:
    return rd(f"{med(value, 'reference')} - {med(value, 'context')}")


HIGH = f"""{TASK_SQL}, {SPINE}, hv AS (SELECT t.task, s.entity, s.grp, x.rna AS source_value, y.effect AS value FROM tasks t JOIN cells x ON x.feature = t.a JOIN cells y ON y.feature = t.b AND y.entity = x.entity JOIN spine s ON s.entity = x.entity WHERE NOT s.is_problematic),
    hq AS (SELECT task, grp, count(*) AS n, {rd('quantile_cont(source_value, 0.2)')} AS q_low, {rd('quantile_cont(source_value, 0.8)')} AS q_high FROM hv GROUP BY 1, 2),
    hc AS (SELECT hv.*, CASE WHEN source_value >= q_high THEN 'context' WHEN source_value <= q_low THEN 'reference' ELSE 'middle' END AS context FROM hv JOIN hq ON hq.task = hv.task AND hq.grp = hv.grp WHERE hq.n >= 15 AND q_high > q_low)"""


def spine(b):
    return b("entities").select("entity", "grp", "is_problematic").join(b("coverage").select("entity", "mutations_state", "fusions_state"), "entity")


def effects(b):
    return b("dependency")


def event_rows(b, tasks=TASKS):
    return stage(op.attach_effect(op.event_context(b("mutations"), spine(b), tasks), effects(b), tasks), "event_rows")


def high_rows(b, tasks=TASKS):
    return stage(op.attach_effect(op.value_context(b("expression_rna"), spine(b), tasks), effects(b), tasks), "high_rows")


def broad(b):
    d = b("dependency").groupBy("feature").agg(F.count("value").alias("n"), F.avg((F.col("value") < -1.0).cast("double")).alias("f"))
    return d.select("feature", ((F.col("n") >= 30) & (F.col("f") >= 0.155)).alias("broad"))


BROAD = "bro AS (SELECT feature, count(*) >= 30 AND avg(CASE WHEN effect < -1.0 THEN 1.0E0 ELSE 0.0E0 END) >= 0.155 AS broad FROM cells GROUP BY feature)"


@query("g1_evidence_state", f"""WITH {SPINE} SELECT s.entity, CASE WHEN h.hit IS NOT NULL THEN 'observed' WHEN s.mutations_state = 'not_assayed' THEN 'not_assayed' ELSE 'measured_absent' END AS state
    FROM spine s LEFT JOIN (SELECT DISTINCT entity, true AS hit FROM mutations WHERE feature = 'F03') h ON h.entity = s.entity""")
def _(b):
    rows = b("mutations").where("feature = 'F03'").select("entity").distinct().withColumn("_has", F.lit(True))
    return spine(b).join(rows, "entity", "left").select("entity", op.evidence_state(F.col("mutations_state"), F.coalesce("_has", F.lit(False))).alias("state"))


LEDGER = f"""{SPINE}, gr AS (SELECT s.entity, f.feature, l.layer FROM spine s JOIN (VALUES ('F03'), ('F10')) f(feature) ON true JOIN (VALUES ('mutation'), ('dependency')) l(layer) ON true),
    rw AS (SELECT entity, feature, 'mutation' AS layer, impact || '/' || CAST(is_driver AS VARCHAR) AS payload FROM mutations WHERE feature IN ('F03', 'F10')
      UNION ALL SELECT entity, feature, 'dependency', CAST(CAST(round(effect * 1000000) AS BIGINT) AS VARCHAR) FROM cells WHERE feature IN ('F03', 'F10')),
    st AS (SELECT entity, 'mutation' AS layer, mutations_state AS state FROM coverage UNION ALL SELECT entity, 'dependency', dependency_state FROM coverage),
    led AS (SELECT g.entity, g.feature, g.layer, r.payload, CASE WHEN r.payload IS NOT NULL THEN 'observed' WHEN st.state IS NULL OR st.state = 'not_assayed' THEN 'not_assayed' ELSE 'measured_absent' END AS evidence_state,
      sha256(CAST(g.entity AS VARCHAR) || '|' || g.feature || '|' || g.layer || '|' || coalesce(r.payload, '-')) AS evidence_hash, CAST(row_number() OVER (PARTITION BY g.entity, g.feature, g.layer, r.payload) AS INT) AS ordinal
      FROM gr g LEFT JOIN rw r ON r.entity = g.entity AND r.feature = g.feature AND r.layer = g.layer LEFT JOIN st ON st.entity = g.entity AND st.layer = g.layer)"""


def ledger(b):
    pair = ["F03", "F10"]
    cell = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(layer).alias("layer")) for f in pair for layer in ("mutation", "dependency")])
    grid = b("entities").select("entity", F.inline(cell))
    variants = b("mutations").where(F.col("feature").isin(pair)).select("entity", "feature", F.lit("mutation").alias("layer"), F.concat_ws("/", "impact", F.col("is_driver").cast("string")).alias("payload"))
    values = b("dependency").where(F.col("feature").isin(pair)).select("entity", "feature", F.lit("dependency").alias("layer"), F.round(F.col("value") * 1000000).cast("bigint").cast("string").alias("payload"))
    states = b("coverage").select("entity", F.inline(F.array(F.struct(F.lit("mutation").alias("layer"), F.col("mutations_state").alias("state")), F.struct(F.lit("dependency").alias("layer"), F.col("dependency_state").alias("state")))))
    return op.build_ledger(grid, variants.unionByName(values), states)


@query("g2_build_ledger", f"WITH {LEDGER} SELECT * FROM led")
def _(b):
    return ledger(b)


@query("g3_relationship_id", """SELECT DISTINCT 'direct_fusion' AS family, feature, partner, sha256('direct_fusion|' || least(feature, partner) || '|' || greatest(feature, partner)) AS rel_id FROM fusions WHERE partner IS NOT NULL
    UNION ALL SELECT DISTINCT 'conditional_dependency', feature, partner, sha256('conditional_dependency|' || feature || '|' || partner) FROM fusions WHERE partner IS NOT NULL""")
def _(b):
    pairs = b("fusions").where("partner is not null").select("feature", "partner").distinct()
    rows = pairs.withColumn("family", F.explode(F.array(F.lit("direct_fusion"), F.lit("conditional_dependency"))))
    return rows.select("family", "feature", "partner", op.relationship_id(F.col("family"), F.col("feature"), F.col("partner"), F.col("family") == "direct_fusion").alias("rel_id"))


DIRECT = f"""{SPINE}, dh AS (SELECT entity, count(*) AS n FROM fusions WHERE least(feature, partner) = 'F03' AND greatest(feature, partner) = 'F10' GROUP BY 1),
    dr AS (SELECT s.entity, s.grp, coalesce(h.n, 0) AS n_events, CASE WHEN h.n > 0 THEN 'support' WHEN s.fusions_state <> 'not_assayed' THEN 'conflict' ELSE 'unknown' END AS support FROM spine s LEFT JOIN dh h ON h.entity = s.entity)"""


@query("g4_eval_direct_pair", f"WITH {DIRECT} SELECT * FROM dr")
def _(b):
    return op.eval_direct_pair(b("fusions"), spine(b), "F10", "F03")[0]


@query("g4_direct_pair_status", f"""WITH {DIRECT}, o AS (SELECT CAST(sum(n_events) AS BIGINT) AS n_events, count(CASE WHEN support = 'support' THEN 1 END) AS n_support, count(CASE WHEN support = 'conflict' THEN 1 END) AS n_conflict, count(CASE WHEN support = 'unknown' THEN 1 END) AS n_unknown FROM dr)
    SELECT *, CASE WHEN n_events > 0 THEN 'supported' WHEN n_conflict > 0 THEN 'contradicted' ELSE 'unavailable' END AS status FROM o""")
def _(b):
    return op.eval_direct_pair(b("fusions"), spine(b), "F10", "F03")[1]


@query("g5_event_context", f"WITH {EVENT} SELECT task, entity, grp, context FROM ev0")
def _(b):
    return op.event_context(b("mutations"), spine(b), TASKS).select("task", "entity", "grp", "context")


@query("g6_quantile_context", f"WITH {HIGH} SELECT task, grp, q_low, q_high, n, CASE WHEN n < 15 THEN 'eligible_n_below_minimum' WHEN q_high <= q_low THEN 'high_not_above_low' END AS reason FROM hq")
def _(b):
    return op.quantile_context(high_rows(b))[1]


@query("g7_group_residual", f"WITH {EVENT}, {adj('ev')} SELECT task, entity, value_adj, group_n FROM adj")
def _(b):
    return op.adjusted(event_rows(b)).select("task", "entity", "value_adj", "group_n")


SIDES = f"""count(CASE WHEN context = 'context' THEN 1 END) AS n_context, count(CASE WHEN context = 'reference' THEN 1 END) AS n_reference, {shift('value_adj')} AS shift"""


@query("g8_median_shift", f"WITH {EVENT}, {adj('ev')} SELECT task, {rd(med('value_adj', 'context'))} AS median_context, {rd(med('value_adj', 'reference'))} AS median_reference, {SIDES} FROM adj GROUP BY task")
def _(b):
    out = op.side_medians(op.adjusted(event_rows(b)), ["task"], "value_adj")
    return out.withColumn("median_context", F.round("median_context", 9)).withColumn("median_reference", F.round("median_reference", 9))


U = "((('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def boot(src: str, strata: str, order: str) -> str:
    """Positions, draws and the resampled rows `bsr` of an adjusted table."""
    u = U.format(parts=f"25, p.task, {', '.join('p.' + s for s in strata.split(', '))}, r.rep, p.pos")
    on = " AND ".join(f"p.{s} = d.{s}" for s in ["task", *strata.split(", ")])
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY task, {strata} ORDER BY substr(md5(CAST(entity AS VARCHAR)), 1, 2), {order}, entity) AS pos, count(*) OVER (PARTITION BY task, {strata}) AS pn FROM {src}),
    dr AS (SELECT p.task, {', '.join('p.' + s for s in strata.split(', '))}, r.rep, CAST(floor({u} * p.pn) AS BIGINT) + 1 AS dp FROM pos p, (SELECT unnest(range(1, {op.REPLICATES + 1})) AS rep) r),
    bsr AS (SELECT d.rep, p.* FROM dr d JOIN pos p ON {on} AND p.pos = d.dp)"""


def boot_shift(src: str) -> str:
    return f"""sd AS (SELECT * FROM {src} WHERE context <> 'middle'), {boot('sd', 'grp, context', 'value_adj')},
    bst AS (SELECT task, rep, {shift('value_adj')} AS stat FROM bsr GROUP BY 1, 2),
    ci AS (SELECT task, {rd('quantile_cont(stat, 0.025)', 8)} AS ci_low, {rd('quantile_cont(stat, 0.975)', 8)} AS ci_high, count(*) AS n_replicates FROM bst WHERE stat IS NOT NULL GROUP BY 1)"""


@query("g9_bootstrap_ci", f"WITH {EVENT}, {adj('ev')}, {boot_shift('adj')} SELECT * FROM ci")
def _(b):
    return op.bootstrap_shift(op.adjusted(event_rows(b)), ["task"])


def loo(src: str) -> str:
    return f"""fs AS (SELECT task, {shift('value_adj')} AS full_shift FROM {src} WHERE context <> 'middle' GROUP BY 1), hg AS (SELECT DISTINCT task, grp AS held_out FROM {src} WHERE context <> 'middle'),
    lh AS (SELECT a.task, h.held_out, {SIDES.replace('value_adj', 'a.value_adj').replace('context =', 'a.context =')}, count(DISTINCT a.grp) AS n_groups FROM {src} a JOIN hg h ON h.task = a.task AND h.held_out <> a.grp WHERE a.context <> 'middle' GROUP BY 1, 2),
    lo AS (SELECT l.*, f.full_shift, (n_context >= 10 AND n_reference >= 10 AND n_context + n_reference >= 30 AND n_groups >= 2 AND shift IS NOT NULL) AS estimable FROM lh l JOIN fs f ON f.task = l.task),
    lt AS (SELECT task, held_out, CASE WHEN estimable THEN shift END AS shift, estimable, estimable AND sign(full_shift) <> 0 AND sign(shift) = sign(full_shift) AS matches, n_context, n_reference, n_groups, full_shift FROM lo),
    lc AS (SELECT task, {rd('avg(CASE WHEN estimable THEN CASE WHEN matches THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)')} AS consistency FROM lt GROUP BY 1)"""


def loo_frame(b):
    rows = stage(op.adjusted(event_rows(b)), "adjusted")
    full = op.side_medians(rows, ["task"], "value_adj")
    return op.leave_one_out_shift(rows, ["task"], full), full


@query("g10_leave_one_group_out", f"WITH {EVENT}, {adj('ev')}, {loo('adj')} SELECT task, held_out, shift, estimable, matches, n_context, n_reference, n_groups FROM lt")
def _(b):
    return loo_frame(b)[0]


PAIRS = f"""{TASK_SQL}, {SPINE}, pv AS (SELECT t.task, s.entity, s.grp, x.effect AS x, y.effect AS y FROM tasks t JOIN cells x ON x.feature = t.a JOIN cells y ON y.feature = t.b AND y.entity = x.entity JOIN spine s ON s.entity = x.entity WHERE NOT s.is_problematic),
    pa AS (SELECT * FROM (SELECT *, {rd("x - quantile_cont(x, 0.5) OVER (PARTITION BY task, grp)")} AS x_adj, {rd("y - quantile_cont(y, 0.5) OVER (PARTITION BY task, grp)")} AS y_adj, count(*) OVER (PARTITION BY task, grp) AS gn FROM pv) q WHERE gn >= 15)"""


def rho_sql(src: str, keys: str, x: str, y: str, out: str, extra: str = "") -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    return f"""{out} AS (SELECT {keys}, count(*) AS n{extra}, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM (SELECT *, {rank(x)} AS rx, {rank(y)} AS ry FROM {src}) q GROUP BY {keys})"""


CODEP = f"""{PAIRS}, {BROAD}, {rho_sql('pa', 'task', 'x', 'y', 'rr')}, {rho_sql('pa', 'task', 'x_adj', 'y_adj', 'ra', ', count(DISTINCT grp) AS n_groups')},
    hd AS (SELECT p.*, h.held_out FROM pa p JOIN (SELECT DISTINCT task, grp AS held_out FROM pa) h ON h.task = p.task AND h.held_out <> p.grp), {rho_sql('hd', 'task, held_out', 'x_adj', 'y_adj', 'rh', ', count(DISTINCT grp) AS g')},
    cs AS (SELECT h.task, {rd("avg(CASE WHEN h.n >= 30 AND g >= 2 AND h.rho IS NOT NULL THEN CASE WHEN sign(h.rho) = sign(a.rho) AND sign(a.rho) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)")} AS consistency FROM rh h JOIN ra a ON a.task = h.task GROUP BY 1),
    {boot('pa', 'grp', 'x_adj, y_adj')}, {rho_sql('bsr', 'task, rep', 'x_adj', 'y_adj', 'bro_')}, ci AS (SELECT task, quantile_cont({rd('rho')}, 0.025) AS ci_low, quantile_cont({rd('rho')}, 0.975) AS ci_high FROM bro_ GROUP BY 1 HAVING count(rho) = {op.REPLICATES}),
    cd AS (SELECT t.task, t.a, t.b, ra.n, ra.n_groups, {rd('rr.rho', 8)} AS raw_rho, {rd('ra.rho', 8)} AS rho, coalesce(ra.n >= 30 AND n_groups >= 2 AND ra.rho IS NOT NULL AND rr.rho IS NOT NULL, false) AS estimable, {rd('ci_low', 8)} AS ci_low, {rd('ci_high', 8)} AS ci_high, consistency,
      CASE WHEN NOT coalesce(ra.n >= 30 AND n_groups >= 2 AND ra.rho IS NOT NULL AND rr.rho IS NOT NULL, false) THEN 'unavailable' WHEN coalesce(ba.broad, true) OR coalesce(bb.broad, true) THEN 'exploratory' WHEN (ci_low > 0 OR ci_high < 0) AND consistency >= 0.8 THEN 'supported' ELSE 'exploratory' END AS status
      FROM tasks t LEFT JOIN ra ON ra.task = t.task LEFT JOIN rr ON rr.task = t.task LEFT JOIN cs ON cs.task = t.task LEFT JOIN ci ON ci.task = t.task LEFT JOIN bro ba ON ba.feature = t.a LEFT JOIN bro bb ON bb.feature = t.b)"""


def pair_flags(b, tasks=TASKS):
    t = op.task_frame(b("entities"), tasks, "a", "b")
    fa, fb = broad(b).select(F.col("feature").alias("a"), F.col("broad").alias("_a")), broad(b).select(F.col("feature").alias("b"), F.col("broad").alias("_b"))
    return t.join(fa, "a", "left").join(fb, "b", "left").select("task", (F.coalesce("_a", F.lit(True)) | F.coalesce("_b", F.lit(True))).alias("broad"))


def target_flags(b, tasks=TASKS):
    t = op.task_frame(b("entities"), tasks, "a", "feature")
    return t.join(broad(b), "feature", "left").select("task", "broad")


@query("g11_eval_codependency", f"WITH {CODEP} SELECT task, n, n_groups, raw_rho, rho, estimable, CASE WHEN estimable THEN ci_low END AS ci_low, CASE WHEN estimable THEN ci_high END AS ci_high, CASE WHEN estimable THEN consistency END AS consistency, status FROM cd")
def _(b):
    return op.eval_codependency(op.pair_rows(effects(b), spine(b), TASKS), pair_flags(b))


def conditional(rows_cte: str, src: str) -> str:
    return f"""{rows_cte}, {BROAD}, {adj(src)}, {boot_shift('adj')}, {loo('adj')},
    sg AS (SELECT task, {SIDES}, {shift('value')} AS raw_shift, count(DISTINCT grp) AS n_groups FROM adj WHERE context <> 'middle' GROUP BY task),
    se AS (SELECT t.task, t.b, sg.*EXCLUDE(task), coalesce(n_context >= 10 AND n_reference >= 10 AND n_context + n_reference >= 30 AND n_groups >= 2 AND shift IS NOT NULL, false) AS estimable FROM tasks t LEFT JOIN sg ON sg.task = t.task),
    cnd AS (SELECT se.task, n_context, n_reference, n_groups, raw_shift, shift, estimable, CASE WHEN estimable THEN ci.ci_low END AS ci_low, CASE WHEN estimable THEN ci.ci_high END AS ci_high, CASE WHEN estimable THEN lc.consistency END AS consistency,
      CASE WHEN NOT estimable THEN 'unavailable' WHEN coalesce(bro.broad, true) THEN 'exploratory' WHEN shift > 0 AND ci.ci_low > 0 AND lc.consistency >= 0.8 THEN 'supported' WHEN shift < 0 AND ci.ci_high < 0 AND lc.consistency >= 0.8 THEN 'contradicted' ELSE 'exploratory' END AS status
      FROM se LEFT JOIN ci ON ci.task = se.task LEFT JOIN lc ON lc.task = se.task LEFT JOIN bro ON bro.feature = se.b)"""


@query("g12_conditional_event", f"WITH {conditional(EVENT, 'ev')} SELECT * FROM cnd")
def _(b):
    return op.eval_conditional(op.adjusted(event_rows(b)), target_flags(b))


@query("g13_conditional_high", f"WITH {conditional(HIGH, 'hc')} SELECT * FROM cnd")
def _(b):
    return op.eval_conditional(op.adjusted(op.quantile_context(high_rows(b))[0]), target_flags(b))


@query("g14_route_status", f"""WITH {EVENT}, {adj('ev')}, sg AS (SELECT task, {SIDES} FROM adj GROUP BY task), st AS (SELECT task, shift, f.flag, CASE f.flag WHEN 'broad' THEN 'exploratory' WHEN 'unknown' THEN 'exploratory' WHEN 'gated' THEN 'unavailable'
    ELSE CASE WHEN shift > 0 THEN 'supported' WHEN shift < 0 THEN 'contradicted' ELSE 'exploratory' END END AS status FROM sg, (VALUES ('clear'), ('broad'), ('unknown'), ('gated')) f(flag)) SELECT * FROM st""")
def _(b):
    stat = op.side_medians(op.adjusted(event_rows(b)), ["task"], "value_adj")
    rows = stat.select("task", "shift", F.explode(F.array(*[F.lit(x) for x in ("clear", "broad", "unknown", "gated")])).alias("flag"))
    known = F.when(F.col("flag") == "broad", True).when(F.col("flag") == "unknown", F.lit(None).cast("boolean")).otherwise(False)
    return rows.withColumn("status", op.route_status(F.col("flag") != "gated", known, F.col("shift"), F.col("shift"), F.col("shift"), F.lit(1.0)))


@query("g15_support_state", f"""WITH {HIGH} SELECT h.task, h.entity, CASE WHEN c.context IS NULL THEN 'unknown' WHEN c.context IN ('reference', 'middle') THEN 'not_applicable' WHEN h.value <= -0.5 THEN 'support' ELSE 'conflict' END AS support,
    CASE WHEN h.value <= -0.5 AND h.value * 2 <= -0.5 THEN 'support' WHEN h.value <= -0.5 OR h.value * 2 <= -0.5 THEN 'neutral' ELSE 'conflict' END AS pair_support FROM hv h LEFT JOIN hc c ON c.task = h.task AND c.entity = h.entity""")
def _(b):
    rows = high_rows(b)
    marked = op.quantile_context(rows)[0].select("task", "entity", "context")
    out = rows.join(marked, ["task", "entity"], "left")
    return out.select("task", "entity", op.support_state(F.col("context").isNotNull(), F.coalesce("context", F.lit("")), F.col("value")).alias("support"), op.pair_support_state(F.col("value"), F.col("value") * 2).alias("pair_support"))


GRID = [{"scenario": "base", "low": 0.2, "high": 0.8, "min_group": 15, "min_side": 10, "min_total": 30}, {"scenario": "tails", "low": 0.1, "high": 0.9, "min_group": 15, "min_side": 10, "min_total": 30},
        {"scenario": "thirds", "low": 0.33, "high": 0.67, "min_group": 15, "min_side": 10, "min_total": 30}, {"scenario": "large_groups", "low": 0.2, "high": 0.8, "min_group": 170, "min_side": 10, "min_total": 30},
        {"scenario": "more_sides", "low": 0.2, "high": 0.8, "min_group": 15, "min_side": 400, "min_total": 900}]


@query("g16_policy_sensitivity", f"""WITH {HIGH}, gd AS (SELECT * FROM (VALUES {", ".join(f"('{g['scenario']}', {g['low']}, {g['high']}, {g['min_group']}, {g['min_side']}, {g['min_total']})" for g in GRID)}) t(scenario, lo, hi, mg, ms, mt)),
    qq AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT '{g['scenario']}' AS scenario, task, grp, count(*) AS n, {rd('quantile_cont(source_value, %s)' % g['low'])} AS ql, {rd('quantile_cont(source_value, %s)' % g['high'])} AS qh FROM hv GROUP BY 2, 3" for g in GRID)}) z),
    cx AS (SELECT gd.*, hv.*, CASE WHEN source_value >= qh THEN 'context' WHEN source_value <= ql THEN 'reference' ELSE 'middle' END AS context FROM hv JOIN qq ON qq.task = hv.task AND qq.grp = hv.grp JOIN gd ON gd.scenario = qq.scenario WHERE qq.n >= gd.mg AND qh > ql),
    {adj('cx', 'pa', 1, 'scenario, ')} SELECT scenario, task, {SIDES}, count(DISTINCT CASE WHEN true THEN grp END) AS n_groups,
      count(CASE WHEN context = 'context' THEN 1 END) >= max(ms) AND count(CASE WHEN context = 'reference' THEN 1 END) >= max(ms) AND count(CASE WHEN context <> 'middle' THEN 1 END) >= max(mt) AND count(DISTINCT grp) >= 2 AS estimable FROM pa GROUP BY scenario, task""")
def _(b):
    return op.policy_sensitivity(high_rows(b), GRID)


PLAN_FEATURES = ["F03", "F10", "F07", "F12", "F21", "F05"]


@query("g17_plan_pairs", """WITH f AS (SELECT feature FROM features WHERE feature IN ('F03', 'F10', 'F07', 'F12', 'F21', 'F05')), p AS (SELECT a.feature AS a, b.feature AS b, CAST(row_number() OVER (ORDER BY a.feature, b.feature) AS INT) AS pair_no FROM f a JOIN f b ON a.feature < b.feature),
    t AS (SELECT * FROM (VALUES ('direct_fusion', 'symmetric', NULL), ('crispr_codependency', 'symmetric', NULL), ('conditional_dependency', 'a_to_b', 'mutation'), ('conditional_dependency', 'b_to_a', 'mutation'), ('conditional_dependency', 'a_to_b', 'high_expression'), ('conditional_dependency', 'b_to_a', 'high_expression')) t(family, direction, context_type))
    SELECT p.pair_no, p.a, p.b, p.pair_no <= 10 AS retained, t.family, t.direction, t.context_type FROM p LEFT JOIN t ON p.pair_no <= 10""")
def _(b):
    known = [r["feature"] for r in b("features").where(F.col("feature").isin(PLAN_FEATURES)).select("feature").distinct().collect()]
    return op.plan_pairs(b.spark, known)


PLAN = [{"task": "t1", "family": "conditional_dependency", "a": "F03", "b": "F10", "context": "mutation"}, {"task": "t2", "family": "conditional_dependency", "a": "F07", "b": "F12", "context": "mutation"},
        {"task": "t3", "family": "conditional_dependency", "a": "F15", "b": "F04", "context": "mutation"}, {"task": "fusion", "family": "direct_fusion", "a": "F03", "b": "F10"},
        {"task": "self", "family": "crispr_codependency", "a": "F03", "b": "F03"}, {"task": "unknown", "family": "direct_fusion", "a": "F03", "b": "F77"}]
PLAN_SQL = f"""{conditional(EVENT, 'ev')}, {DIRECT.replace(SPINE + ', ', '').replace('dr AS', 'drr AS')}, do_ AS (SELECT CAST(sum(n_events) AS BIGINT) AS n_events, count(CASE WHEN support <> 'unknown' THEN 1 END) AS n, count(CASE WHEN support = 'conflict' THEN 1 END) AS nc FROM drr),
    res AS (SELECT task, 'conditional_dependency' AS family, n_context + n_reference AS n, shift AS statistic, status FROM cnd UNION ALL SELECT 'fusion', 'direct_fusion', n, CAST(n_events AS DOUBLE), CASE WHEN n_events > 0 THEN 'supported' WHEN nc > 0 THEN 'contradicted' ELSE 'unavailable' END FROM do_
      UNION ALL SELECT 'self', 'crispr_codependency', NULL, NULL, 'failed: same_feature' UNION ALL SELECT 'unknown', 'direct_fusion', NULL, NULL, 'failed: unknown_feature')"""


def plan_results(b):
    known = {r["feature"] for r in b("features").where(F.col("feature").isin(sorted({t[k] for t in PLAN for k in "ab"}))).select("feature").collect()}
    return op.run_plan(PLAN, known, spine(b), effects(b), b("expression_rna"), b("mutations"), b("fusions"), broad(b))


@query("g18_run_plan", f"WITH {PLAN_SQL} SELECT task, family, n, statistic, status FROM res")
def _(b):
    return plan_results(b)


@query("g19_export_routes", f"WITH {LEDGER} SELECT feature, layer, CAST(entity AS VARCHAR) AS entity, evidence_state, CASE WHEN payload LIKE '-%' THEN '''' || payload ELSE coalesce(payload, '') END AS payload, CAST(ordinal AS VARCHAR) AS ordinal FROM led")
def _(b):
    return sinks.export_csv(op.export_routes(ledger(b)))


PT = """msk_{s} AS (SELECT a.entity, coalesce(m.n, 0) AS {s}_events, coalesce(m.lof, 0) AS {s}_lof FROM (SELECT entity FROM coverage WHERE mutations_state <> 'not_assayed') a LEFT JOIN (SELECT entity, count(*) AS n, max(CASE WHEN impact = 'HIGH' THEN 1 ELSE 0 END) AS lof FROM mutations WHERE feature = '{f}' GROUP BY 1) m ON m.entity = a.entity),
    cl_{s} AS (SELECT entity, rna AS {s}_rna, effect AS {s}_effect, copy_number AS {s}_copy_number, {z} AS {s}_z FROM cells WHERE feature = '{f}')"""
PAIR_TABLE = f"""{SPINE}, {", ".join(PT.format(s=s, f=f, z=rd(f"(rna - avg(rna) OVER ()) / stddev_samp(rna) OVER ()")) for s, f in (("a", "F03"), ("b", "F10")))},
    calls AS (SELECT entity, count(*) AS n FROM fusions WHERE least(feature, partner) = 'F03' AND greatest(feature, partner) = 'F10' GROUP BY 1),
    pt0 AS (SELECT s.*, {", ".join(f"a_{c}, b_{c}".replace('a_', f'cl_a.a_', 1).replace(' b_', f' cl_b.b_') for c in ('rna', 'effect', 'copy_number', 'z'))}, msk_a.a_events, msk_a.a_lof, msk_b.b_events, msk_b.b_lof, calls.n AS n_calls FROM spine s LEFT JOIN cl_a ON cl_a.entity = s.entity LEFT JOIN cl_b ON cl_b.entity = s.entity
      LEFT JOIN msk_a ON msk_a.entity = s.entity LEFT JOIN msk_b ON msk_b.entity = s.entity LEFT JOIN calls ON calls.entity = s.entity),
    pt1 AS (SELECT *, {", ".join(f"CASE WHEN {s}_lof IS NOT NULL OR {s}_copy_number IS NOT NULL OR {s}_z IS NOT NULL THEN CASE WHEN coalesce({s}_lof = 1, false) OR coalesce({s}_copy_number < 1, false) OR coalesce({s}_z < -1.5, false) THEN 1 ELSE 0 END END AS {s}_loss" for s in 'ab')} FROM pt0),
    ptab AS (SELECT *, CASE WHEN fusions_state <> 'not_assayed' THEN CASE WHEN n_calls IS NOT NULL THEN 1 ELSE 0 END END AS direct_call, CASE WHEN a_effect IS NOT NULL AND b_effect IS NOT NULL THEN 1 ELSE 0 END AS codependency_observed,
      CASE WHEN a_loss IS NOT NULL AND b_effect IS NOT NULL THEN 1 ELSE 0 END AS a_loss_to_b_observed, CASE WHEN b_loss IS NOT NULL AND a_effect IS NOT NULL THEN 1 ELSE 0 END AS b_loss_to_a_observed FROM pt1)"""
_PT = ["entity", *[f"{s}_{c}" for s in "ab" for c in ("rna", "effect", "copy_number", "z", "events", "lof", "loss")], "direct_call", "codependency_observed", "a_loss_to_b_observed", "b_loss_to_a_observed"]


def pair_frame(b):
    return op.pair_table(spine(b), b("cells"), b("mutations"), b("fusions"), "F03", "F10")


@query("g20_pair_table", f"WITH {PAIR_TABLE} SELECT {', '.join(_PT)} FROM ptab")
def _(b):
    return pair_frame(b).select(*_PT)


@query("g21_masked_events", """SELECT a.entity, coalesce(m.n, 0) AS n_events, coalesce(m.f, 0.0::DOUBLE) AS max_fraction, coalesce(m.lof, 0) AS has_lof FROM (SELECT entity FROM entities WHERE acctbal >= 0) a
    LEFT JOIN (SELECT entity, count(*) AS n, max(allele_fraction) AS f, max(CASE WHEN impact = 'HIGH' THEN 1 ELSE 0 END) AS lof FROM mutations WHERE feature = 'F07' GROUP BY 1) m ON m.entity = a.entity""")
def _(b):
    return op.masked_events(b("mutations"), b("entities").where("acctbal >= 0"), "F07")


@query("g22_conditional_summary", f"""WITH {PAIR_TABLE} SELECT count(*) AS n_eligible, count(CASE WHEN a_loss = 1 THEN 1 END) AS n_lost, {rd('avg(CASE WHEN a_loss = 1 THEN b_effect END)')} AS mean_lost, {rd('avg(CASE WHEN a_loss = 0 THEN b_effect END)')} AS mean_intact,
    {rd('avg(CASE WHEN a_loss = 1 THEN b_effect END) - avg(CASE WHEN a_loss = 0 THEN b_effect END)')} AS difference FROM ptab WHERE a_loss IS NOT NULL AND b_effect IS NOT NULL""")
def _(b):
    return op.conditional_summary(pair_frame(b), "a_loss", "b_effect")


@query("g23_safe_corr", f"""WITH {PAIRS}, k AS (SELECT task, x, y, rank() OVER (PARTITION BY task ORDER BY x) + (count(*) OVER (PARTITION BY task, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0 AS ry FROM pv)
    SELECT task, count(*) AS n, {rd('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))', 8)} AS pearson, {rd('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))', 8)} AS spearman FROM k GROUP BY task""")
def _(b):
    return op.safe_corr(op.pair_rows(effects(b), spine(b), TASKS), ["task"], "x", "y")


def rb(src: str, keys: str, value: str, out: str) -> str:
    return f"""{out} AS (SELECT {keys}, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, 2.0 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1.0 AS rb FROM (SELECT {keys}, count(CASE WHEN context = 'context' THEN 1 END) AS n1, count(CASE WHEN context = 'reference' THEN 1 END) AS n2, sum(CASE WHEN context = 'context' THEN r END) AS r1
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0 AS r FROM {src} WHERE context <> 'middle') z GROUP BY {keys}) y)"""


@query("g24_rank_biserial", f"WITH {EVENT}, {rb('ev', 'task', 'value', 'k')} SELECT task, n1 AS n_first, n2 AS n_second, CAST(u AS DOUBLE) AS u, {rd('rb', 8)} AS rank_biserial FROM k")
def _(b):
    rows = event_rows(b).withColumn("is_context", F.col("context") == "context")
    return op.rank_biserial(rows, ["task"], "value", "is_context").withColumn("rank_biserial", F.round("rank_biserial", 8))


def comparison(src: str, keys: str, min_context: int = 10) -> str:
    return f"""{rb(src, keys, 'value', 'cr')}, ca AS (SELECT * FROM (SELECT *, {rd(f"value - quantile_cont(value, 0.5) OVER (PARTITION BY {keys}, grp)")} AS value_adj, count(*) OVER (PARTITION BY {keys}, grp) AS gn FROM {src}) q WHERE gn >= 15), {rb('ca', keys, 'value_adj', 'cra')},
    c1 AS (SELECT {keys}, count(CASE WHEN context = 'context' THEN 1 END) AS n_context, count(CASE WHEN context = 'reference' THEN 1 END) AS n_reference, {rd(med('value', 'context'))} AS median_context, {rd(med('value', 'reference'))} AS median_reference, {shift('value')} AS shift FROM {src} GROUP BY {keys}),
    c2 AS (SELECT {keys}, count(CASE WHEN context = 'context' THEN 1 END) AS ac, count(CASE WHEN context = 'reference' THEN 1 END) AS ar, {shift('value_adj')} AS ash FROM ca GROUP BY {keys}),
    cmp AS (SELECT c1.*, {rd('-cr.rb', 8)} AS rank_effect, coalesce(ac, 0) AS adj_context, coalesce(ar, 0) AS adj_reference, CASE WHEN ac >= {min_context} AND ar >= 10 AND ac + ar >= 30 THEN ash END AS adjusted_shift,
      CASE WHEN ac >= {min_context} AND ar >= 10 AND ac + ar >= 30 THEN {rd('-cra.rb', 8)} END AS adjusted_rank_effect FROM c1 LEFT JOIN cr ON cr.{keys} = c1.{keys} LEFT JOIN c2 ON c2.{keys} = c1.{keys} LEFT JOIN cra ON cra.{keys} = c1.{keys})"""


@query("g25_group_comparison", f"WITH {EVENT}, {comparison('ev', 'task')} SELECT * FROM cmp")
def _(b):
    return op.group_comparison(event_rows(b), ["task"])


@query("g26_continuous_association", f"WITH {PAIRS}, {rho_sql('pa', 'task', 'x_adj', 'y_adj', 'k')} SELECT task, n, CASE WHEN n >= 30 THEN {rd('-rho', 8)} END AS association FROM k")
def _(b):
    return op.continuous_association(op.pair_rows(effects(b), spine(b), TASKS), ["task"])


@query("g27_threshold_context", "SELECT entity, feature, CASE WHEN copy_number <= 0.7 THEN 'loss' WHEN copy_number >= 1.3 THEN 'gain' ELSE 'reference' END AS context FROM cells")
def _(b):
    return b("cells").select("entity", "feature", op.threshold_context(F.col("copy_number"), 0.7, 1.3).alias("context"))


ROUTES = f"""{conditional(EVENT, 'ev')}, rfs AS (SELECT t.task, count(DISTINCT f.entity) AS n FROM tasks t LEFT JOIN fusions f ON least(f.feature, f.partner) = least(t.a, t.b) AND greatest(f.feature, f.partner) = greatest(t.a, t.b) GROUP BY 1),
    na AS (SELECT count(*) AS n FROM coverage WHERE fusions_state <> 'not_assayed'),
    rl AS (SELECT t.a || '--' || t.b AS pair_id, 'direct_fusion' AS route_family, NULL AS direction, 'direct_fusion_pct' AS metric_name, {rd('100.0::DOUBLE * rfs.n / na.n', 6)} AS metric_value, na.n AS denominator, CASE WHEN rfs.n > 0 THEN 'direct_pair_observed' ELSE 'assayed_no_retained_pair_call' END AS state FROM tasks t JOIN rfs ON rfs.task = t.task, na
      UNION ALL SELECT t.a || '--' || t.b, 'conditional_dependency', t.a || '->' || t.b, 'adjusted_shift', c.shift, c.n_context + c.n_reference, CASE WHEN c.shift > 0 THEN 'positive_signal' ELSE 'no_positive_signal' END FROM tasks t JOIN cnd c ON c.task = t.task)"""


def route_long(b):
    """One row per pair, route and direction, each with its own unit and denominator."""
    names = op.task_frame(b("entities"), TASKS, "a", "b").select("task", F.concat("a", F.lit("--"), "b").alias("pair_id"), F.concat("a", F.lit("->"), "b").alias("direction"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    assayed = b("coverage").where("fusions_state <> 'not_assayed'").agg(F.count(F.lit(1)).alias("n")).scalar()
    found = op.pair_recurrence(b("fusions"), b("entities"), assayed, [(x, y) for _, x, y in TASKS])
    direct = found.join(names, ["a", "b"]).select("pair_id", F.lit("direct_fusion").alias("route_family"), F.lit(None).cast("string").alias("direction"), F.lit("direct_fusion_pct").alias("metric_name"), F.col("pct").alias("metric_value"), F.col("n_assayed").alias("denominator"), "state")
    stats = op.side_medians(op.adjusted(event_rows(b)), ["task"], "value_adj").join(names, "task")
    cond = stats.select("pair_id", F.lit("conditional_dependency").alias("route_family"), "direction", F.lit("adjusted_shift").alias("metric_name"), F.col("shift").alias("metric_value"), (F.col("n_context") + F.col("n_reference")).alias("denominator"),
                        F.when(F.col("shift") > 0, "positive_signal").otherwise("no_positive_signal").alias("state"))
    return direct.unionByName(cond)


@query("g28_route_long", f"WITH {ROUTES} SELECT * FROM rl")
def _(b):
    return route_long(b)


@query("g29_pair_summary", f"""WITH {ROUTES} SELECT pair_id, count(CASE WHEN route_family = 'conditional_dependency' AND metric_value IS NOT NULL THEN 1 END) AS n_conditional, max(CASE WHEN route_family = 'conditional_dependency' THEN direction END) AS best_direction,
    max(CASE WHEN route_family = 'conditional_dependency' THEN metric_value END) AS best_value, coalesce(nullif(concat_ws(' | ', CASE WHEN bool_or(state = 'direct_pair_observed') THEN 'direct fusion' END, CASE WHEN bool_or(state = 'positive_signal') THEN 'conditional dependency' END), ''), 'none') AS positive_routes FROM rl GROUP BY pair_id""")
def _(b):
    return op.pair_summary(route_long(b))


CAT = [("F03", "F10"), ("F12", "F07"), ("F05", "F05"), ("F99", "F01")]


@query("g30_pair_recurrence", f"""WITH cat AS (SELECT * FROM (VALUES {', '.join(f"('{min(p)}', '{max(p)}')" for p in CAT)}) t(a, b)), na AS (SELECT count(*) AS n FROM coverage WHERE fusions_state <> 'not_assayed'),
    f AS (SELECT c.a, c.b, count(DISTINCT x.entity) AS n_entities, count(DISTINCT e.grp) AS n_groups, coalesce(sum(x.reads), 0.0::DOUBLE) AS total_reads, coalesce(max(x.reads), 0.0::DOUBLE) AS max_reads, coalesce(string_agg(DISTINCT e.grp, ' | ' ORDER BY e.grp), '') AS groups
      FROM cat c LEFT JOIN fusions x ON least(x.feature, x.partner) = c.a AND greatest(x.feature, x.partner) = c.b AND x.partner IS NOT NULL LEFT JOIN entities e ON e.entity = x.entity GROUP BY 1, 2)
    SELECT f.*, na.n AS n_assayed, {rd('100.0::DOUBLE * n_entities / na.n', 6)} AS pct, CASE WHEN n_entities > 0 THEN 'direct_pair_observed' ELSE 'assayed_no_retained_pair_call' END AS state FROM f, na""")
def _(b):
    assayed = b("coverage").where("fusions_state <> 'not_assayed'").agg(F.count(F.lit(1)).alias("n")).scalar()
    return op.pair_recurrence(b("fusions"), b("entities"), assayed, CAT)


@query("g31_pair_dominant_group", f"""WITH c AS (SELECT DISTINCT least(feature, partner) AS a, greatest(feature, partner) AS b, entity FROM fusions WHERE partner IS NOT NULL), k AS (SELECT a, b, grp, count(*) AS k FROM c JOIN entities e ON e.entity = c.entity GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k DESC, grp) AS rn, sum(k) OVER (PARTITION BY a, b) AS t FROM k) SELECT a, b, CAST(t AS BIGINT) AS n_entities, grp AS dominant_group, {rd('100.0::DOUBLE * k / t', 6)} AS dominant_pct FROM r WHERE rn = 1""")
def _(b):
    return op.pair_dominant_group(b("fusions"), b("entities"))


@query("g32_stability_summary", f"""WITH {EVENT}, {adj('ev')}, {loo('adj')} SELECT task, count(*) AS n_holdouts, max(full_shift) AS full_shift, min(shift) AS min_shift, max(shift) AS max_shift, {rd('max(abs(shift - full_shift))')} AS max_change,
    {rd('100.0::DOUBLE * avg(CASE WHEN sign(shift) = sign(full_shift) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS direction_kept_pct, {rd('quantile_cont(shift, 0.5)')} AS median_shift FROM lt WHERE estimable GROUP BY task""")
def _(b):
    return op.stability_summary(*loo_frame(b))


TARGETS = "tg AS (SELECT * FROM (VALUES ('click', 'F03'), ('click', 'F10'), ('view', 'F07'), ('error', 'F03'), ('purchase', 'F12')) t(treatment, feature))"
_TG = [("click", " f03, F10"), ("view", "F07,"), ("error", "F03"), ("purchase", "f12")]


def annotated(b):
    t = b("treatments").select("treatment").distinct()
    out = F.lit(None).cast("string")
    for name, text in _TG:
        out = F.when(F.col("treatment") == name, F.lit(text)).otherwise(out)
    return t.withColumn("targets", out).where("targets is not null")


def target_table(b):
    return op.explode_targets(annotated(b)).select("treatment", F.col("target").alias("feature"))


CONCORD = f"""{TARGETS}, cx AS (SELECT t.feature, t.treatment, x.effect AS x, r.response AS y FROM tg t JOIN cells x ON x.feature = t.feature JOIN treatments r ON r.treatment = t.treatment AND r.entity = x.entity), {rho_sql('cx', 'feature, treatment', 'x', 'y', 'cq')},
    cc AS (SELECT feature, treatment, n, CASE WHEN n >= 10 THEN {rd('rho', 8)} END AS rho FROM cq)"""


@query("g33_effect_drug_concordance", f"WITH {CONCORD} SELECT * FROM cc")
def _(b):
    return op.effect_drug_concordance(effects(b), b("treatments"), target_table(b))


@query("g33_concordance_by_target", f"WITH {CONCORD} SELECT feature, count(*) AS n_treatments, count(CASE WHEN rho > 0 THEN 1 END) AS n_positive, max(rho) AS max_rho, {rd('quantile_cont(rho, 0.5)', 8)} AS median_rho FROM cc WHERE rho IS NOT NULL GROUP BY feature")
def _(b):
    return op.concordance_by_target(op.effect_drug_concordance(effects(b), b("treatments"), target_table(b)))


DRUG = f"{EVENT}, dv AS (SELECT r.treatment, v.entity, v.grp, v.context, r.response AS value FROM ev0 v JOIN treatments r ON r.entity = v.entity WHERE v.task = 't1')"


def t1_context(b):
    return op.event_context(b("mutations"), spine(b), TASKS[:1])


@query("g34_context_drug_shift", f"WITH {DRUG}, {comparison('dv', 'treatment')} SELECT *, CASE WHEN shift IS NULL THEN 'none' WHEN n_context >= 10 AND n_reference >= 10 THEN 'evaluable' ELSE 'insufficient' END AS state FROM cmp")
def _(b):
    return op.context_drug_shift(t1_context(b), b("treatments"))


EXPECTED = {"t1": ["supported", "exploratory", "contradicted"], "fusion": ["supported"], "self": ["failed: same_feature"], "unknown": ["supported"]}


@query("g35_run_controls", f"""WITH {PLAN_SQL} SELECT r.task, r.status, e.expected, contains('|' || e.expected || '|', '|' || r.status || '|') AS passed FROM res r JOIN (VALUES {', '.join(f"('{k}', '{'|'.join(v)}')" for k, v in EXPECTED.items())}) e(task, expected) ON e.task = r.task""")
def _(b):
    return op.run_controls(plan_results(b), EXPECTED)


@query("g36_qc_gap", """SELECT o_custkey AS entity, count(*) AS n_screens, bool_or(o_orderstatus = 'F') AS any_pass FROM orders WHERE o_custkey NOT IN (SELECT entity FROM dependency WHERE value < -1.2) GROUP BY 1""")
def _(b):
    screens = b("orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderstatus") == "F").alias("passes"))
    return op.qc_gap(screens, b("dependency").where("value < -1.2"))


@query("g37_explode_targets", """WITH t AS (SELECT DISTINCT treatment FROM treatments), a AS (SELECT t.treatment, v.target, v.n_targets FROM t JOIN (VALUES ('click', 'F03', 2), ('click', 'F10', 2), ('view', 'F07', 1), ('error', 'F03', 1), ('purchase', 'F12', 1)) v(treatment, target, n_targets) ON v.treatment = t.treatment)
    SELECT treatment, n_targets, target FROM a""")
def _(b):
    return op.explode_targets(annotated(b))


@query("g38_matched_shift", f"""WITH {SPINE}, ps AS (SELECT DISTINCT m.entity, s.grp FROM mutations m JOIN spine s ON s.entity = m.entity WHERE m.feature = 'F03' AND m.is_driver), rw AS (SELECT entity, grp, 'context' AS context FROM ps
      UNION ALL SELECT entity, grp, 'reference' FROM spine WHERE grp IN (SELECT grp FROM ps) AND entity NOT IN (SELECT entity FROM ps)), v AS (SELECT r.treatment, rw.context, r.response AS value FROM rw JOIN treatments r ON r.entity = rw.entity),
    k AS (SELECT treatment, count(CASE WHEN context = 'context' THEN 1 END) AS n_context, count(CASE WHEN context = 'reference' THEN 1 END) AS n_reference, {rd(med('value', 'context'))} AS median_context, {rd(med('value', 'reference'))} AS median_reference, {shift('value')} AS shift FROM v GROUP BY 1)
    SELECT *, CASE WHEN shift IS NULL THEN 'none' WHEN n_context >= 3 AND n_reference >= 10 THEN 'evaluable' ELSE 'insufficient' END AS state FROM k""")
def _(b):
    return op.matched_shift(b("mutations").where("feature = 'F03' and is_driver"), spine(b), b("treatments"))


@query("g39_review_hypotheses", f"""WITH {EVENT}, {adj('ev')}, sg AS (SELECT task, {SIDES} FROM adj GROUP BY task), h AS (SELECT s.task AS hypothesis, k.kind, k.expected, CASE WHEN k.kind = 'gap' THEN NULL ELSE s.shift END AS value FROM sg s, (VALUES ('shift', 1), ('mirror', -1), ('gap', 1)) k(kind, expected))
    SELECT hypothesis, CASE kind WHEN 'shift' THEN 'dependency' WHEN 'mirror' THEN 'dependency' ELSE 'other' END AS category, count(*) AS n, count(CASE WHEN value IS NOT NULL AND sign(value) = expected THEN 1 END) AS agrees, count(CASE WHEN value IS NOT NULL AND sign(value) <> expected AND sign(value) <> 0 THEN 1 END) AS disagrees,
      count(CASE WHEN sign(value) = 0 THEN 1 END) AS neutral, count(CASE WHEN value IS NULL THEN 1 END) AS not_evaluable FROM h GROUP BY 1, 2""")
def _(b):
    stat = op.side_medians(op.adjusted(event_rows(b)), ["task"], "value_adj")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).alias("expected")) for k, e in (("shift", 1), ("mirror", -1), ("gap", 1))])
    rows = stat.select(F.col("task").alias("hypothesis"), "shift", F.inline(kinds)).withColumn("value", F.when(F.col("kind") != "gap", F.col("shift"))).drop("shift")
    return op.review_hypotheses(rows, {"shift": "dependency", "mirror": "dependency"})

"""Registered queries for rank stability and negative controls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from panelgrid.operators import calibrate as cal
from panelgrid.operators import score
from panelgrid.operators import stability as op
from panelgrid.operators.score import Panel, Scenario
from panelgrid.plans import panel_sql as ps
from panelgrid.plans.ranking import BATTERY, candidates, results, scored_grid
from panelgrid.plans.ranking import constants as ranking_constants
from panelgrid.plans.registry import query, rd
from panelgrid.session import small_frame, stage
from panelgrid.sources import sinks

DEFAULT = Scenario("default")
LISTED = 10  # rows of a displayed list
RNA_ONLY = replace(DEFAULT, scenario_id="rna_heavy", weights={"rna": 0.8, "dependency": 0.2})


def rbo_sql(a: str, b: str, keys: str, out: str) -> str:
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    kon = " AND ".join(f"s.{k} = c.{k}" for k in keys.split(", "))
    return f"""{out}_s AS (SELECT {ka}, least(10, a.n, b.n) AS k FROM (SELECT {keys}, count(*) AS n FROM {a} GROUP BY {keys}) a JOIN (SELECT {keys}, count(*) AS n FROM {b} GROUP BY {keys}) b ON {on}),
    {out}_c AS (SELECT {ka}, greatest(a.rank, b.rank) AS at FROM {a} a JOIN {b} b ON {on} AND a.entity = b.entity),
    {out}_d AS (SELECT s.*, d.d, (SELECT count(*) FROM {out}_c c WHERE {kon} AND c.at <= d.d) AS o FROM {out}_s s JOIN (SELECT unnest(range(1, 11)) AS d) d ON d.d <= s.k),
    {out} AS (SELECT {keys}, {rd('max(CASE WHEN d = k THEN CAST(o AS DOUBLE) / d * pow(0.9::DOUBLE, k) END) + (0.1::DOUBLE / 0.9) * sum(CAST(o AS DOUBLE) / d * pow(0.9::DOUBLE, d))')} AS rbo FROM {out}_d GROUP BY {keys})"""


TOPS = "tops AS (SELECT scenario_id, query_id, entity, rank FROM parted WHERE bucket = 'ranked' AND rank <= 10)"
TWO = f"{ps.panel_ctes(BATTERY, [DEFAULT, RNA_ONLY])}, {ps.parted_cte()}, {TOPS}, ta AS (SELECT query_id, entity, rank FROM tops WHERE scenario_id = 'default'), tb AS (SELECT query_id, entity, rank FROM tops WHERE scenario_id = 'rna_heavy')"


def two_runs(b, shown_only=False):
    parted = score.partition_results(results(b, BATTERY, [DEFAULT, RNA_ONLY], best=LISTED if shown_only else None), shown_only=shown_only)
    parted = stage(parted, "two_runs") if shown_only else parted
    return parted.where("scenario_id = 'default'").drop("scenario_id"), parted.where("scenario_id = 'rna_heavy'").drop("scenario_id")


def shown(parted):
    return parted.where("bucket = 'ranked'").select("query_id", "entity", "rank")


@query("i1_rbo", f"WITH {TWO}, {rbo_sql('ta', 'tb', 'query_id', 'r')} SELECT * FROM r")
def _(b):
    x, y = two_runs(b, shown_only=True)
    return op.rbo(shown(x), shown(y), ["query_id"])


@query("i2_kendall_tau", f"""WITH {TWO}, fr AS (SELECT scenario_id, query_id, entity, row_number() OVER (PARTITION BY scenario_id, query_id ORDER BY D DESC, entity) AS p FROM parted WHERE D IS NOT NULL),
    bo AS (SELECT a.query_id, a.entity, a.p AS pa, b.p AS pb FROM fr a JOIN fr b ON a.query_id = b.query_id AND a.entity = b.entity AND a.scenario_id = 'default' AND b.scenario_id = 'rna_heavy')
    SELECT x.query_id, (SELECT count(*) FROM bo z WHERE z.query_id = x.query_id) AS n, {rd("avg(sign(x.pa - y.pa) * sign(x.pb - y.pb))")} AS tau FROM bo x JOIN bo y ON x.query_id = y.query_id AND x.entity < y.entity GROUP BY x.query_id""")
def _(b):
    x, y = two_runs(b)
    return op.kendall_tau(op.full_ranking(x, ["query_id"]), op.full_ranking(y, ["query_id"]), ["query_id"])


@query("i3_membership_change", f"WITH {TWO}, dd AS (SELECT coalesce(ta.query_id, tb.query_id) AS query_id, CASE WHEN ta.entity IS NULL OR tb.entity IS NULL THEN 1 END AS x FROM ta FULL JOIN tb ON ta.query_id = tb.query_id AND ta.entity = tb.entity) SELECT query_id, count(x) AS n_diff, count(x) > 0 AS changed FROM dd GROUP BY 1")
def _(b):
    x, y = two_runs(b, shown_only=True)
    return op.membership_change(shown(x), shown(y), ["query_id"])


_U = "((('0x' || substr(md5('7:' || CAST(c_custkey AS VARCHAR) || ':' || layer), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query("i4_dirichlet_samples", f"WITH d AS (SELECT c_custkey AS sample_id, layer, -ln({_U}) AS x FROM customer, (SELECT unnest([{', '.join(repr(x) for x in score.LAYERS)}]) AS layer) l) SELECT sample_id, layer, round(x / sum(x) OVER (PARTITION BY sample_id), 9) AS weight FROM d")
def _(b):
    ids = b("customer").select(F.col("c_custkey").alias("sample_id"))
    return op.dirichlet_samples(ids, score.LAYERS, 7).withColumn("weight", F.round("weight", 9))


def asked(b, panels, scenarios):
    """What is asked of a sweep: every panel in every scenario."""
    return small_frame(b.spark, [(s, p.query_id) for s in scenarios for p in panels], "scenario_id string, query_id string")


def swept(b, panels, design, shown_only=False):
    return score.partition_results(results(b, panels, [DEFAULT, *design], best=LISTED if shown_only else None), LISTED, shown_only)


def run_design(b, panels, design):
    """Overlaps with the default run, per scenario and query."""
    return op.compare_to_baseline(stage(op.top_lists(swept(b, panels, design, shown_only=True)), "tops"), "default", asked(b, panels, [s.scenario_id for s in design]))


def run_design_with_tau(b, panels, design):
    """Overlaps and rank correlations with the default run, per scenario and query."""
    parted, wanted = swept(b, panels, design), asked(b, panels, [s.scenario_id for s in design])
    return op.compare_to_baseline(stage(op.top_lists(parted), "tops"), "default", wanted).join(op.tau_to_baseline(parted, "default", wanted), ["scenario_id", "query_id"])


def compare_sql(asked: str) -> str:
    return f"""dg AS ({asked}), ba AS (SELECT t.query_id, t.entity, t.rank, d.scenario_id FROM tops t JOIN dg d ON d.query_id = t.query_id WHERE t.scenario_id = 'default'),
    oth AS (SELECT t.* FROM tops t SEMI JOIN dg d ON d.scenario_id = t.scenario_id AND d.query_id = t.query_id WHERE t.scenario_id <> 'default'), {rbo_sql('ba', 'oth', 'scenario_id, query_id', 'r')},
    md AS (SELECT scenario_id, query_id, count(CASE WHEN k = 1 THEN 1 END) AS n_diff FROM (SELECT scenario_id, query_id, entity, count(*) AS k FROM (SELECT scenario_id, query_id, entity FROM ba UNION ALL SELECT scenario_id, query_id, entity FROM oth) z GROUP BY 1, 2, 3) y GROUP BY 1, 2),
    cmp AS (SELECT dg.scenario_id, dg.query_id, r.rbo, coalesce(md.n_diff, 0) AS n_diff FROM dg LEFT JOIN r ON r.scenario_id = dg.scenario_id AND r.query_id = dg.query_id LEFT JOIN md ON md.scenario_id = dg.scenario_id AND md.query_id = dg.query_id),
    mean AS (SELECT scenario_id, {rd('avg(coalesce(rbo, 0.0))')} AS mean_rbo, max(n_diff) AS max_diff FROM cmp GROUP BY 1)"""


def asked_sql(panels, scenarios) -> str:
    qs, ss = (", ".join(f"'{x}'" for x in names) for names in ([p.query_id for p in panels], scenarios))
    return f"SELECT q.query_id, s.scenario_id FROM (SELECT unnest([{qs}]) AS query_id) q, (SELECT unnest([{ss}]) AS scenario_id) s"


def design_sql(panels, design):
    return f"{ps.panel_ctes(panels, [DEFAULT, *design])}, {ps.parted_cte()}, {TOPS}, {compare_sql(asked_sql(panels, [s.scenario_id for s in design]))}"


TAU = f"""fr AS (SELECT scenario_id, query_id, entity, row_number() OVER (PARTITION BY scenario_id, query_id ORDER BY D DESC, entity) AS p FROM parted WHERE D IS NOT NULL),
    bo AS (SELECT a.query_id, b.scenario_id, a.entity, a.p AS pa, b.p AS pb FROM fr a JOIN fr b ON a.query_id = b.query_id AND a.entity = b.entity AND a.scenario_id = 'default' AND b.scenario_id <> 'default'),
    ta AS (SELECT x.scenario_id, x.query_id, {rd("avg(sign(x.pa - y.pa) * sign(x.pb - y.pb))")} AS tau FROM bo x JOIN bo y ON x.scenario_id = y.scenario_id AND x.query_id = y.query_id AND x.entity < y.entity GROUP BY 1, 2)
    SELECT cmp.*, ta.tau FROM cmp LEFT JOIN ta ON ta.scenario_id = cmp.scenario_id AND ta.query_id = cmp.query_id"""
DIRICHLET = op.dirichlet_scenarios(8, 20)
SOBOL = op.saltelli_design(2, 20)


@query("i5_weight_sweep", f"WITH {design_sql(BATTERY, DIRICHLET)}, {TAU}")
def _(b):
    return run_design_with_tau(b, BATTERY, DIRICHLET)


@query("i5_joint_sweep", f"WITH {design_sql(BATTERY, SOBOL)} SELECT * FROM mean")
def _(b):
    return op.sweep_means(run_design(b, BATTERY, SOBOL))


@query("i6_sobol_indices", f"""WITH {design_sql(BATTERY, SOBOL)}, y AS (SELECT split_part(scenario_id, '|', 1) AS kind, split_part(scenario_id, '|', 2) AS j, split_part(scenario_id, '|', 3) AS factor, (mean_rbo - avg(mean_rbo) OVER ()) / stddev_pop(mean_rbo) OVER () AS z FROM mean),
    v AS (SELECT var_pop(z) AS v FROM y WHERE kind IN ('A', 'B')) SELECT x.factor, {rd('avg(b.z * (x.z - a.z)) / max(v.v)', 6)} AS "S1", {rd('avg((a.z - x.z) * (a.z - x.z)) / 2 / max(v.v)', 6)} AS "ST" FROM y x JOIN y a ON a.j = x.j AND a.kind = 'A' JOIN y b ON b.j = x.j AND b.kind = 'B', v WHERE x.kind = 'AB' GROUP BY x.factor""")
def _(b):
    return op.sobol_indices(op.sweep_means(run_design(b, BATTERY, SOBOL)))


@query("i7_tier_grid", f"WITH {design_sql(BATTERY, op.tier_grid())}, {TAU}")
def _(b):
    return run_design_with_tau(b, BATTERY, op.tier_grid())


@query("i8_resume", f"""WITH {design_sql(BATTERY, DIRICHLET[:2])} SELECT d.scenario_id, (SELECT count(*) FROM mean) AS n_done FROM (SELECT unnest([{', '.join(repr(s.scenario_id) for s in DIRICHLET)}]) AS scenario_id) d WHERE d.scenario_id NOT IN (SELECT scenario_id FROM mean)""")
def _(b):
    path = sinks.scratch_path(b.spark, "sweep")
    sinks.commit_parts(op.sweep_means(run_design(b, BATTERY, DIRICHLET[:2])), path, "scenario_id")
    done = sinks.finished_parts(b.spark, path, "scenario_id")
    design = small_frame(b.spark, [(s.scenario_id,) for s in DIRICHLET], "scenario_id string")
    return op.unfinished(design, done).withColumn("n_done", done.agg(F.count(F.lit(1)).alias("n")).scalar())


NEGATIVE = [Panel("negative", ("F03",), ("F06", "F09", "F12"))]


@query("i9_known_negative", f"""WITH {ps.panel_ctes(NEGATIVE, [DEFAULT])}, k AS (SELECT query_id, count(*) AS n, count(CASE WHEN tier IN ('High', 'Moderate') THEN 1 END) AS n_confident, count(CASE WHEN tier <> 'Insufficient' THEN 1 END) AS n_scored, count(CASE WHEN tier <> 'Insufficient' AND veto_feature IN ('F03', 'F06') THEN 1 END) AS n_veto FROM sc GROUP BY 1),
    r AS (SELECT *, {rd('CAST(n_confident AS DOUBLE) / n')} AS confident_fraction, {rd('CAST(n_veto AS DOUBLE) / n_scored')} AS veto_fraction FROM k) SELECT *, confident_fraction <= 0.1 AND veto_fraction > 0.5 AS passed FROM r""")
def _(b):
    return op.known_negative(results(b, NEGATIVE, [DEFAULT]), ["F03", "F06"])


REPEATS = 5
_UF = "((('0x' || substr(md5('11:' || p.query_id || ':' || CAST(r.rep AS VARCHAR) || ':' || f.feature), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
SHADOW = ps.panel_values(BATTERY).replace("panel AS", "asked AS", 1) + f""", drawn AS (SELECT p.query_id, r.rep, f.feature, row_number() OVER (PARTITION BY p.query_id, r.rep ORDER BY {_UF}, f.feature) - 1 AS i
      FROM (SELECT DISTINCT query_id FROM asked) p, (SELECT unnest(range(0, {REPEATS})) AS rep) r, (SELECT DISTINCT feature FROM cells) f),
    panel AS (SELECT * FROM asked UNION ALL SELECT a.query_id || '#' || CAST(d.rep AS VARCHAR), a.ordinal, d.feature, a.role, a.want, a.m_all FROM asked a JOIN drawn d ON d.query_id = a.query_id AND d.i = a.ordinal)"""


@query("i10_random_panels", f"""WITH {ps.panel_ctes([], [DEFAULT], panel=SHADOW)}, r AS (SELECT *, CASE WHEN contains(query_id, '#') THEN 'random' ELSE 'real' END AS kind FROM sc),
    k AS (SELECT kind, count(*) AS n, {rd("avg(CASE WHEN tier IN ('Low', 'Insufficient') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS collapse_fraction, count(D) AS n_scored, {rd('avg(D)', 6)} AS "mean_D",
      {rd('avg(CASE WHEN D >= 0.7 THEN 1.0::DOUBLE WHEN D IS NOT NULL THEN 0.0::DOUBLE END)')} AS high_fraction, {rd('quantile_cont(D, 0.5)')} AS "median_D" FROM r GROUP BY 1)
    SELECT *, CASE WHEN kind = 'random' THEN coalesce("median_D" <= 0.2 AND "mean_D" < 0.5 * (SELECT max("mean_D") FROM k WHERE kind = 'real'), false) END AS passed FROM k""")
def _(b):
    features = [r.feature for r in b("cells").select("feature").distinct().orderBy("feature").collect()]  # the catalogue of features
    return op.score_summary(results(b, [*BATTERY, *op.random_panels(BATTERY, features, REPEATS, 11)], [DEFAULT]))


N_DRAWS = 20
DRAWS = [replace(DEFAULT, scenario_id=str(i)) for i in range(N_DRAWS)]
SHUFFLE = f"""shf AS (SELECT t.draw, t.entity, l.grp AS cal_grp FROM (SELECT d.draw, e.entity, row_number() OVER (PARTITION BY d.draw ORDER BY e.entity) AS p FROM entities e, (SELECT unnest(range(0, {N_DRAWS})) AS draw) d) t
      JOIN (SELECT d.draw, e.entity, row_number() OVER (PARTITION BY d.draw ORDER BY ((('0x' || substr(md5('13:' || CAST(d.draw AS VARCHAR) || ':' || CAST(e.entity AS VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE), e.entity) AS p FROM entities e, (SELECT unnest(range(0, {N_DRAWS})) AS draw) d) s ON s.draw = t.draw AND s.p = t.p JOIN entities l ON l.entity = s.entity)"""
GROUPED = [p for p in BATTERY if p.group]


def shuffled_sql() -> str:
    shuffled = "SELECT v.entity, v.grp, s.cal_grp, v.mutations_state, v.fusions_state, CAST(s.draw AS VARCHAR) AS only_scenario FROM coverage v JOIN shf s ON s.entity = v.entity UNION ALL SELECT entity, grp, grp, mutations_state, fusions_state, 'default' FROM coverage"
    ctes = ps.panel_ctes(GROUPED, [DEFAULT, *DRAWS], shuffled, candidate_join='s.scenario_id = c.only_scenario')
    return f"{SHUFFLE}, {ctes}, {ps.parted_cte()}, {TOPS}, {compare_sql(asked_sql(GROUPED, [s.scenario_id for s in DRAWS]))}"


@query("i11_shuffle_null", f"WITH {shuffled_sql()} SELECT query_id, count(*) AS n_draws, count(rbo) AS n_defined, {rd('avg(rbo)', 8)} AS mean_rbo, coalesce({rd('avg(rbo)', 8)} <= 0.9, false) AS passed FROM cmp GROUP BY 1")
def _(b):
    base = candidates(b)
    mixed = base.join(op.shuffled_groups(b("entities"), N_DRAWS, 13), "entity").withColumn("only_scenario", F.col("draw").cast("string")).drop("draw")
    both = mixed.unionByName(base.withColumn("cal_grp", F.col("grp")).withColumn("only_scenario", F.lit("default")))
    grid = scored_grid(b, GROUPED, [DEFAULT, *DRAWS], candidates=both)
    tops = stage(op.top_lists(score.partition_results(score.combine_features(grid, GROUPED).drop("grp"), shown_only=True)), "tops")
    return op.shuffle_verdict(op.compare_to_baseline(tops, "default", asked(b, GROUPED, [s.scenario_id for s in DRAWS])))


HOLD = "hold AS (SELECT grp FROM entities WHERE grp IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 ORDER BY count(*) DESC, grp LIMIT 5)"
HELD_SCENARIOS = ps.scenario_values([DEFAULT]).replace("scen AS", "scen0 AS", 1) + ", scen AS (SELECT * FROM scen0 UNION ALL SELECT h.grp, s.* EXCLUDE (scenario_id) FROM scen0 s, hold h)"
HELD_GLOBAL = f"""kg AS (SELECT 'default' AS scenario_id, feature, {ps.lt4('rna')} FROM cells GROUP BY feature {ps.gated('rna')} UNION ALL SELECT h.grp, c.feature, {ps.lt4('c.rna')} FROM cells c JOIN entities e ON e.entity = c.entity JOIN hold h ON h.grp <> e.grp GROUP BY h.grp, c.feature {ps.gated('c.rna')})"""
HELD = f"""{HOLD}, {ps.panel_ctes(BATTERY, None, global_constants=HELD_GLOBAL, scenario=HELD_SCENARIOS)}, {ps.parted_cte()}, {TOPS},
    {compare_sql("SELECT DISTINCT p.query_id, h.grp AS scenario_id FROM panel p, hold h WHERE p.want IS DISTINCT FROM h.grp")}"""


def held_out(b):
    """Lists under global constants without each large group in turn, of the panels that are not of that group."""
    names = [r.grp for r in op.holdout_groups(b("entities"), 5, 100).collect()]  # at most five names
    runs = [DEFAULT, *(replace(DEFAULT, scenario_id=g) for g in names)]
    feats = score.panel_features(BATTERY)
    fixed = score.feature_constants(b("cells"), b("roles"), feats, runs, ranking_constants(b)["layers"])
    layer = b("expression_rna").where(F.col("feature").isin(feats))
    held = cal.gate(cal.calibrate_without(layer, b("entities"), names)).select(F.col("held_out").alias("scenario_id"), "feature", F.col("L").alias("h_L"), F.col("T").alias("h_T"))
    own = F.col("scenario_id") == "default"
    constants = fixed.join(held, ["scenario_id", "feature"], "left").withColumns({"g_L": F.when(own, F.col("g_L")).otherwise(F.col("h_L")), "g_T": F.when(own, F.col("g_T")).otherwise(F.col("h_T"))}).drop("h_L", "h_T")
    parted = score.partition_results(results(b, BATTERY, runs, best=LISTED, constants=constants), LISTED, shown_only=True)
    wanted = small_frame(b.spark, [(g, p.query_id) for g in names for p in BATTERY if p.group != g], "scenario_id string, query_id string")
    return op.compare_to_baseline(stage(op.top_lists(parted), "tops"), "default", wanted)


@query("i12_loo_control", f"WITH {HELD} SELECT * FROM cmp")
def _(b):
    return held_out(b)


@query("i12_loo_verdict", f"WITH {HELD} SELECT count(*) AS n, quantile_cont(n_diff, 0.5) AS median_diff, quantile_cont(n_diff, 0.5) <= 2 AS passed FROM cmp")
def _(b):
    return op.holdout_verdict(held_out(b))


@query("i13_informative", f"""WITH {ps.panel_values(BATTERY)}, kl AS (SELECT e.grp, c.feature, {ps.lt4('c.rna')} FROM cells c JOIN entities e ON c.entity = e.entity GROUP BY 1, 2 {ps.gated('c.rna')} AND count(*) >= 235)
    SELECT DISTINCT p.query_id FROM panel p JOIN kl ON kl.grp = p.want AND kl.feature = p.feature""")
def _(b):
    rows = small_frame(b.spark, [(p.query_id, p.group, f) for p in BATTERY for f in p.features], "query_id string, grp string, feature string")
    own = score.group_constants(b("cells"), b("entities"), score.panel_features(BATTERY)).where("l_n >= 235")
    return op.informative_panels(rows, own)


@query("i12_holdout_groups", "SELECT grp, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, grp LIMIT 3")
def _(b):
    return op.holdout_groups(b("entities"), 3, 100)

"""Registered queries for external comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import external as op
from panelgrid.operators import score, stability
from panelgrid.operators.score import Panel
from panelgrid.plans import panel_sql as ps
from panelgrid.plans.ranking import BASE, results
from panelgrid.plans.registry import query, rd
from panelgrid.plans.relations import rho_sql
from panelgrid.session import small_frame, stage

COHORTS = [("AUTO", "AUTOMOBILE"), ("BLD", "Building"), ("BLD", "BUILDING"), ("NONE", "Nowhere"), ("FUR", "FURNITURE"), ("FUR", "HOUSEHOLD")]
GROUPS = "pg AS (SELECT c.cohort, (SELECT arg_min(m.grp, m.place) FROM (VALUES " + ", ".join(f"('{c}', '{g}', {i})" for i, (c, g) in enumerate(COHORTS)) + ") m(cohort, grp, place) WHERE m.cohort = c.cohort AND m.grp IN (SELECT grp FROM entities)) AS grp FROM (VALUES ('AUTO'), ('BLD'), ('NONE'), ('FUR')) c(cohort))"
MARKER = [Panel("marker", ("F03",))]
# A marker is known for two cohorts; a request with a group only has no feature to score, so it is given up.
MODES = [("AUTO", "marker", "F03", None), ("BLD", "marker", "F03", None), ("FUR", "marker", None, None), ("NONE", "marker", None, None), *((c, "group_only", "", "no feature in the request") for c in ("AUTO", "BLD", "FUR", "NONE"))]


@query("l1_pick_group", f"WITH {GROUPS} SELECT * FROM pg")
def _(b):
    return op.pick_group(COHORTS, b("entities"))


EXT = """ext AS (SELECT CASE grp WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'BUILDING' THEN 'BLD' WHEN 'FURNITURE' THEN 'FUR' ELSE 'NONE' END AS cohort, CASE WHEN nationkey = 3 THEN 'X' || name ELSE name END AS name, acctbal AS their_rank FROM entities)"""
RANKED = f"""{ps.panel_ctes(MARKER, BASE)}, {ps.parted_cte()}, {GROUPS}, {EXT}, fr AS (SELECT grp, entity, D, tier, veto_reason, bucket FROM parted WHERE bucket <> 'disqualified'),
    mo AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in m) + ")" for m in MODES)}) t(cohort, mode, panel, error)),
    po AS (SELECT grp, entity, row_number() OVER (PARTITION BY grp ORDER BY D DESC, entity) AS position FROM fr WHERE bucket IN ('ranked', 'ranked_beyond_top_n')),
    cr AS (SELECT x.cohort, mo.mode, mo.panel, mo.error, x.name, x.their_rank, pg.grp, e.entity, fr.D, fr.tier, fr.veto_reason, po.position,
        CASE WHEN pg.grp IS NULL THEN 'no_group_match' WHEN mo.error IS NOT NULL THEN 'abandoned' WHEN mo.panel IS NULL THEN 'no_marker' WHEN e.entity IS NULL THEN 'id_not_found' WHEN fr.entity IS NULL THEN 'not_scored' ELSE 'ok' END AS status
      FROM ext x JOIN mo ON mo.cohort = x.cohort LEFT JOIN pg ON pg.cohort = x.cohort LEFT JOIN entities e ON e.name = x.name LEFT JOIN fr ON fr.entity = e.entity AND fr.grp = pg.grp AND mo.panel = 'F03' LEFT JOIN po ON po.entity = e.entity AND po.grp = pg.grp AND mo.panel = 'F03')"""


def compared(b):
    e = b("entities")
    cohort = F.when(F.col("grp") == "AUTOMOBILE", "AUTO").when(F.col("grp") == "BUILDING", "BLD").when(F.col("grp") == "FURNITURE", "FUR").otherwise("NONE")
    theirs = e.select(cohort.alias("cohort"), F.when(F.col("nationkey") == 3, F.concat(F.lit("X"), "name")).otherwise(F.col("name")).alias("name"), F.col("acctbal").alias("their_rank"))
    groups = op.pick_group(COHORTS, e)
    parted = stage(score.partition_results(results(b, MARKER, with_group=True)).where("bucket <> 'disqualified'"), "marker")
    places = stability.full_ranking(parted.where("bucket in ('ranked', 'ranked_beyond_top_n')"), ["grp"])
    modes = small_frame(b.spark, MODES, "cohort string, mode string, panel string, error string")
    ours = parted.join(places, ["grp", "entity"], "left").join(groups.where("grp is not null"), "grp").join(modes.where("panel = 'F03'").select("cohort", "mode"), "cohort")
    return op.compare_ranking(theirs, e.select("name", "entity"), groups, modes, ours.select("cohort", "mode", "entity", "D", "tier", "veto_reason", "position"))


@query("l2_compare_ranking", f"WITH {RANKED} SELECT * FROM cr")
def _(b):
    return compared(b)


@query("l2_ranking_agreement", f"WITH {RANKED}, ok_ AS (SELECT cohort, mode, their_rank, position FROM cr WHERE status = 'ok' AND position IS NOT NULL), {rho_sql('ok_', 'cohort, mode', 'their_rank', 'position', 'k')} SELECT cohort, mode, n, CASE WHEN n >= 3 THEN {rd('rho', 8)} END AS rho FROM k")
def _(b):
    return op.ranking_agreement(stage(compared(b), "compared"))


@query("l3_label_agreement", """WITH t AS (SELECT c_custkey AS k, ' ' || upper(s_nation) || ' ' AS their_label FROM (SELECT c.c_custkey, n.n_name AS s_nation FROM customer c JOIN nation n ON n.n_nationkey = (c.c_custkey % 25)) q), o AS (SELECT entity AS k, subgroup AS our_label FROM entities WHERE acctbal > 0),
    r AS (SELECT count(*) AS n_total, count(o.k) AS n_matched, count(CASE WHEN lower(trim(t.their_label)) = lower(trim(o.our_label)) THEN 1 END) AS n_agree FROM t LEFT JOIN o ON o.k = t.k) SELECT *, round(CAST(n_matched AS DOUBLE) / n_total, 6) AS match_rate, round(CAST(n_agree AS DOUBLE) / n_matched, 6) AS agree_rate FROM r""")
def _(b):
    nations = b("nation").select(F.col("n_nationkey").cast("bigint").alias("_n"), F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("their_label"))
    theirs = b("customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 25).alias("_n")).join(nations, "_n").drop("_n")
    return op.label_agreement(theirs, b("entities").where("acctbal > 0").select(F.col("entity").alias("k"), F.col("subgroup").alias("our_label")), "k")


DIRECTION = [Panel("p1", ("F03", "F06")), Panel("p2", ("F10", "F13"))]


@query("l4_direction_check", f"""WITH {ps.panel_ctes(DIRECTION, BASE)}, m AS (SELECT grp, query_id, avg(D) AS m FROM sc WHERE D IS NOT NULL GROUP BY 1, 2), r AS (SELECT {rd("max(CASE WHEN grp = 'BUILDING' AND query_id = 'p1' THEN m END)", 8)} AS first_high, {rd("max(CASE WHEN grp = 'BUILDING' AND query_id = 'p2' THEN m END)", 8)} AS first_low,
    {rd("max(CASE WHEN grp = 'MACHINERY' AND query_id = 'p2' THEN m END)", 8)} AS second_high, {rd("max(CASE WHEN grp = 'MACHINERY' AND query_id = 'p1' THEN m END)", 8)} AS second_low FROM m) SELECT *, CASE WHEN first_high > first_low AND second_high > second_low THEN 'consistent' ELSE 'inconsistent' END AS verdict FROM r""")
def _(b):
    scores = results(b, DIRECTION, with_group=True).select(F.col("grp").alias("cohort"), F.col("query_id").alias("panel"), "D")
    return op.direction_check(scores, ("BUILDING", "p1", "p2"), ("MACHINERY", "p2", "p1"))


SAM = "sam AS (SELECT DISTINCT r.r_name AS study, o.o_orderkey AS sample FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"
MEAS = "mea AS (SELECT sam.study, l.layer, sam.sample FROM sam JOIN (SELECT o_orderkey AS sample, CASE o_orderstatus WHEN 'F' THEN 'sv' WHEN 'O' THEN 'rna' ELSE 'dna' END AS layer FROM orders) l ON l.sample = sam.sample)"


def samples(b):
    nations = b("nation").join(b("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("study"))
    owners = b("customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "study")
    return b("orders").join(owners, "o_custkey").select("study", F.col("o_orderkey").alias("sample"), F.when(F.col("o_orderstatus") == "F", "sv").when(F.col("o_orderstatus") == "O", "rna").otherwise("dna").alias("layer"))


@query("l5_denominators", f"WITH {SAM}, {MEAS} SELECT study, layer, count(*) AS n_measured FROM mea GROUP BY 1, 2")
def _(b):
    s = samples(b)
    return op.denominators(s.select("study", "sample"), s)


EXPECTED = [("ASIA", "F03", "F10"), ("EUROPE", "F12", "F07"), ("AFRICA", "F99", "F01")]


@query("l6_pair_prevalence", f"""WITH {SAM}, {MEAS}, x AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{min(a, c)}', '{max(a, c)}')" for s, a, c in EXPECTED)}) t(study, low, high)), ins AS (SELECT study, sample FROM mea WHERE layer = 'sv'),
    h AS (SELECT x.study, x.low, x.high, count(DISTINCT f.sample) AS n_samples FROM x LEFT JOIN (SELECT f.sample, least(feature_a, feature_b) AS low, greatest(feature_a, feature_b) AS high, i.study FROM fusion_calls f JOIN ins i ON i.sample = f.sample WHERE feature_b IS NOT NULL) f ON f.study = x.study AND f.low = x.low AND f.high = x.high GROUP BY 1, 2, 3),
    z AS (SELECT study, count(*) AS n FROM ins GROUP BY 1) SELECT h.*, z.n AS n_measured, {rd('100.0::DOUBLE * n_samples / z.n', 6)} AS pct FROM h JOIN z ON z.study = h.study""")
def _(b):
    s = samples(b)
    events = b("fusion_calls").select("sample", F.col("feature_a").alias("feature"), F.col("feature_b").alias("partner"))
    return op.pair_prevalence(events, s.select("study", "sample"), EXPECTED, s.where("layer = 'sv'").select("study", "sample"))


@query("l7_event_prevalence", f"""WITH {SAM}, g AS (SELECT study, count(*) AS n_samples FROM sam GROUP BY 1), m AS (SELECT s.study, m.feature, m.sample, bool_or(m.is_driver OR m.is_hotspot OR m.impact = 'HIGH') AS damaging FROM mutations m JOIN sam s ON s.sample = m.sample GROUP BY 1, 2, 3)
    SELECT g.study, f.feature, g.n_samples, d.definition, count(CASE WHEN d.definition = 'any_variant' OR m.damaging THEN m.sample END) AS n_altered, {rd("100.0::DOUBLE * count(CASE WHEN d.definition = 'any_variant' OR m.damaging THEN m.sample END) / g.n_samples", 6)} AS pct
    FROM g JOIN (VALUES ('F03'), ('F77')) f(feature) ON true JOIN (VALUES ('any_variant'), ('damaging')) d(definition) ON true LEFT JOIN m ON m.study = g.study AND m.feature = f.feature GROUP BY 1, 2, 3, 4""")
def _(b):
    rules = {"any_variant": F.lit(True), "damaging": F.col("is_driver") | F.col("is_hotspot") | (F.col("impact") == "HIGH")}
    return op.event_prevalence(b("mutations"), samples(b).select("study", "sample"), ["F03", "F77"], rules)


@query("l8_copy_prevalence", f"""SELECT e.grp AS study, c.feature, count(*) AS n, {", ".join(f"{rd('100.0::DOUBLE * count(CASE WHEN CAST(round((copy_number - 1) * 2.2) AS INT) = %d THEN 1 END) / count(*)' % s, 6)} AS {n}_pct" for n, s in (('deep_loss', -2), ('gain', 1), ('amplification', 2)))} FROM cells c JOIN entities e ON e.entity = c.entity GROUP BY 1, 2""")
def _(b):
    rows = b("cells").join(b("entities").select("entity", F.col("grp").alias("study")), "entity")
    return op.copy_prevalence(rows.select("study", "feature", F.round((F.col("copy_number") - 1) * 2.2).cast("int").alias("state")))


WS = f"ws AS (SELECT e.grp AS study, p.a, p.b, x.rna AS x, y.rna AS y FROM (VALUES ('F03', 'F10'), ('F07', 'F12')) p(a, b) JOIN cells x ON x.feature = p.a JOIN cells y ON y.feature = p.b AND y.entity = x.entity JOIN entities e ON e.entity = x.entity), {rho_sql('ws', 'study, a, b', 'x', 'y', 'wk')}, wr AS (SELECT study, a, b, n, CASE WHEN n >= 160 THEN {rd('rho', 8)} END AS rho FROM wk)"


def study_rho(b):
    values = b("expression_rna").join(b("entities").select("entity", F.col("grp").alias("study")), "entity").select("study", F.col("entity").alias("sample"), "feature", "value")
    return op.within_study_corr(values, [("F03", "F10"), ("F07", "F12")], 160)


@query("l9_within_study_corr", f"WITH {WS} SELECT * FROM wr")
def _(b):
    return study_rho(b)


@query("l9_study_summary", f"WITH {WS} SELECT a, b, count(*) AS n_studies, count(CASE WHEN rho > 0 THEN 1 END) AS n_positive, {rd('quantile_cont(rho, 0.5)', 8)} AS median_rho FROM wr WHERE rho IS NOT NULL GROUP BY 1, 2")
def _(b):
    return op.study_summary(stage(study_rho(b), "studies"))


@query("l10_grain_audit", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(sum(k) AS BIGINT) AS n_rows, count(CASE WHEN k > 1 THEN 1 END) AS n_repeated_keys, CAST(coalesce(sum(CASE WHEN k > 1 THEN k END), 0) AS BIGINT) AS n_rows_in_them FROM (SELECT count(*) AS k FROM {t} GROUP BY {g}) q" for t, g in (("lineitem", "l_orderkey, l_linenumber"), ("orders", "o_orderkey"), ("labels", "doc_id"))))
def _(b):
    return op.grain_audit({t: b(t) for t in ("lineitem", "orders", "labels")}, {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "labels": ["doc_id"]})


def catalogue(b):
    return {"labels": (b("labels"), "document labels"), "treatments": (b("treatments"), "response per entity")}


@query("l11_studies", "SELECT 'labels' AS study, 'document labels' AS note, count(*) AS n_rows FROM labels UNION ALL SELECT 'treatments', 'response per entity', count(*) FROM treatments")
def _(b):
    return op.studies(catalogue(b))


@query("l11_study_preview", "SELECT entity, treatment, response FROM treatments ORDER BY entity, treatment LIMIT 20")
def _(b):
    return op.study(catalogue(b), "treatments", ["entity", "treatment"], 20)


LOOKUP = {"1-URGENT": "BUILDING", "2-HIGH": "BUILDING", "3-MEDIUM": "MACHINERY", "5-LOW": "Elsewhere"}


@query("l12_cohort_map", f"""WITH lk AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in LOOKUP.items())}) t(project, grp)), s AS (SELECT lk.grp, count(DISTINCT o_orderpriority || '/' || CAST(o_custkey AS VARCHAR)) AS n_subjects, count(DISTINCT o_orderpriority) AS n_projects, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS projects
      FROM orders JOIN lk ON lk.project = o_orderpriority GROUP BY 1), e AS (SELECT grp, count(*) AS n_entities FROM entities GROUP BY 1) SELECT coalesce(e.grp, s.grp) AS grp, coalesce(n_entities, 0) AS n_entities, coalesce(n_subjects, 0) AS n_subjects, coalesce(n_projects, 0) AS n_projects, coalesce(projects, '') AS projects FROM e FULL JOIN s ON s.grp = e.grp""")
def _(b):
    projects = b("orders").select(F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("subject"))
    return op.cohort_map(projects, LOOKUP, b("entities"))


@query("l13_audit_registry", """WITH r AS (SELECT DISTINCT p_type AS column_name, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'scoring' WHEN p_type = 'LARGE' THEN 'context' WHEN p_type = 'ECONOMY' THEN 'validation' ELSE 'excluded' END AS role FROM part)
    SELECT role, count(*) AS n, string_agg(column_name, '|' ORDER BY column_name) AS columns, CASE role WHEN 'scoring' THEN 1 WHEN 'context' THEN 2 WHEN 'validation' THEN 3 ELSE 4 END AS place FROM r GROUP BY role""")
def _(b):
    t = F.col("p_type")
    rows = b("part").select(t.alias("column_name"), F.when(t.isin("PROMO", "SMALL"), "scoring").when(t == "LARGE", "context").when(t == "ECONOMY", "validation").otherwise("excluded").alias("role")).distinct()
    return op.audit_registry(rows)

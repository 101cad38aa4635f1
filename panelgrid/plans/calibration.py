"""Registered queries for calibration and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import calibrate as op
from panelgrid.plans.registry import query, rd


def q(expr: str, p: float) -> str:
    return f"quantile_cont({expr}, {p})"


def lt(expr: str = "value", digits: int = 9) -> str:
    return f"{rd(q(expr, 0.1), digits)} AS L, {rd(q(expr, 0.9), digits)} AS T"


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


XG = "xg AS (SELECT x.entity, x.feature, x.value, e.grp, e.subgroup FROM expression_rna x JOIN entities e ON x.entity = e.entity)"


@query("e1_calibrate_global", f"SELECT feature, {lt()}, count(*) AS n FROM expression_rna GROUP BY feature")
def _(b):
    return rounded(op.calibrate_global(b("expression_rna")), 9, "L", "T")


@query("e2_calibrate_group", f"WITH {XG} SELECT grp, feature, {lt()}, count(*) AS n FROM xg GROUP BY grp, feature")
def _(b):
    return rounded(op.calibrate_group(b("expression_rna"), b("entities")), 9, "L", "T")


@query("e3_gate", f"WITH {XG} SELECT grp, feature, {lt(digits=4)}, count(*) AS n FROM xg GROUP BY grp, feature HAVING quantile_cont(value, 0.9) > quantile_cont(value, 0.1) AND count(*) >= 230")
def _(b):
    return op.gate(op.calibrate_group(b("expression_rna"), b("entities")), 230)


@query("e4_calibrate_pooled", f"SELECT {lt()}, count(*) AS n FROM protein WHERE detected")
def _(b):
    return rounded(op.calibrate_pooled(b("protein")), 9, "L", "T")


@query("e5_calibrate_strength", f"SELECT feature, {lt('-value')}, count(*) AS n FROM dependency GROUP BY feature")
def _(b):
    return rounded(op.calibrate_strength(b("dependency")), 9, "L", "T")


@query("e6_flag_broad", "SELECT feature, count(*) AS n, count(CASE WHEN value < -1.0 THEN 1 END) AS n_strong, round(CAST(count(CASE WHEN value < -1.0 THEN 1 END) AS DOUBLE) / count(*), 9) AS fraction FROM dependency GROUP BY feature HAVING count(*) >= 30 AND CAST(count(CASE WHEN value < -1.0 THEN 1 END) AS DOUBLE) / count(*) >= 0.145")
def _(b):
    return rounded(op.flag_broad(b("dependency"), fraction=0.145), 9, "fraction")


@query("e7_regate", f"""WITH {XG}, k AS (SELECT grp, feature, {lt()}, count(*) AS n FROM xg GROUP BY grp, feature HAVING count(*) >= 5)
    SELECT k.*, t.sample_id, t.min_n FROM k JOIN (VALUES ('low', 15), ('mid', 230), ('high', 240)) t(sample_id, min_n) ON k.n >= t.min_n""")
def _(b):
    floor = op.calibrate_group(b("expression_rna"), b("entities")).where("n >= 5")
    return rounded(op.regate(floor, {"low": 15, "mid": 230, "high": 240}), 9, "L", "T")


@query("e8_flag_broad_many", """SELECT t.sample_id, d.feature, count(*) AS n, round(avg(CASE WHEN d.value < t.c THEN 1.0E0 ELSE 0.0E0 END), 9) AS fraction FROM dependency d
    JOIN (VALUES ('s1', -1.0, 0.14, 30), ('s2', -0.5, 0.31, 100), ('s3', -1.5, 0.05, 1100), ('s4', -1.0, 0.9, 30)) t(sample_id, c, f, k) ON true
    GROUP BY t.sample_id, d.feature, t.f, t.k HAVING count(*) >= t.k AND avg(CASE WHEN d.value < t.c THEN 1.0E0 ELSE 0.0E0 END) >= t.f""")
def _(b):
    return rounded(op.flag_broad_many(b("dependency"), [("s1", -1.0, 0.14, 30), ("s2", -0.5, 0.31, 100), ("s3", -1.5, 0.05, 1100), ("s4", -1.0, 0.9, 30)]), 9, "fraction")


@query("e9_calibrate_without", f"WITH {XG} SELECT h.grp AS held_out, x.feature, {lt('x.value')}, count(*) AS n FROM xg x JOIN (SELECT DISTINCT grp FROM entities) h ON x.grp <> h.grp GROUP BY h.grp, x.feature")
def _(b):
    return rounded(op.calibrate_without(b("expression_rna"), b("entities")), 9, "L", "T")


@query("e10_matrix_summary", " UNION ALL ".join(f"SELECT '{k}' AS axis, CAST({k} AS STRING) AS item, count(*) AS n, {rd('avg(value)', 10)} AS mean, {rd('stddev_pop(value)', 10)} AS sd, {rd('100.0E0 * avg(CASE WHEN value <= -0.5 THEN 1.0E0 ELSE 0.0E0 END)', 10)} AS strong_pct FROM dependency GROUP BY {k}" for k in ("feature", "entity")))
def _(b):
    d = b("dependency")
    parts = [op.matrix_summary(d, k, F.col("value") <= -0.5).select(F.lit(k).alias("axis"), F.col(k).cast("string").alias("item"), "n", "mean", "sd", "strong_pct") for k in ("feature", "entity")]
    return rounded(parts[0].unionByName(parts[1]), 10, "mean", "sd", "strong_pct")


@query("e11_pair_evidence", """SELECT entity, least(feature_a, feature_b) AS feature_low, greatest(feature_a, feature_b) AS feature_high, count(*) AS n_calls, sum(reads) AS total_reads, max(reads) AS max_reads,
    bool_or(confidence = 'high') AS any_flag, string_agg(DISTINCT feature_a || '->' || feature_b, '|' ORDER BY feature_a || '->' || feature_b) AS orientations, string_agg(DISTINCT reading_frame, '|' ORDER BY reading_frame) AS annotations
    FROM fusion_calls WHERE feature_b IS NOT NULL GROUP BY 1, 2, 3""")
def _(b):
    f = b("fusion_calls").select("entity", "feature_a", "feature_b", "reads", (F.col("confidence") == "high").alias("flag"), F.col("reading_frame").alias("annotation"))
    return op.pair_evidence(f, "feature_a", "feature_b")


@query("e12_burden", """WITH a AS (SELECT entity FROM entities WHERE acctbal >= 0), r AS (SELECT a.entity, count(m.entity) AS n FROM a LEFT JOIN mutations m ON a.entity = m.entity GROUP BY 1),
    l AS (SELECT quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS lim FROM r) SELECT entity, n AS n_events, n > lim AS review FROM r, l""")
def _(b):
    return op.burden(b("mutations"), b("entities").where("acctbal >= 0"))


@query("e13_iqr_flags", "WITH " + ", ".join(f"l{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM signatures)" for i, c in enumerate(["ploidy", "msi_score", "loh_fraction"])) + ", f AS (SELECT entity, " + ", ".join(
    f"({c} < l{i}.q1 - 1.5 * (l{i}.q3 - l{i}.q1) OR {c} > l{i}.q3 + 1.5 * (l{i}.q3 - l{i}.q1)) AS {c}_outlier" for i, c in enumerate(["ploidy", "msi_score", "loh_fraction"])) + """ FROM signatures, l0, l1, l2)
    SELECT *, CAST(CAST(ploidy_outlier AS INT) + CAST(msi_score_outlier AS INT) + CAST(loh_fraction_outlier AS INT) AS BIGINT) AS n_flags FROM f""")
def _(b):
    return op.iqr_flags(b("signatures"), ["ploidy", "msi_score", "loh_fraction"])


@query("e14_recurrence", """WITH a AS (SELECT entity FROM entities WHERE acctbal >= 0) SELECT feature, count(DISTINCT m.entity) AS n_altered, (SELECT count(*) FROM a) AS n_assayed,
    round(100.0E0 * count(DISTINCT m.entity) / (SELECT count(*) FROM a), 6) AS pct FROM mutations m JOIN a ON m.entity = a.entity GROUP BY feature""")
def _(b):
    return op.recurrence(b("mutations"), b("entities").where("acctbal >= 0"))


@query("e14_recurrence_by_group", """WITH a AS (SELECT entity, grp FROM entities WHERE acctbal >= 0), s AS (SELECT grp, count(*) AS n_assayed FROM a GROUP BY grp)
    SELECT a.grp, m.feature, count(DISTINCT m.entity) AS n_altered, s.n_assayed, round(100.0E0 * count(DISTINCT m.entity) / s.n_assayed, 6) AS pct FROM mutations m JOIN a ON m.entity = a.entity JOIN s ON s.grp = a.grp GROUP BY a.grp, m.feature, s.n_assayed""")
def _(b):
    return op.recurrence(b("mutations"), b("entities").where("acctbal >= 0"), b("entities"))


@query("e15_definition_counts", " UNION ALL ".join(f"SELECT '{n}' AS definition, count(DISTINCT entity) AS n_entities, count(DISTINCT entity * 1000 + CAST(substr(feature, 2) AS INT)) AS n_cells FROM mutations WHERE {r}" for n, r in (("any", "true"), ("high", "impact = 'HIGH'"), ("driver_or_hotspot", "is_driver OR is_hotspot"))))
def _(b):
    return op.definition_counts(b("mutations"), {"any": F.lit(True), "high": F.col("impact") == "HIGH", "driver_or_hotspot": F.col("is_driver") | F.col("is_hotspot")})


@query("e16_crosstab", "SELECT impact, is_driver, count(*) AS n, CAST(grouping_id(impact, is_driver) AS BIGINT) AS level FROM mutations GROUP BY CUBE(impact, is_driver)")
def _(b):
    return op.crosstab(b("mutations"), "impact", "is_driver")


_E17 = ["c_acctbal", "c_nationkey", "high_balance"]


@query("e17_profile_columns", "WITH r AS (SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS high_balance FROM customer) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, {rd(f'avg({c})', 6)} AS mean, {rd(f'stddev_samp({c})', 6)} AS sd, min({c}) AS min_value, max({c}) AS max_value,
    {rd(f'skewness({c})', 6)} AS skew, count(DISTINCT {c}) AS n_distinct, {rd(f'quantile_cont({c}, 0.5)', 6)} AS median, round(100.0E0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM r""" for c in _E17))
def _(b):
    rows = b("customer").select("c_acctbal", "c_nationkey", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("high_balance"))
    return rounded(op.profile_columns(rows, _E17), 6, "mean", "sd", "skew", "median")


@query("e18_top_variable", f"SELECT feature, count(*) AS n, {rd('stddev_samp(value)')} AS sd FROM expression_rna GROUP BY feature ORDER BY sd DESC, feature LIMIT 10")
def _(b):
    return op.top_variable(b("expression_rna"), 10)


@query("e19_rate_by_decile", f"""WITH r AS (SELECT x.value AS v, p.detected AS f FROM expression_rna x JOIN protein p ON x.entity = p.entity AND x.feature = p.feature),
    e AS (SELECT DISTINCT edge FROM (SELECT unnest([{', '.join(rd(f'quantile_cont(v, 0.{i})') for i in range(1, 10))}]) AS edge FROM r) z),
    k AS (SELECT r.v, r.f, (SELECT count(*) FROM e WHERE e.edge < r.v) AS bin FROM r)
    SELECT CAST(bin AS INT) AS bin, count(*) AS n, min(v) AS lowest, max(v) AS highest, round(avg(CASE WHEN f THEN 1.0E0 ELSE 0.0E0 END), 9) AS rate FROM k GROUP BY 1""")
def _(b):
    cells = b("cells").select(F.col("rna").alias("v"), "detected")
    return op.rate_by_decile(cells, "v", "detected")


@query("e20_feature_by_subgroup", f"""WITH {XG}, s AS (SELECT subgroup, count(*) AS n_measured, {rd(q('value', .25))} AS iqr_low, {rd(q('value', .5))} AS median, {rd(q('value', .75))} AS iqr_high FROM xg WHERE feature = 'F07' GROUP BY subgroup)
    SELECT e.subgroup, e.n AS n_entities, s.iqr_low, s.median, s.iqr_high, coalesce(s.n_measured, 0) AS n_measured, coalesce(s.n_measured, 0) < 45 AS flagged FROM (SELECT subgroup, count(*) AS n FROM entities GROUP BY 1) e LEFT JOIN s ON s.subgroup = e.subgroup""")
def _(b):
    return rounded(op.feature_by_subgroup(b("expression_rna"), b("entities"), "F07", 45), 9, "iqr_low", "median", "iqr_high")


@query("e21_group_subgroup_counts", "SELECT grp, subgroup, count(*) AS n FROM entities GROUP BY 1, 2")
def _(b):
    return op.group_subgroup_counts(b("entities"))


@query("e22_feature_points", """WITH f AS (SELECT entity, feature, value FROM expression_rna WHERE feature = 'F07' ORDER BY entity LIMIT 100)
    SELECT f.*, e.name, e.grp, (SELECT count(*) FROM expression_rna WHERE feature = 'F07') AS n_measured FROM f LEFT JOIN entities e ON e.entity = f.entity""")
def _(b):
    return op.feature_points(b("expression_rna"), b("entities"), "F07", 100)


@query("e23_group_medians", f"WITH {XG} SELECT feature, grp, {rd(q('value', .5))} AS m FROM xg GROUP BY 1, 2 HAVING count(*) >= 230")
def _(b):
    return rounded(op.group_medians(b("expression_rna"), b("entities"), 230), 9, "m")


@query("e24_shape_stats", f"""WITH c AS (SELECT feature, quantile_cont(value, 0.99) AS cap FROM copy_number GROUP BY 1)
    SELECT x.feature, count(*) AS n, {rd('skewness(x.value)', 6)} AS skew, {rd('kurtosis(x.value)', 6)} AS kurt, {rd('max(c.cap)', 6)} AS cap, {rd('avg(least(x.value, c.cap))', 6)} AS clipped_mean FROM copy_number x JOIN c ON c.feature = x.feature GROUP BY x.feature""")
def _(b):
    return rounded(op.shape_stats(b("copy_number")), 6, "skew", "kurt", "cap", "clipped_mean")


@query("e25_mirror_audit", """WITH k AS (SELECT entity, feature, partner, count(*) AS k FROM fusions WHERE partner IS NOT NULL GROUP BY 1, 2, 3)
    SELECT CAST(sum(a.k) AS BIGINT) AS n_directed, CAST(sum(CASE WHEN m.k IS NOT NULL THEN a.k END) AS BIGINT) AS n_mirrored, count(CASE WHEN a.k = m.k THEN 1 END) AS n_equal_keys, count(CASE WHEN a.feature = a.partner THEN 1 END) AS n_self_keys
    FROM k a LEFT JOIN k m ON a.entity = m.entity AND a.feature = m.partner AND a.partner = m.feature""")
def _(b):
    return op.mirror_audit(b("fusions"))

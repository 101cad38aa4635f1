"""Registered queries for projection, reshape, filters and scalar transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.functions import columns as c
from panelgrid.functions.distribution import percentiles
from panelgrid.operators import reshape as op
from panelgrid.plans.registry import query, rd

FEATURES = [f"F{i:02d}" for i in range(1, 26)]


def wide(b):
    return op.pivot_features(b("expression_rna"), FEATURES)


@query("b1_unpivot_matrix", "SELECT entity, feature, value AS rna FROM expression_rna")
def _(b):
    return op.unpivot_matrix(wide(b), ["entity"], "feature", "rna")


_GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("b2_unpivot_transposed", """SELECT x.feature, e.grp AS sample, round(max(x.value), 6) AS value
    FROM expression_rna x JOIN entities e ON x.entity = e.entity GROUP BY x.feature, e.grp""")
def _(b):
    joined = b("expression_rna").join(b("entities").select("entity", "grp"), "entity")
    by_feature = joined.groupBy("feature").pivot("grp", _GROUPS).agg(F.max("value"))
    return op.unpivot_transposed(by_feature, "feature", "sample", "value")


@query("b3_pivot_features", """SELECT entity, max(CASE WHEN feature='F02' THEN value END) AS "F02", max(CASE WHEN feature='F07' THEN value END) AS "F07"
    FROM expression_rna WHERE feature IN ('F02','F07') GROUP BY entity""")
def _(b):
    return op.pivot_features(b("expression_rna"), ["F02", "F07"])


@query("b4_project_pair", """SELECT entity, max(CASE WHEN feature='F02' THEN value END) AS a_rna, max(CASE WHEN feature='F07' THEN value END) AS b_rna,
    max(CASE WHEN feature='F02' THEN value END) AS b_same FROM expression_rna WHERE feature IN ('F02','F07') GROUP BY entity""")
def _(b):
    matrix = op.pivot_features(b("expression_rna"), ["F02", "F07"])
    return op.project_pair(matrix, "F02", "F07", "rna").join(op.project_pair(matrix, "F02", "F02", "same").select("entity", "b_same"), "entity")


@query("b5_parse_feature_header", "SELECT DISTINCT p_brand AS symbol, 'F' || substr(p_brand, 7) AS feature_id, p_brand AS symbol_after, 'F' || substr(p_brand, 7) AS id_after FROM part")
def _(b):
    ident = F.concat(F.lit("F"), F.substr("p_brand", F.lit(7)))
    heads = b("part").select(F.concat("p_brand", F.lit(" ("), ident, F.lit(".12)")).alias("h1"), F.concat(ident, F.lit(" ("), "p_brand", F.lit(")")).alias("h2")).distinct()
    (s1, i1), (s2, i2) = op.parse_feature_header("h1"), op.parse_feature_header("h2", "after")
    return heads.select(s1.alias("symbol"), i1.alias("feature_id"), s2.alias("symbol_after"), i2.alias("id_after"))


@query("b6_log_transforms", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(log2(l_quantity + 1), 9) AS log2p1, round(ln(1 + l_quantity), 9) AS log1p FROM lineitem")
def _(b):
    return b("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(c.log2p1("l_quantity"), 9).alias("log2p1"), F.round(c.log1p("l_quantity"), 9).alias("log1p"))


@query("b7_threshold_flags", "SELECT entity, feature, value > 1.5 AS amp, value < 0.5 AS del FROM copy_number")
def _(b):
    return op.add_copy_flags(b("copy_number")).select("entity", "feature", "amp", "del")


@query("b7_signature_flags", "SELECT entity, msi_score >= 20 AS msi_high, ploidy IS NOT NULL AND loh_fraction IS NOT NULL AS wgs_available FROM signatures")
def _(b):
    return op.add_signature_flags(b("signatures"), "msi_score", ["ploidy", "loh_fraction"]).select("entity", "msi_high", "wgs_available")


@query("b8_keep_default", "SELECT sample, feature_a, reads FROM fusion_calls WHERE is_default = 'Yes'")
def _(b):
    return op.keep_default(b("fusion_calls"), "is_default").select("sample", "feature_a", "reads")


@query("b9_fill_unknown", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'Unknown') AS \"Subtype\" FROM customer")
def _(b):
    rows = b("customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("Subtype"))
    return op.fill_unknown(rows, op.UNKNOWN_COLUMNS)


@query("b10_symmetrise", "SELECT entity, feature, partner, reads FROM fusions")
def _(b):
    calls = op.keep_default(b("fusion_calls"), "is_default").select("entity", "reads", "feature_a", "feature_b")
    return op.symmetrise(calls, "feature_a", "feature_b")


@query("b11_impute_floor", f"""SELECT entity, feature, NOT detected AS imputed, CASE WHEN detected THEN value
    ELSE (SELECT {rd("quantile_cont(value, 0.01)")} FROM protein WHERE detected) END AS value FROM protein""")
def _(b):
    return op.impute_floor(b("protein"), "value", "detected").select("entity", "feature", "imputed", F.round("value", 9).alias("value"))


@query("b12_filter_candidates", """SELECT e.entity, e.grp FROM entities e JOIN coverage c ON e.entity = c.entity
    WHERE e.grp = 'BUILDING' AND NOT e.is_problematic AND c.ploidy >= 3.0 AND c.ploidy <= 5.5 AND c.mirna_available AND c.msi_high = false""")
def _(b):
    return op.filter_candidates(
        b("entities"), b("coverage"), group="BUILDING", exclude_problematic=True, msi_high=False, ploidy_min=3.0, ploidy_max=5.5, require=("mirna",)).select("entity", "grp")


@query("b13_text_filters", """SELECT doc_id, coalesce(regexp_matches(lower(text), 'license|copyright'), false) AS flagged FROM documents WHERE contains(text, 'the')""")
def _(b):
    docs = b("documents").where(F.coalesce(F.col("text").contains("the"), F.lit(False)))
    return docs.select("doc_id", F.coalesce(F.col("text").rlike("(?i)license|copyright"), F.lit(False)).alias("flagged"))


@query("b13_flag_problematic", """SELECT entity, acctbal < -500 OR acctbal > 9500 AS is_problematic FROM entities WHERE grp <> 'BUILDING'""")
def _(b):
    e = b("entities").select(
        "entity", F.when(F.col("grp") == "BUILDING", "Mus musculus").otherwise("Homo sapiens (human)").alias("species"),
        F.when(F.col("acctbal") < -500, "Problematic cell line: Contaminated").when(F.col("acctbal") > 9500, "MISIDENTIFIED").when(F.col("acctbal") > 0, "fine").alias("comments"))
    return op.flag_problematic(op.filter_human(e, "species"), "comments").select("entity", "is_problematic")


@query("b14_enforce_reference", """SELECT entity, feature, CASE WHEN partner IN (SELECT feature FROM roles WHERE gene_class <> 'unknown') THEN partner END AS partner, reads
    FROM fusions WHERE feature IN (SELECT feature FROM roles WHERE gene_class <> 'unknown')""")
def _(b):
    known = b("roles").where("gene_class <> 'unknown'").select("feature")
    return op.enforce_reference(b("fusions").select("entity", "feature", "partner", "reads"), known)


@query("b15_explicit_bool", """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN true WHEN c_nationkey % 5 = 1 THEN false WHEN c_nationkey % 5 = 2 THEN true END AS flag FROM customer""")
def _(b):
    k = F.col("c_nationkey") % 5
    word = F.when(k == 0, " Yes ").when(k == 1, "n").when(k == 2, "1").when(k == 3, "maybe")
    return b("customer").select("c_custkey", c.explicit_bool(word).alias("flag"))


@query("b16_finite", """SELECT c_custkey, CASE WHEN c_nationkey % 5 IN (0, 4) THEN c_acctbal END AS value FROM customer""")
def _(b):
    k = F.col("c_nationkey") % 5
    text = F.when(k == 0, F.col("c_acctbal").cast("string")).when(k == 1, "NaN").when(k == 2, "true").when(k == 3, "-Infinity").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string")))
    return b("customer").select("c_custkey", c.finite(text).alias("value"))


@query("b17_flatten_records", """SELECT 'ST' || CAST(l_returnflag AS STRING) AS study_id, CAST(l_orderkey AS STRING) AS sample_id, CAST(NULL AS STRING) AS patient_id, p_brand AS symbol, l_partkey AS entrez_gene_id,
    l_extendedprice AS value, 'rna' AS molecular_profile_id, 'rna' AS layer FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(b):
    li = b("lineitem").join(b("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    records = li.select(F.to_json(F.struct(
        F.concat(F.lit("ST"), "l_returnflag").alias("studyId"), F.col("l_orderkey").cast("string").alias("sampleId"), F.struct(F.col("p_brand").alias("hugoGeneSymbol")).alias("gene"),
        F.col("l_partkey").alias("entrezGeneId"), F.col("l_extendedprice").alias("value"), F.lit("rna").alias("molecularProfileId"))).alias("record"))
    return op.flatten_records(records, "record", "numeric", layer="rna")


@query("b17_flatten_samples", "SELECT CAST(o_orderkey AS STRING) AS sample_id, CAST(o_custkey AS STRING) AS patient_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS sample_type, CAST(NULL AS STRING) AS sample_type_id, 'ST1' AS study_id FROM orders")
def _(b):
    kind = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    records = b("orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("sampleId"), F.col("o_custkey").cast("string").alias("patientId"), kind.alias("sampleType"))).alias("record"))
    return op.flatten_records(records, "record", "sample", study_id="ST1")


@query("b17_flatten_mutations", """SELECT 'ST' || l_returnflag AS study_id, CAST(l_orderkey AS STRING) AS sample_id, p_brand AS symbol, l_partkey AS entrez_gene_id, l_shipdate_text AS mutation_type, CAST(l_suppkey AS STRING) AS chromosome, l_linenumber AS start_position, l_linenumber + 3 AS end_position, CAST(l_quantity AS BIGINT) AS tumor_alt_count
    FROM (SELECT *, CAST(year(l_shipdate) AS STRING) AS l_shipdate_text FROM lineitem) l JOIN part ON l_partkey = p_partkey""")
def _(b):
    li = b("lineitem").join(b("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    records = li.select(F.to_json(F.struct(
        F.concat(F.lit("ST"), "l_returnflag").alias("studyId"), F.col("l_orderkey").cast("string").alias("sampleId"), F.struct(F.col("p_brand").alias("hugoGeneSymbol")).alias("gene"), F.col("l_partkey").alias("entrezGeneId"),
        F.year("l_shipdate").cast("string").alias("mutationType"), F.col("l_suppkey").cast("string").alias("chromosome"), F.col("l_linenumber").alias("startPosition"), (F.col("l_linenumber") + 3).alias("endPosition"),
        F.col("l_quantity").cast("bigint").alias("tumorAltCount"))).alias("record"))
    return op.flatten_records(records, "record", "mutation").select("study_id", "sample_id", "symbol", "entrez_gene_id", "mutation_type", "chromosome", "start_position", "end_position", "tumor_alt_count")


@query("b17_flatten_variants", """SELECT CAST(entity AS STRING) AS sample_id, feature AS site1_hugo_symbol, partner AS site2_hugo_symbol, CASE WHEN in_frame THEN 'In_frame' END AS site2_effect_on_frame, CAST(NULL AS STRING) AS sv_status FROM fusions""")
def _(b):
    records = b("fusions").select(F.to_json(F.struct(
        F.col("entity").cast("string").alias("sampleId"), F.col("feature").alias("site1HugoSymbol"), F.col("partner").alias("site2HugoSymbol"), F.when(F.col("in_frame"), "In_frame").alias("site2EffectOnFrame"))).alias("record"))
    return op.flatten_records(records, "record", "structural_variant").select("sample_id", "site1_hugo_symbol", "site2_hugo_symbol", "site2_effect_on_frame", "sv_status")


def profiles(b):
    kinds = b("part").select((F.col("p_size") % 25).alias("n_nationkey"), "p_type").distinct()
    rows = b("nation").join(kinds, "n_nationkey")
    t = F.col("p_type")
    return rows.select(
        F.col("n_name").alias("study"),
        F.when(t == "ECONOMY", "MUTATION_EXTENDED").when(t == "STANDARD", "COPY_NUMBER_ALTERATION").otherwise("MRNA_EXPRESSION").alias("alteration_type"),
        F.when(t == "STANDARD", "DISCRETE").otherwise("CONTINUOUS").alias("datatype"),
        F.concat(F.lit("rsem "), t).alias("name"),
        F.concat("n_name", F.lit("_"), F.lower(t), F.when(t < "N", "_zscores").otherwise("")).alias("profile_id"))


@query("b18_choose_profile", """
    WITH r AS (SELECT DISTINCT n_name AS study, p_type AS t, CASE p_type WHEN 'ECONOMY' THEN 'mutation' WHEN 'STANDARD' THEN 'cna' ELSE 'rna' END AS layer,
        n_name || '_' || lower(p_type) || CASE WHEN p_type < 'N' THEN '_zscores' ELSE '' END AS profile_id FROM nation JOIN part ON p_size % 25 = n_nationkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY study, layer ORDER BY CASE WHEN t < 'N' THEN 1 ELSE 0 END, profile_id) AS rn FROM r)
    SELECT study, layer, profile_id FROM k WHERE rn = 1""")
def _(b):
    return op.choose_profile(profiles(b))


@query("b18_choose_list", """SELECT n_name AS study, coalesce(min(CASE WHEN p_type = 'PROMO' THEN n_name || '_promo' END),
      min(CASE WHEN p_type = 'ECONOMY' THEN n_name || '_economy' END)) AS list_id FROM nation JOIN part ON p_size % 25 = n_nationkey GROUP BY n_name""")
def _(b):
    kinds = b("part").select((F.col("p_size") % 25).alias("n_nationkey"), "p_type").distinct()
    lists = b("nation").join(kinds, "n_nationkey").select(F.col("n_name").alias("study"), F.col("p_type").alias("category"), F.concat("n_name", F.lit("_"), F.lower("p_type")).alias("list_id"))
    return op.choose_list(lists, "PROMO", "_economy")

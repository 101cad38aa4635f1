"""Registered queries for scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.plans.registry import query
from panelgrid.sources import sinks, tables

PANEL = ["F02", "F07", "F11"]
STATE_LAYERS = ["expression_rna", "expression_rna_hpa", "expression_rna_geo", "protein", "dependency", "copy_number", "mutations", "fusions"]
STATES = [f"{layer}_state" for layer in STATE_LAYERS]


@query("a1_scan_delimited", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(b):
    path = sinks.scratch_path(b.spark, "tsv")
    rows = b("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows.write.option("sep", "\t").option("header", False).option("compression", "gzip").csv(path)
    return tables.scan_delimited(b.spark, path, rows.schema, sep="\t", header=False)


@query("a1_scan_skip_lines", "SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS region_key FROM nation")
def _(b):
    path = sinks.scratch_path(b.spark, "gct")
    lines = b("nation").coalesce(1).select(F.concat_ws(" ", "n_nationkey", "n_name", "n_regionkey").alias("line"), F.lit(1).alias("part"), F.col("n_nationkey").alias("at"))
    heads = b("region").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
        F.struct(F.lit("#1.2").alias("line"), F.lit(-3).alias("at")), F.struct(F.concat_ws(" ", F.lit("dims"), "n").alias("line"), F.lit(-2).alias("at")),
        F.struct(F.lit("nation_key name region_key").alias("line"), F.lit(-1).alias("at")))).alias("h")).select("h.line", F.lit(1).alias("part"), "h.at")
    heads.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    schema = T.StructType().add("nation_key", "integer").add("name", "string").add("region_key", "integer")
    return tables.scan_delimited(b.spark, path, schema, sep=" ", header=True, skip=2)


@query("a2_write_table", "SELECT feature, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM expression_rna GROUP BY feature")
def _(b):
    stored = sinks.write_table(b("expression_rna"), sinks.scratch_path(b.spark, "rna"))
    return stored.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity").alias("n_entities"))


@query("a3_read_features", "SELECT entity, feature, value FROM expression_rna WHERE feature IN ('F02','F07','F11')")
def _(b):
    return tables.read_features(b("expression_rna"), PANEL)


@query("a3_read_features_table", """SELECT x.entity, x.feature, x.value FROM expression_rna x
    WHERE x.feature IN (SELECT feature FROM roles WHERE gene_class = 'oncogene')""")
def _(b):
    return tables.read_features(b("expression_rna"), b("roles").where("gene_class = 'oncogene'"))


@query("a4_read_measurements", """SELECT d.entity, d.feature, d.value FROM dependency d JOIN entities e ON d.entity = e.entity
    WHERE e.grp = 'BUILDING' AND d.feature IN ('F02','F07','F11')""")
def _(b):
    return tables.read_measurements(b("dependency"), b("entities").where("grp = 'BUILDING'"), PANEL)


@query("a5_read_pair_events", """SELECT f.entity, f.feature, f.partner, f.reads FROM fusions f JOIN entities e ON f.entity = e.entity
    WHERE e.grp = 'BUILDING' AND (f.feature IN ('F02','F07') OR f.partner IN ('F02','F07'))""")
def _(b):
    return tables.read_pair_events(b("fusions"), b("entities").where("grp = 'BUILDING'"), PANEL[:2]).select("entity", "feature", "partner", "reads")


@query("a6_distinct_column", "SELECT DISTINCT partner FROM fusions WHERE partner IS NOT NULL")
def _(b):
    return tables.distinct_column(b("fusions"), "partner")


@query("a7_describe_tables", """
    SELECT t.*, CASE t.table_name WHEN 'customer' THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM labels) END AS n_rows FROM (VALUES
      ('customer','c_custkey','c_custkey','bigint','key'), ('customer','c_custkey','c_name','string','value'), ('customer','c_custkey','c_nationkey','int','value'),
      ('customer','c_custkey','c_acctbal','double','value'), ('customer','c_custkey','c_mktsegment','string','value'),
      ('labels','doc_id','doc_id','bigint','key'), ('labels','doc_id','quality','int','value'), ('labels','doc_id','toxic','int','value')
    ) t(table_name, grain, column_name, dtype, column_role)""")
def _(b):
    return tables.describe_tables({"customer": b("customer"), "labels": b("labels")}, {"customer": ["c_custkey"], "labels": ["doc_id"]})


@query("a8_preview", "SELECT entity, feature, value FROM expression_rna ORDER BY entity, feature LIMIT 50 OFFSET 100")
def _(b):
    return tables.preview(b("expression_rna"), ["entity", "feature"], 50, 100)


@query("a9_availability", """SELECT e.entity, coalesce(t.yes, false) AS available FROM entities e
    LEFT JOIN (SELECT DISTINCT entity, true AS yes FROM treatments) t ON e.entity = t.entity""")
def _(b):
    return tables.availability(b("entities"), b("treatments"))


_A10 = " UNION ALL ".join(
    [f"SELECT 'rows' AS section, '{t}' AS item, '' AS detail, count(*) AS n FROM {t}" for t in ("expression_rna", "fusions")]
    + [f"SELECT 'repeated_keys' AS section, '{t}' AS item, '' AS detail, CAST(coalesce(sum(CASE WHEN k > 1 THEN k - 1 END), 0) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM {t} GROUP BY {g}) q"
       for t, g in (("expression_rna", "entity, feature"), ("fusions", "entity, feature, partner"))]
    + ["SELECT 'states' AS section, layer || '_state' AS item, state AS detail, count(*) AS n FROM coverage_long GROUP BY layer, state"])


@query("a10_build_manifest", _A10)
def _(b):
    return tables.build_manifest(
        {"expression_rna": b("expression_rna"), "fusions": b("fusions")},
        {"expression_rna": ["entity", "feature"], "fusions": ["entity", "feature", "partner"]}, b("coverage"), STATES)


_A11 = "SELECT entity, name, CASE WHEN acctbal < 0 THEN 'NaN' END AS odd FROM entities"


@query("a11_export_json", """SELECT '{"name":"' || name || '","score":' || CASE WHEN acctbal < 0 THEN 'null' ELSE CAST(entity AS STRING) || '.0' END || '}' AS json
    FROM entities""")
def _(b):
    rows = b("entities").select("name", F.when(F.col("acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("entity").cast("double")).alias("score"))
    return sinks.export_json(rows)


@query("a11_export_csv", """SELECT CAST(entity AS STRING) AS entity, CASE WHEN acctbal < 0 THEN '''=' || grp ELSE grp END AS label,
    '["' || name || '"]' AS cells, CASE WHEN is_problematic THEN 'true' ELSE 'false' END AS is_problematic, CASE WHEN acctbal < 100 THEN '' ELSE subgroup END AS maybe FROM entities""")
def _(b):
    e = b("entities")
    return sinks.export_csv(e.select(
        "entity", F.when(F.col("acctbal") < 0, F.concat(F.lit("="), "grp")).otherwise(F.col("grp")).alias("label"), F.array("name").alias("cells"),
        "is_problematic", F.when(F.col("acctbal") >= 100, F.col("subgroup")).alias("maybe")))


@query("a12_snapshot", """SELECT true AS same_id, false AS other_content_same_id, true AS first_written, false AS second_written, count(*) AS n_loaded FROM expression_rna""")
def _(b):
    rna = b("expression_rna")
    root = sinks.scratch_path(b.spark, "snapshots")
    first, wrote = sinks.save_snapshot(rna, root, {"kind": "rna", "built_at": "monday"}, ("built_at",))
    second, rewrote = sinks.save_snapshot(rna.orderBy("value"), root, {"kind": "rna", "built_at": "tuesday"}, ("built_at",))
    other = sinks.content_id(rna.where("entity > 1"), {"kind": "rna"}, ("built_at",))
    return sinks.load_snapshot(b.spark, root, first).agg(F.count(F.lit(1)).alias("n_loaded")).select(
        F.lit(first == second).alias("same_id"), F.lit(first == other).alias("other_content_same_id"),
        F.lit(wrote).alias("first_written"), F.lit(rewrote).alias("second_written"), "n_loaded")

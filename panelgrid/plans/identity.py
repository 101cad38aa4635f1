"""Registered queries for identity resolution, bridges and key rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import identity as op
from panelgrid.plans.registry import query, rd

REF = "(SELECT feature, symbol FROM features)"


def tokens(b):
    """Ids, symbols and unknown words taken from the part names and brands."""
    return b("part").select(F.explode(F.array(F.col("p_brand"), F.concat(F.lit("F"), F.lpad(F.substr("p_brand", F.lit(7)), 2, "0")), F.col("p_type"))).alias("token")).distinct()


TOK = """(SELECT DISTINCT token FROM (SELECT p_brand AS token FROM part UNION ALL SELECT 'F' || lpad(substr(p_brand, 7), 2, '0') FROM part UNION ALL SELECT p_type FROM part) q)"""


@query("c1_resolve", f"""
    WITH t AS {TOK}, i AS (SELECT feature AS token, count(*) AS n FROM features GROUP BY feature),
         s AS (SELECT symbol AS token, count(*) AS n, min(feature) AS f FROM features GROUP BY symbol)
    SELECT t.token, CASE WHEN i.n = 1 THEN t.token WHEN s.n = 1 THEN s.f END AS feature,
      CASE WHEN i.n = 1 OR s.n = 1 THEN 'resolved' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
    FROM t LEFT JOIN i ON t.token = i.token LEFT JOIN s ON t.token = s.token""")
def _(b):
    return op.resolve(tokens(b), b("features").select("feature", "symbol"))


@query("c2_resolve_candidates", f"""
    WITH t AS {TOK}, m AS (SELECT t.token, f.feature FROM t JOIN features f ON t.token = f.feature OR t.token = f.symbol)
    SELECT t.token, count(DISTINCT m.feature) AS n_candidates, CASE WHEN count(DISTINCT m.feature) = 1 THEN min(m.feature) END AS feature,
      CASE WHEN count(DISTINCT m.feature) = 1 THEN 'observed' ELSE 'unresolvable' END AS state,
      coalesce(string_agg(DISTINCT m.feature, '|' ORDER BY m.feature), '') AS candidates
    FROM t LEFT JOIN m ON t.token = m.token GROUP BY t.token""")
def _(b):
    return op.resolve_candidates(tokens(b), b("features").select("feature", "symbol"))


def alias_source(b):
    names = b("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_name")), "|").alias("alias_symbols"), F.min("p_partkey").alias("entrez_id"))
    return b("features").where("feature < 'X'").join(names, F.col("symbol") == F.col("p_brand")).select("feature", "symbol", "alias_symbols", "entrez_id")


ALIAS = """a AS (SELECT 'F' || lpad(substr(p_brand, 7), 2, '0') AS feature, p_brand AS symbol, min(p_partkey) AS entrez FROM part GROUP BY p_brand),
    x AS (SELECT feature AS identifier, 'feature_id' AS identifier_type, symbol AS canonical_symbol FROM a
      UNION ALL SELECT symbol, 'canonical_symbol', symbol FROM a UNION ALL SELECT CAST(entrez AS STRING), 'entrez_id', symbol FROM a
      UNION ALL SELECT DISTINCT p_name, 'alias_symbol', p_brand FROM part),
    al AS (SELECT upper(identifier) AS identifier_normalized, canonical_symbol, identifier_type, min(identifier) AS identifier FROM x GROUP BY 1, 2, 3)"""


def aliases(b):
    return op.build_aliases(alias_source(b), {"symbol": "canonical_symbol", "feature": "feature_id", "entrez_id": "entrez_id"}, {"alias_symbols": "alias_symbol"})


@query("c3_resolve_alias", f"""WITH {ALIAS}, t AS (SELECT DISTINCT p_name AS token FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT CAST(p_partkey AS STRING) FROM part),
    k AS (SELECT identifier_normalized AS key, count(DISTINCT canonical_symbol) AS n, min(canonical_symbol) AS one, string_agg(DISTINCT canonical_symbol, ', ' ORDER BY canonical_symbol) AS names FROM al GROUP BY 1)
    SELECT t.token, CASE WHEN a.symbol IS NOT NULL THEN a.symbol WHEN k.n = 1 THEN k.one END AS symbol,
      CASE WHEN a.symbol IS NOT NULL THEN 'canonical' WHEN k.n = 1 THEN 'alias' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
      CASE WHEN a.symbol IS NULL AND k.n > 1 THEN k.names END AS candidates
    FROM t LEFT JOIN a ON upper(a.symbol) = upper(t.token) LEFT JOIN k ON k.key = upper(t.token)""")
def _(b):
    p = b("part")
    toks = p.select(F.explode(F.array("p_name", "p_brand", F.col("p_partkey").cast("string"))).alias("token")).distinct()
    return op.resolve_alias(toks, alias_source(b), aliases(b))


@query("c4_build_aliases", f"WITH {ALIAS} SELECT * FROM al")
def _(b):
    return aliases(b)


SECOND = "SELECT DISTINCT 'F' || lpad(CAST(1 + s_suppkey % 40 AS STRING), 2, '0') AS feature, 'Supp#' || CAST(s_suppkey % 40 AS STRING) AS symbol FROM supplier"


def second(b):
    k = F.col("s_suppkey") % 40
    return b("supplier").select(F.concat(F.lit("F"), F.lpad((k + 1).cast("string"), 2, "0")).alias("feature"), F.concat(F.lit("Supp#"), k.cast("string")).alias("symbol")).distinct()


@query("c5_build_feature_reference", f"""WITH s AS ({SECOND}) SELECT feature, symbol FROM features
    UNION ALL SELECT feature, min(symbol) AS symbol FROM s WHERE feature NOT IN (SELECT feature FROM features) GROUP BY feature""")
def _(b):
    return op.build_feature_reference(b("features"), second(b))


@query("c5_ambiguous_symbols", "SELECT symbol, count(DISTINCT feature) AS n_ids FROM features GROUP BY symbol HAVING count(DISTINCT feature) > 1")
def _(b):
    return op.ambiguous_symbols(b("features"))


def headers(b):
    return b("part").select(F.explode(F.array(F.concat("p_brand", F.lit(" (1)")), F.concat("p_type", F.lit(" (2)")))).alias("header")).distinct()


BRIDGE = """h AS (SELECT DISTINCT p_brand || ' (1)' AS header, p_brand AS symbol FROM part UNION SELECT DISTINCT p_type || ' (2)', p_type FROM part),
    i AS (SELECT symbol, count(DISTINCT feature) AS n, min(feature) AS f, string_agg(DISTINCT feature, '|' ORDER BY feature) AS fs FROM features GROUP BY symbol),
    br AS (SELECT h.header, h.symbol, CASE WHEN i.n = 1 THEN i.f END AS feature,
      CASE WHEN i.n = 1 THEN 'resolved' WHEN i.n IS NULL THEN 'no_match' ELSE 'collision' END AS status, CASE WHEN i.n > 1 THEN i.fs END AS candidates
    FROM h LEFT JOIN i ON h.symbol = i.symbol)"""


@query("c6_symbol_bridge", f"WITH {BRIDGE} SELECT * FROM br")
def _(b):
    return op.build_symbol_bridge(headers(b), b("features"))


@query("c7_unresolved_report", f"""WITH {BRIDGE} SELECT DISTINCT l.layer, f.feature FROM br JOIN features f ON f.symbol = br.symbol
    JOIN (VALUES ('protein'), ('dependency')) l(layer) ON true WHERE br.status = 'collision'""")
def _(b):
    bridge = op.build_symbol_bridge(headers(b), b("features"))
    return op.unresolved_report(bridge.withColumn("layer", F.explode(F.array(F.lit("protein"), F.lit("dependency")))))


C8 = """src AS (SELECT o_orderkey AS k, o_orderpriority AS accession, o_custkey FROM orders),
    tgt AS (SELECT DISTINCT p.p_brand AS accession, o.o_custkey AS entity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
    s AS (SELECT p_partkey AS sample, p_brand AS accession FROM part), kn AS (SELECT DISTINCT p_brand AS accession FROM part WHERE p_size > 20 AND p_brand <> 'Brand#7'),
    br AS (SELECT s.sample, min(t.entity) AS entity FROM s JOIN kn ON s.accession = kn.accession JOIN tgt t ON t.accession = s.accession GROUP BY s.sample)"""


def two_hop(b):
    li = b("li").select(F.concat(F.lit("Brand#"), F.substr("feature", F.lit(2)).cast("int").cast("string")).alias("accession"), "entity").distinct()
    src = b("part").select(F.col("p_partkey").alias("sample"), F.col("p_brand").alias("accession"))
    known = b("part").where("p_size > 20 and p_brand <> 'Brand#7'").select(F.col("p_brand").alias("accession"))
    firsts = li.groupBy("accession").agg(F.min("entity").alias("entity"))
    return src, op.bridge_two_hop(src, known, firsts, "sample", "accession")


@query("c8_bridge_two_hop", f"WITH {C8} SELECT sample, entity FROM br")
def _(b):
    return two_hop(b)[1]


@query("c8_bridge_survival", f"WITH {C8} SELECT (SELECT count(*) FROM s) AS n_in, (SELECT count(*) FROM br) AS n_out, round(100.0E0 * (SELECT count(*) FROM br) / (SELECT count(*) FROM s), 1) AS survival_pct")
def _(b):
    src, bridge = two_hop(b)
    return op.survival(src, bridge, "sample")


@query("c9_fanout_check", """WITH j AS (SELECT count(*) AS n FROM events e JOIN (SELECT o_custkey AS k FROM orders) o ON e.user_id = o.k),
    m AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) q)
    SELECT j.n AS n_joined, (SELECT count(*) FROM events) * m.m AS bound, j.n <= (SELECT count(*) FROM events) * m.m AS within FROM j, m""")
def _(b):
    return op.fanout_check(b("events").select(F.col("user_id").alias("k")), b("orders").select(F.col("o_custkey").alias("k")), "k")


@query("c10_validated_join", "SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def _(b):
    left = b("orders").select("o_orderkey", "o_custkey")
    right = b("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return op.validated_join(left, right, ["o_custkey"], "inner", "m:1")


@query("c11_map_samples", "SELECT o.o_custkey AS entity, l.l_quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus IN ('F', 'P')")
def _(b):
    bridge = b("orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("datatype"))
    return op.map_samples(b("lineitem").select(F.col("l_orderkey").alias("sample"), "l_quantity"), bridge, ["F", "P"])


@query("c12_build_spine", """SELECT entity, grp, name AS cell_name, CAST(NULL AS BOOLEAN) AS is_problematic FROM entities WHERE acctbal < 3000 AND entity IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT entity, grp, CAST(NULL AS STRING) AS cell_name, is_problematic FROM entities WHERE acctbal >= 3000""")
def _(b):
    e = b("entities")
    primary = e.where("acctbal >= 3000").select("entity", "grp", "is_problematic")
    backup = e.select("entity", "grp", F.col("name").alias("CellName"))
    return op.build_spine(primary, backup, b("orders").select(F.col("o_custkey").alias("entity")), {"CellName": "cell_name"})


@query("c13_coalesce_id", """SELECT coalesce(CASE WHEN o.o_orderstatus = 'F' THEN o.o_custkey END, CASE WHEN c.c_acctbal > 0 THEN c.c_custkey END) AS entity, o.o_orderkey
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' OR c.c_acctbal > 0""")
def _(b):
    rows = b("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("own"), F.format_string("Customer#%09d", "o_custkey").alias("name"))
    bridge = b("customer").where("c_acctbal > 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("entity"))
    return op.coalesce_id(rows, bridge, "own", "name").select("entity", "o_orderkey")


@query("c14_dedupe_first", """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_quantity) AS rn FROM lineitem) q WHERE rn = 1""")
def _(b):
    return op.dedupe_first(b("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("c15_dedupe_mean", f"SELECT l_orderkey, l_linenumber, {rd('avg(l_extendedprice)', 6)} AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def _(b):
    out = op.dedupe_mean(b("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("c16_dedupe_median", f"SELECT entity, feature, {rd('quantile_cont(l_extendedprice, 0.5)', 6)} AS l_extendedprice FROM li GROUP BY 1, 2")
def _(b):
    return op.dedupe_median(b("li"), ["entity", "feature"], "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 6))


# Rows of part with an odd size are the first source, all others the second. The brand's number n decides whether its votes agree.
C17 = """n AS (SELECT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) AS n, p_type, p_size FROM part),
    f AS (SELECT DISTINCT symbol, CASE WHEN n % 2 = 0 THEN 'Oncogene' ELSE 'TSG' END AS cls FROM n WHERE p_size % 2 = 1),
    s AS (SELECT symbol, CASE WHEN n % 4 = 0 OR (n % 4 = 1 AND p_type <> 'PROMO') THEN 'official' ELSE 'rescued' END AS decision, CASE WHEN p_type = 'PROMO' THEN 'PANCAN' ELSE p_type END AS cancer,
      CASE WHEN p_type = 'PROMO' AND n % 4 = 3 THEN CASE WHEN p_size % 4 = 0 THEN 'tsg' ELSE 'oncogene' END WHEN p_type = 'PROMO' THEN CASE WHEN n % 5 < 2 THEN 'oncogene' ELSE 'tsg' END
        WHEN n % 3 = 0 OR p_type = 'LARGE' THEN 'possible oncogene' WHEN p_type = 'SMALL' THEN 'tsg' WHEN p_type = 'MEDIUM' THEN 'oncogene' ELSE 'other' END AS func FROM n WHERE p_size % 2 = 0),
    m AS (SELECT *, CASE WHEN func = 'tsg' THEN 'tumour_suppressor' WHEN func LIKE '%oncogene' THEN 'oncogene' END AS c FROM s),
    pool AS (SELECT m.* FROM m JOIN (SELECT symbol, bool_or(decision = 'official') AS ho FROM m GROUP BY symbol) h ON m.symbol = h.symbol WHERE NOT h.ho OR m.decision = 'official'),
    v AS (SELECT symbol, CASE WHEN count(DISTINCT CASE WHEN cancer = 'PANCAN' THEN c END) = 1 THEN min(CASE WHEN cancer = 'PANCAN' THEN c END)
      WHEN count(DISTINCT c) = 1 THEN min(c) END AS c2 FROM pool GROUP BY symbol)"""


@query("c17_consensus_role", f"""WITH {C17} SELECT u.feature, coalesce(v.c2, CASE f.cls WHEN 'Oncogene' THEN 'oncogene' WHEN 'TSG' THEN 'tumour_suppressor' END) AS gene_class
    FROM f FULL JOIN v ON f.symbol = v.symbol JOIN (SELECT symbol, min(feature) AS feature FROM features GROUP BY symbol HAVING count(DISTINCT feature) = 1) u ON u.symbol = coalesce(f.symbol, v.symbol)
    WHERE coalesce(v.c2, f.cls) IS NOT NULL""")
def _(b):
    p = b("part").select(F.col("p_brand").alias("symbol"), F.substr("p_brand", F.lit(7)).cast("int").alias("n"), "p_type", "p_size")
    first = p.where("p_size % 2 = 1").select("symbol", F.when(F.col("n") % 2 == 0, "Oncogene").otherwise("TSG").alias("classification"))
    n, t = F.col("n"), F.col("p_type")
    pan = F.when(n % 4 == 3, F.when(F.col("p_size") % 4 == 0, "tsg").otherwise("oncogene")).otherwise(F.when(n % 5 < 2, "oncogene").otherwise("tsg"))
    second_src = p.where("p_size % 2 = 0").select(
        "symbol", F.when((n % 4 == 0) | ((n % 4 == 1) & (t != "PROMO")), "official").otherwise("rescued").alias("decision"),
        F.when(t == "PROMO", "PANCAN").otherwise(t).alias("cancer"),
        F.when(t == "PROMO", pan).when((n % 3 == 0) | (t == "LARGE"), "possible oncogene").when(t == "SMALL", "tsg").when(t == "MEDIUM", "oncogene").otherwise("other").alias("function"))
    return op.consensus_role(first, second_src, b("features"))


@query("c18_feature_master", """
    WITH n AS (SELECT p_brand AS symbol, 'F' || lpad(substr(p_brand, 7), 2, '0') AS feature, CAST(substr(p_brand, 7) AS INT) % 4 AS k, p_type, p_size FROM part),
    hd AS (SELECT DISTINCT symbol, feature, symbol || ' (' || p_type || p_size || ')' AS c, CASE WHEN k = 0 OR (k = 1 AND p_size % 2 = 0) OR (k = 2 AND p_size % 3 = 0) THEN 'expression'
      WHEN k = 1 OR (k = 2 AND p_size % 3 = 1) OR (k = 3 AND p_size % 2 = 0) THEN 'effect' ELSE 'copy_number' END AS layer FROM n),
    e AS (SELECT feature, min(c) AS c FROM hd WHERE layer = 'expression' GROUP BY feature),
    d AS (SELECT upper(symbol) AS symbol, min(c) AS c FROM hd WHERE layer = 'effect' GROUP BY upper(symbol)),
    k AS (SELECT feature, min(c) AS c FROM hd WHERE layer = 'copy_number' GROUP BY feature)
    SELECT f.feature, f.symbol, e.c AS expression_column, d.c AS effect_column, k.c AS copy_number_column,
      CASE WHEN e.c IS NULL THEN 0 ELSE 1 END AS has_expression, CASE WHEN d.c IS NULL THEN 0 ELSE 1 END AS has_effect, CASE WHEN k.c IS NULL THEN 0 ELSE 1 END AS has_copy_number,
      CASE WHEN f.feature IN (SELECT feature FROM mutations) THEN 1 ELSE 0 END AS has_mutation, CASE WHEN f.feature IN (SELECT feature FROM mutations WHERE is_driver AND is_hotspot AND l_linenumber = 7) THEN 1 ELSE 0 END AS has_broad,
      CASE WHEN d.c IS NOT NULL AND (e.c IS NOT NULL OR k.c IS NOT NULL) THEN 1 ELSE 0 END AS eligible_core
    FROM features f LEFT JOIN e ON e.feature = f.feature LEFT JOIN d ON d.symbol = upper(f.symbol) LEFT JOIN k ON k.feature = f.feature""")
def _(b):
    number, k, size = F.substr("p_brand", F.lit(7)), F.substr("p_brand", F.lit(7)).cast("int") % 4, F.col("p_size")
    layer = (F.when((k == 0) | ((k == 1) & (size % 2 == 0)) | ((k == 2) & (size % 3 == 0)), "expression")
             .when((k == 1) | ((k == 2) & (size % 3 == 1)) | ((k == 3) & (size % 2 == 0)), "effect").otherwise("copy_number"))
    hd = b("part").select(
        F.col("p_brand").alias("symbol"), F.concat(F.lit("F"), F.lpad(number, 2, "0")).alias("feature"),
        F.concat("p_brand", F.lit(" ("), "p_type", "p_size", F.lit(")")).alias("column_name"), layer.alias("layer")).distinct()
    none = F.lit(None).cast("string")
    nosym = F.lit("none")
    heads = {
        "expression": hd.where("layer = 'expression'").select("column_name", nosym.alias("symbol"), "feature"),
        "effect": hd.where("layer = 'effect'").select("column_name", "symbol", none.alias("feature")),
        "copy_number": hd.where("layer = 'copy_number'").select("column_name", nosym.alias("symbol"), "feature"),
    }
    m = b("mutations")
    return op.build_feature_master(b("features").select("feature", "symbol"), heads, {"mutation": m}, m.where("is_driver and is_hotspot and l_linenumber = 7"))


@query("c19_id_algebra", """
    WITH t AS (SELECT DISTINCT entity, 'mutation' AS layer FROM mutations UNION ALL SELECT DISTINCT entity, 'fusion' FROM fusions UNION ALL SELECT DISTINCT entity, 'treatment' FROM treatments),
    p AS (SELECT entity, count(*) AS k, min(layer) AS o FROM t GROUP BY entity)
    SELECT 'union' AS item, count(*) AS n FROM p UNION ALL SELECT 'intersection', count(CASE WHEN k = 3 THEN 1 END) FROM p UNION ALL SELECT 'only:' || o, count(*) FROM p WHERE k = 1 GROUP BY o""")
def _(b):
    return op.id_algebra({"mutation": b("mutations"), "fusion": b("fusions"), "treatment": b("treatments")})


@query("c19_unknown_ids", """SELECT 'mutation' AS layer, count(DISTINCT entity) AS n_unknown FROM mutations WHERE entity NOT IN (SELECT entity FROM entities WHERE acctbal > 0)
    UNION ALL SELECT 'fusion', count(DISTINCT entity) FROM fusions WHERE entity NOT IN (SELECT entity FROM entities WHERE acctbal > 0)""")
def _(b):
    return op.unknown_ids({"mutation": b("mutations"), "fusion": b("fusions")}, b("entities").where("acctbal > 0"))


@query("c20_id_collisions", """SELECT 'nationkey' AS id_column, CAST(nationkey AS STRING) AS id_value, count(DISTINCT entity) AS n_entities FROM entities GROUP BY nationkey HAVING count(DISTINCT entity) > 1
    UNION ALL SELECT 'name', name, count(DISTINCT entity) FROM entities GROUP BY name HAVING count(DISTINCT entity) > 1""")
def _(b):
    return op.id_collisions(b("entities"), ["nationkey", "name"])


@query("c21_label_crosstab", "SELECT *, count(*) OVER (PARTITION BY grp) AS n_labels FROM (SELECT grp, subgroup, count(*) AS n FROM entities GROUP BY grp, subgroup) q")
def _(b):
    return op.label_crosstab(b("entities"), "grp", "subgroup")


@query("c22_search_features", """SELECT feature, symbol, CASE WHEN contains(lower(symbol), 'f23') THEN 0 ELSE 1 END AS hit FROM features
    WHERE contains(lower(symbol), 'f23') OR contains(lower(feature), 'f23') ORDER BY hit, symbol, feature LIMIT 5""")
def _(b):
    return op.search_features(b("features").select("feature", "symbol"), "F23", 5)


@query("c23_facets", "SELECT DISTINCT grp, subgroup FROM entities WHERE grp = 'BUILDING'")
def _(b):
    return op.facets(b("entities"), "BUILDING")

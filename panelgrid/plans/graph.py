"""Registered queries for the evidence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import graph as op
from panelgrid.plans.registry import query, rd

MEM = """mem AS (SELECT DISTINCT feature, pathway FROM memberships WHERE species = 'HUMAN' AND pathway LIKE 'PW-%'),
    hie AS (SELECT DISTINCT 'PW-' || split_part(pathway, '-', 2) || '-0' AS parent, pathway AS child FROM memberships WHERE pathway NOT LIKE '%-0'),
    par AS (SELECT DISTINCT parent, child FROM hie WHERE parent IN (SELECT pathway FROM mem) AND child IN (SELECT pathway FROM mem))"""
ASC = """asc_ AS (SELECT least('F' || substr(protein1, 2), 'F' || substr(protein2, 2)) AS low, greatest('F' || substr(protein1, 2), 'F' || substr(protein2, 2)) AS high, max(combined_score) AS combined_score FROM association_pairs
      WHERE combined_score >= (SELECT CAST(floor(avg(combined_score)) AS BIGINT) FROM association_pairs) GROUP BY 1, 2)"""
INT = "int_ AS (SELECT least(feature_a, feature_b) AS low, greatest(feature_a, feature_b) AS high, string_agg(DISTINCT system, '|' ORDER BY system) AS systems, count(*) AS n_records FROM interactions GROUP BY 1, 2)"
PAR = "prt AS (SELECT least(feature, partner) AS low, greatest(feature, partner) AS high, count(DISTINCT entity) AS n_entities, bool_or(confidence_high) AS any_confident, bool_or(in_frame) AS any_in_frame FROM fusions WHERE partner IS NOT NULL GROUP BY 1, 2)"
COD = f"""mom AS (SELECT feature, avg(effect) AS m, stddev_pop(effect) AS s FROM cells GROUP BY 1), zs AS (SELECT c.entity, c.feature, (c.effect - m) / s AS z FROM cells c JOIN mom ON mom.feature = c.feature),
    prod AS (SELECT x.feature AS low, y.feature AS high, count(*) AS n_shared, {rd('sum(x.z * y.z) / (count(*) - 1)')} AS score FROM zs x JOIN zs y ON x.entity = y.entity AND x.feature < y.feature GROUP BY 1, 2),
    two AS (SELECT low, high, score, n_shared, low AS focal, high AS other FROM prod WHERE abs(score) >= 0.03 AND n_shared >= 30 UNION ALL SELECT low, high, score, n_shared, high, low FROM prod WHERE abs(score) >= 0.03 AND n_shared >= 30),
    cod AS (SELECT DISTINCT low, high, score, n_shared FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY abs(score) DESC, other) AS r FROM two) q WHERE r <= 3)"""
NODES = """nod AS (SELECT 'feature:' || feature AS node_id, 'feature' AS node_type, 'feature_reference' AS source_db, min(symbol) AS display_name, feature AS feature_id, CAST(NULL AS VARCHAR) AS pathway_id, 'HUMAN' AS species FROM features GROUP BY feature
      UNION ALL SELECT DISTINCT 'pathway:' || pathway, 'pathway', 'pathways', pathway, NULL, pathway, 'HUMAN' FROM mem)"""
EDGES = f"""{MEM}, {ASC}, {INT}, {PAR}, {COD}, {NODES},
    edg AS (SELECT 'feature:' || feature AS source_node_id, 'pathway:' || pathway AS target_node_id, 'member_of' AS edge_type, 'pathways' AS source_db, CAST(NULL AS DOUBLE) AS weight, true AS directed, CAST(NULL AS VARCHAR) AS evidence_detail, CAST(NULL AS BIGINT) AS n_source_observations FROM mem
      UNION ALL SELECT 'pathway:' || child, 'pathway:' || parent, 'child_of', 'pathways', NULL, true, NULL, NULL FROM par
      UNION ALL SELECT 'feature:' || low, 'feature:' || high, 'association', 'associations', CAST(combined_score AS DOUBLE), false, NULL, NULL FROM asc_
      UNION ALL SELECT 'feature:' || low, 'feature:' || high, 'interaction', 'interactions', NULL, false, systems, n_records FROM int_
      UNION ALL SELECT 'feature:' || low, 'feature:' || high, 'event_partner', 'events', CAST(n_entities AS DOUBLE), false, NULL, n_entities FROM prt
      UNION ALL SELECT 'feature:' || low, 'feature:' || high, 'codependency', 'dependency', score, false, NULL, n_shared FROM cod)"""


def membership(b):
    m = b("memberships")
    kind = F.split_part("pathway", F.lit("-"), F.lit(2))
    hierarchy = m.where(~F.col("pathway").endswith("-0")).select(F.concat(F.lit("PW-"), kind, F.lit("-0")).alias("parent"), F.col("pathway").alias("child")).distinct()
    return op.load_membership(m, hierarchy, "HUMAN", "PW-")


def associations(b):
    links = b("association_pairs")
    cut = links.agg(F.floor(F.avg("combined_score")).cast("bigint")).scalar()
    names = links.select(F.col("protein1").alias("protein")).union(links.select("protein2")).distinct().select("protein", F.concat(F.lit("F"), F.substr("protein", F.lit(2))).alias("symbol"))
    return op.load_associations(links, names, cut)


def codependency(b):
    return op.association_topk(b("dependency"), k=3, min_abs=0.03, block=8)


def edges(b):
    """The edge table, built once like a curated table."""
    mem, par = membership(b)
    return b.kept("edges", lambda: op.build_edges(mem, par, associations(b), op.load_interactions(b("interactions")), op.partner_edges(b("fusions")), codependency(b)))


def nodes(b):
    return b.kept("nodes", lambda: op.build_nodes(b("features"), membership(b)[0], "HUMAN"))


@query("j1_load_membership", f"WITH {MEM} SELECT feature AS a, pathway AS b, 'member' AS kind FROM mem UNION ALL SELECT parent, child, 'hierarchy' FROM par")
def _(b):
    mem, par = membership(b)
    return mem.select(F.col("feature").alias("a"), F.col("pathway").alias("b"), F.lit("member").alias("kind")).unionByName(par.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit("hierarchy").alias("kind")))


@query("j2_load_associations", f"WITH {ASC} SELECT * FROM asc_")
def _(b):
    return associations(b)


@query("j3_load_interactions", f"WITH {INT} SELECT * FROM int_")
def _(b):
    return op.load_interactions(b("interactions"))


@query("j4_partner_edges", f"WITH {PAR} SELECT * FROM prt")
def _(b):
    return op.partner_edges(b("fusions"))


@query("j5_association_topk", f"WITH {COD} SELECT * FROM cod")
def _(b):
    return codependency(b)


@query("j6_build_nodes", f"WITH {MEM}, {NODES} SELECT * FROM nod")
def _(b):
    return nodes(b)


@query("j7_build_edges", f"WITH {EDGES} SELECT * FROM edg")
def _(b):
    return edges(b)


@query("j8_resolve_symbols", """SELECT t.symbol, CASE WHEN count(DISTINCT f.feature) = 1 THEN min(f.feature) END AS feature, CASE count(DISTINCT f.feature) WHEN 1 THEN 'resolved' WHEN 0 THEN 'unresolved' ELSE 'ambiguous' END AS status
    FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT p_type FROM part) t LEFT JOIN features f ON f.symbol = t.symbol GROUP BY t.symbol""")
def _(b):
    p = b("part")
    return op.resolve_symbols(p.select(F.explode(F.array("p_brand", "p_type")).alias("symbol")), b("features"))


HOOD = f"""{EDGES}, ways AS (SELECT * FROM (SELECT source_node_id AS f, target_node_id AS t, edge_type, source_db, weight FROM edg UNION ALL SELECT target_node_id, source_node_id, edge_type, source_db, weight FROM edg) q WHERE f <> t AND t IN (SELECT node_id FROM nod)),
    h1 AS (SELECT DISTINCT t AS node_id FROM ways WHERE f = 'pathway:PW-PROMO-3'), h2 AS (SELECT DISTINCT t AS node_id FROM ways WHERE f IN (SELECT node_id FROM h1) AND t <> 'pathway:PW-PROMO-3' AND t NOT IN (SELECT node_id FROM h1)),
    vis AS (SELECT 'pathway:PW-PROMO-3' AS node_id, 0 AS hop UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2),
    stp AS (SELECT w.t AS node_id, v.hop, w.f AS connected_to, w.edge_type, w.source_db, w.weight FROM ways w JOIN vis v ON v.node_id = w.t AND v.hop > 0 JOIN vis c ON c.node_id = w.f AND c.hop = v.hop - 1)"""


def steps(b):
    return op.neighbourhood(nodes(b), edges(b), "pathway:PW-PROMO-3", 2)


@query("j9_neighbourhood", f"WITH {HOOD} SELECT s.node_id, n.node_type, n.display_name, s.hop, s.connected_to, s.edge_type, s.source_db, s.weight FROM stp s JOIN nod n ON n.node_id = s.node_id")
def _(b):
    return steps(b)


@query("j10_cap_neighbours", f"""WITH {HOOD}, p AS (SELECT node_id, hop, max(weight) AS best_weight FROM stp GROUP BY 1, 2) SELECT *, (SELECT count(*) FROM p) AS total_found, (SELECT count(*) FROM p) > 12 AS truncated FROM p ORDER BY best_weight DESC NULLS LAST, node_id LIMIT 12""")
def _(b):
    return op.cap_neighbours(steps(b), 12)


@query("j11_shared_pathways", f"WITH {MEM} SELECT pathway FROM mem WHERE feature IN ('F03', 'F10', 'F21') GROUP BY pathway HAVING count(DISTINCT feature) = 3")
def _(b):
    return op.shared_pathways(membership(b)[0], ["F03", "F10", "F21"])


@query("j12_direct_edges", f"WITH {EDGES} SELECT edge_type, source_db, weight, evidence_detail, n_source_observations FROM edg WHERE least(source_node_id, target_node_id) = 'feature:F03' AND greatest(source_node_id, target_node_id) = 'feature:F10'")
def _(b):
    return op.direct_edges(edges(b), "feature:F10", "feature:F03")


@query("j13_feature_context", f"""WITH {EDGES}, a AS (SELECT focal, list, cap FROM (SELECT unnest(['feature:F03', 'feature:X99', 'feature:F77']) AS focal) x, (VALUES ('edges', 10), ('pathways', 5)) l(list, cap)),
    t AS (SELECT q.*, n.node_type, coalesce(n.feature_id, n.pathway_id) AS nid FROM (SELECT source_node_id AS focal, target_node_id AS other, edge_type, source_db, weight, evidence_detail FROM edg UNION ALL SELECT target_node_id, source_node_id, edge_type, source_db, weight, evidence_detail FROM edg) q JOIN nod n ON n.node_id = q.other WHERE focal IN (SELECT focal FROM a)),
    l AS (SELECT 'edges' AS list, * FROM t UNION ALL SELECT 'pathways', * FROM t WHERE node_type = 'pathway'),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY focal, list ORDER BY source_db, edge_type, nid, other, coalesce(evidence_detail, '')) AS INT) AS place, count(*) OVER (PARTITION BY focal, list) AS total FROM l)
    SELECT a.focal, a.list, CASE WHEN n.node_id IS NULL THEN 'not_in_graph' WHEN r.total IS NULL THEN 'none' ELSE 'ok' END AS state, coalesce(r.total, 0) AS total, coalesce(r.total > a.cap, false) AS truncated, r.place, r.source_db, r.edge_type, r.other, r.weight
    FROM a LEFT JOIN nod n ON n.node_id = a.focal LEFT JOIN r ON r.focal = a.focal AND r.list = a.list AND r.place <= a.cap""")
def _(b):
    return op.feature_context(nodes(b), edges(b), ["F03", "X99", "F77"])


PANEL = ["F03", "F10", "F21", "F07"]
ASKED = "pq AS (SELECT x.f AS a, y.f AS b FROM (SELECT unnest(['F03', 'F10', 'F21', 'F07']) AS f) x JOIN (SELECT unnest(['F03', 'F10', 'F21', 'F07']) AS f) y ON x.f < y.f)"


@query("j14_pairwise_shared", f"WITH {MEM}, {ASKED} SELECT pq.a, pq.b, count(m.pathway) AS n_shared, coalesce(string_agg(m.pathway, '|' ORDER BY m.pathway), '') AS pathways FROM pq LEFT JOIN (SELECT x.feature AS a, y.feature AS b, x.pathway FROM mem x JOIN mem y ON x.pathway = y.pathway) m ON m.a = pq.a AND m.b = pq.b GROUP BY 1, 2")
def _(b):
    return op.pairwise_shared(membership(b)[0], PANEL)


@query("j15_explain_pairs", f"""WITH {MEM}, {ASC}, {INT}, {ASKED}, sz AS (SELECT pathway, count(*) AS size FROM mem GROUP BY 1), sh AS (SELECT pq.a, pq.b, x.pathway, sz.size, row_number() OVER (PARTITION BY pq.a, pq.b ORDER BY sz.size, x.pathway) AS r FROM pq JOIN mem x ON x.feature = pq.a JOIN mem y ON y.feature = pq.b AND y.pathway = x.pathway JOIN sz ON sz.pathway = x.pathway),
    s2 AS (SELECT a, b, count(*) AS n, string_agg(CASE WHEN r <= 5 THEN pathway END, ' | ' ORDER BY r) AS names FROM sh GROUP BY 1, 2)
    SELECT pq.a AS low, pq.b AS high, CAST(coalesce(s2.n, 0) AS INT) AS n_shared, coalesce(s2.names, '') AS smallest_pathways, asc_.combined_score AS association, coalesce(int_.systems, '') AS systems, coalesce(int_.n_records, 0) AS n_records,
      CASE WHEN s2.n > 0 THEN 1 ELSE 0 END + CASE WHEN asc_.low IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN int_.low IS NOT NULL THEN 1 ELSE 0 END AS n_sources FROM pq LEFT JOIN s2 ON s2.a = pq.a AND s2.b = pq.b LEFT JOIN asc_ ON asc_.low = pq.a AND asc_.high = pq.b LEFT JOIN int_ ON int_.low = pq.a AND int_.high = pq.b""")
def _(b):
    ids = sorted(PANEL)
    return op.explain_pairs(membership(b)[0], associations(b), op.load_interactions(b("interactions")), [(x, y) for i, x in enumerate(ids) for y in ids[i + 1:]])


@query("j16_source_coverage", f"""WITH {MEM}, {ASC}, {INT}, s AS (SELECT 'membership' AS source, feature FROM mem UNION SELECT 'association', low FROM asc_ UNION SELECT 'association', high FROM asc_ UNION SELECT 'interaction', low FROM int_ UNION SELECT 'interaction', high FROM int_)
    SELECT n.source, count(s.feature) AS n_known, 5 AS n_panel, round(100.0::DOUBLE * count(s.feature) / 5, 6) AS pct FROM (SELECT unnest(['membership', 'association', 'interaction']) AS source) n LEFT JOIN s ON s.source = n.source AND s.feature IN ('F03', 'F10', 'F21', 'F07', 'F77') GROUP BY 1""")
def _(b):
    asc, inter = associations(b), op.load_interactions(b("interactions"))

    def ends(df):
        return df.select(F.explode(F.array("low", "high")).alias("feature"))

    return op.source_coverage({"membership": membership(b)[0], "association": ends(asc), "interaction": ends(inter)}, [*PANEL, "F77"])


@query("j17_audit_graph", f"""WITH {EDGES}, nn AS (SELECT * FROM nod WHERE node_id <> 'feature:F05'), dg AS (SELECT n, count(*) AS d FROM (SELECT source_node_id AS n FROM edg UNION ALL SELECT target_node_id FROM edg) q GROUP BY 1)
    SELECT 'repeated_nodes' AS check, '' AS item, (SELECT count(*) FROM (SELECT 1 FROM nn GROUP BY node_id HAVING count(*) > 1) q) AS n UNION ALL SELECT 'repeated_edges', '', (SELECT count(*) FROM (SELECT 1 FROM edg GROUP BY least(source_node_id, target_node_id), greatest(source_node_id, target_node_id), edge_type HAVING count(*) > 1) q)
    UNION ALL SELECT 'missing_endpoints', '', count(*) FROM dg WHERE n NOT IN (SELECT node_id FROM nn) UNION ALL SELECT 'edges', edge_type, count(*) FROM edg GROUP BY 2 UNION ALL SELECT 'nodes', node_type, count(*) FROM nn GROUP BY 2 UNION ALL SELECT 'max_degree', '', max(d) FROM dg""")
def _(b):
    return op.audit_graph(nodes(b).where("node_id <> 'feature:F05'"), edges(b))


@query("j18_memberships", f"WITH {MEM} SELECT a.f AS feature, CAST(count(DISTINCT m.pathway) AS INT) AS n, coalesce(string_agg(DISTINCT m.pathway, '|' ORDER BY m.pathway), '') AS pathways FROM (SELECT unnest(['F03', 'F77']) AS f) a LEFT JOIN mem m ON m.feature = a.f GROUP BY 1")
def _(b):
    return op.memberships_of(membership(b)[0], ["F03", "F77"])


@query("j19_compare_builds", f"""WITH {EDGES}, o AS (SELECT * FROM edg WHERE coalesce(weight, 1) > 0), k AS (SELECT source_node_id, target_node_id, edge_type, sum(o) AS o, sum(n) AS n FROM (SELECT source_node_id, target_node_id, edge_type, 1 AS o, 0 AS n FROM o UNION ALL SELECT source_node_id, target_node_id, edge_type, 0, 1 FROM edg) q GROUP BY 1, 2, 3)
    SELECT edge_type, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS only_old, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS only_new FROM k GROUP BY 1""")
def _(b):
    e = edges(b)
    return op.compare_builds(e.where("coalesce(weight, 1) > 0"), e, ["source_node_id", "target_node_id", "edge_type"])

"""Evidence graph: loads, node and edge tables, bounded neighbourhoods, explanations and audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.operators.identity import symbol_counts
from panelgrid.session import small_frame, stage
from panelgrid.sources.tables import union_all

DIGITS = 9


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}).drop(a, b)


def load_membership(memberships: DataFrame, hierarchy: DataFrame, species: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (feature, pathway) of one species and id prefix; hierarchy between kept pathways."""
    kept = memberships.where((F.col("species") == species) & F.col("pathway").startswith(prefix)).select("feature", "pathway").distinct()
    nodes = kept.select("pathway").distinct()
    parents = hierarchy.join(nodes.withColumnRenamed("pathway", "parent"), "parent", "left_semi").join(nodes.withColumnRenamed("pathway", "child"), "child", "left_semi")
    return kept, parents.select("parent", "child").distinct()


def load_associations(links: DataFrame, names: DataFrame, minimum: int) -> DataFrame:
    """Scored links above a minimum with protein ids replaced by symbols; the best score per unordered pair."""
    strong = links.where(F.col("combined_score") >= minimum)
    n1, n2 = names.select(F.col("protein").alias("protein1"), F.col("symbol").alias("s1")), names.select(F.col("protein").alias("protein2"), F.col("symbol").alias("s2"))
    named = strong.join(n1, "protein1").join(n2, "protein2").select("s1", "s2", "combined_score")
    return unordered(named, "s1", "s2").groupBy("low", "high").agg(F.max("combined_score").alias("combined_score"))


def load_interactions(rows: DataFrame, a: str = "feature_a", b: str = "feature_b") -> DataFrame:
    """Unordered pairs with their set of systems and number of records."""
    return unordered(rows.select(a, b, "system"), a, b).groupBy("low", "high").agg(
        F.concat_ws("|", F.sort_array(F.collect_set("system"))).alias("systems"), F.count(F.lit(1)).alias("n_records"))


def partner_edges(events: DataFrame) -> DataFrame:
    """Unordered event pairs: entities observed, any high confidence, any in frame.

    (pair, entity) is collapsed first, so a pair holding many events is counted, not moved whole.
    """
    rows = unordered(events.where("feature is not null and partner is not null").select("entity", "feature", "partner", "confidence_high", "in_frame"), "feature", "partner")
    per = rows.groupBy("low", "high", "entity").agg(F.bool_or("confidence_high").alias("c"), F.bool_or("in_frame").alias("f"))
    return per.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n_entities"), F.bool_or("c").alias("any_confident"), F.bool_or("f").alias("any_in_frame"))


BUFFER_ROWS = 1_000_000  # values multiplied together


def block_sums(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (block pair, entity block): the sums of products and of shared rows of all its feature pairs.

    Rows (bi, bj, eb, entity, side, place, z) arrive sorted by all but the last two. Values are buffered up to whole entities,
    laid out as matrices by the place of the feature in its block, and multiplied.
    """
    state: dict = {"key": None}

    def open_block(key: tuple[int, int, int]) -> None:
        state.update(key=key, sums=np.zeros((width, width)), shared=np.zeros((width, width)), held=[], rows=0)

    def multiply(last: bool) -> None:
        if not state["held"]:
            return
        entity, side, place, z = (np.concatenate(x) for x in zip(*state["held"]))
        starts = np.concatenate([[True], entity[1:] != entity[:-1]])
        end = len(entity) if last else int(np.flatnonzero(starts)[-1])  # the last entity may go on in the next batch
        state["held"] = [] if end == len(entity) else [(entity[end:], side[end:], place[end:], z[end:])]
        state["rows"] = len(entity) - end
        if end == 0:
            return
        row = np.cumsum(starts[:end]) - 1
        sides = []
        for s in (0, 1):
            mine = side[:end] == s
            values, there = np.zeros((row[-1] + 1, width)), np.zeros((row[-1] + 1, width))
            values[row[mine], place[:end][mine]] = z[:end][mine]
            there[row[mine], place[:end][mine]] = 1.0
            sides.append((values, there))
        if state["key"][0] == state["key"][1]:
            sides[1] = sides[0]
        state["sums"] += sides[0][0].T @ sides[1][0]
        state["shared"] += sides[0][1].T @ sides[1][1]

    def close_block() -> Iterator[pa.RecordBatch]:
        if state["key"] is not None:
            multiply(True)
            bi, bj, _ = state["key"]
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([state["sums"].tobytes()]), pa.array([state["shared"].tobytes()])], names=["bi", "bj", "sums", "shared"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7)]
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(k) for k in keys[a])
            if key != state["key"]:
                yield from close_block()
                open_block(key)
            state["held"].append(tuple(c[a:b] for c in columns))
            state["rows"] += b - a
            if state["rows"] >= BUFFER_ROWS:
                multiply(False)
    yield from close_block()


def association_topk(layer: DataFrame, k: int = 20, min_abs: float = 0.2, min_n: int = 30, block: int = 500, entity_blocks: int = 8) -> DataFrame:
    """Association score of feature pairs: z-scored dot product over (shared - 1).

    Features are cut into blocks of `block`; a row is sent to the block pairs of its feature (once to a block with itself),
    entities are spread over `entity_blocks` tasks per block pair, and every task keeps two running matrices. These are added
    up as matrices, and only pairs over the thresholds become rows. Each feature keeps its `k` strongest partners.
    """
    moments = layer.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    names = [r.feature for r in layer.select("feature").distinct().orderBy("feature").collect()]  # the catalogue of features
    blocks, width = max(1, -(-len(names) // block)), min(block, max(1, len(names)))
    places = small_frame(layer.sparkSession, [(f, i // width, i % width) for i, f in enumerate(names)], "feature string, own int, place int")
    z = layer.join(moments, "feature").join(places, "feature").select("entity", "own", "place", F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("z"))
    routed = z.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = routed.select(F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.pmod(F.xxhash64("entity"), F.lit(entity_blocks)).cast("int").alias("eb"),
                         "entity", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "place", "z")
    ordered = rows.repartition("bi", "bj", "eb").sortWithinPartitions("bi", "bj", "eb", "entity")
    parts = ordered.mapInArrow(partial(block_sums, width), "bi int, bj int, sums binary, shared binary")

    def survivors(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        sums, shared = (sum(np.frombuffer(x.as_py()).reshape(width, width) for x in table.column(c)) for c in ("sums", "shared"))
        score = sums / np.maximum(shared - 1, 1)
        keep = (shared >= min_n) & (np.abs(score) >= min_abs - 1e-8)  # rounded and cut exactly by Spark
        if bi == bj:
            keep &= np.arange(width)[:, None] < np.arange(width)[None, :]
        i, j = np.nonzero(keep)
        return pa.table({"low": pa.array([names[bi * width + x] for x in i], pa.string()), "high": pa.array([names[bj * width + x] for x in j], pa.string()),
                         "score": pa.array(score[i, j], pa.float64()), "n_shared": pa.array(shared[i, j].astype(np.int64))})

    found = parts.groupBy("bi", "bj").applyInArrow(survivors, "low string, high string, score double, n_shared long")
    strong = found.withColumn("score", F.round("score", DIGITS)).where(F.abs("score") >= min_abs)
    both = strong.select("*", F.inline(F.array(F.struct(F.col("low").alias("focal"), F.col("high").alias("other")), F.struct(F.col("high").alias("focal"), F.col("low").alias("other")))))
    best = F.row_number().over(Window.partitionBy("focal").orderBy(F.desc(F.abs("score")), "other"))
    return both.withColumn("_r", best).where(F.col("_r") <= k).select("low", "high", "score", "n_shared").distinct()


def build_nodes(features: DataFrame, memberships: DataFrame, species: str) -> DataFrame:
    """Features and pathways under one schema, each with its source, its id in that source, and the species."""
    null = F.lit(None).cast("string")
    f = features.groupBy("feature").agg(F.min("symbol").alias("display_name")).select(
        F.concat(F.lit("feature:"), "feature").alias("node_id"), F.lit("feature").alias("node_type"), F.lit("feature_reference").alias("source_db"), "display_name",
        F.col("feature").alias("feature_id"), null.alias("pathway_id"), F.lit(species).alias("species"))
    p = memberships.select("pathway").distinct().select(
        F.concat(F.lit("pathway:"), "pathway").alias("node_id"), F.lit("pathway").alias("node_type"), F.lit("pathways").alias("source_db"), F.col("pathway").alias("display_name"),
        null.alias("feature_id"), F.col("pathway").alias("pathway_id"), F.lit(species).alias("species"))
    return f.unionByName(p)


def edge(df: DataFrame, a: str, b: str, kinds: tuple[str, str], edge_type: str, source_db: str, weight: str | None, directed: bool, detail: str | None, n: str | None) -> DataFrame:
    """Rows of one source under the common edge schema."""
    null = F.lit(None)
    return df.select(
        F.concat(F.lit(f"{kinds[0]}:"), a).alias("source_node_id"), F.concat(F.lit(f"{kinds[1]}:"), b).alias("target_node_id"), F.lit(edge_type).alias("edge_type"), F.lit(source_db).alias("source_db"),
        (F.col(weight).cast("double") if weight else null.cast("double")).alias("weight"), F.lit(directed).alias("directed"),
        (F.col(detail).cast("string") if detail else null.cast("string")).alias("evidence_detail"), (F.col(n).cast("bigint") if n else null.cast("bigint")).alias("n_source_observations"))


def build_edges(memberships: DataFrame, hierarchy: DataFrame, associations: DataFrame, interactions: DataFrame, partners: DataFrame, codependency: DataFrame) -> DataFrame:
    pair = ("feature", "feature")
    return union_all([
        edge(memberships, "feature", "pathway", ("feature", "pathway"), "member_of", "pathways", None, True, None, None),
        edge(hierarchy, "child", "parent", ("pathway", "pathway"), "child_of", "pathways", None, True, None, None),
        edge(associations, "low", "high", pair, "association", "associations", "combined_score", False, None, None),
        edge(interactions, "low", "high", pair, "interaction", "interactions", None, False, "systems", "n_records"),
        edge(partners, "low", "high", pair, "event_partner", "events", "n_entities", False, None, "n_entities"),
        edge(codependency, "low", "high", pair, "codependency", "dependency", "score", False, None, "n_shared"),
    ])


def resolve_symbols(symbols: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct symbols with the one id they have, or why there is none."""
    counts = symbol_counts(reference)
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left")
    return out.select("symbol", F.when(F.col("n_ids") == 1, F.col("only_id")).alias("feature"), F.when(F.col("n_ids") == 1, "resolved").when(F.col("n_ids") > 1, "ambiguous").otherwise("unresolved").alias("status"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Nodes within a few hops with their distance and only the edges that lead one hop closer.

    One join per hop; hops are few and given by the request. The visited set is written to the
    shared folder after each hop, so plans stay short. Edges to a node missing from the node table
    do not count.
    """
    known = nodes.select(F.col("node_id"))
    ways = edges.select(F.inline(F.array(
        F.struct(F.col("source_node_id").alias("from_node"), F.col("target_node_id").alias("node_id"), "edge_type", "source_db", "weight"),
        F.struct(F.col("target_node_id").alias("from_node"), F.col("source_node_id").alias("node_id"), "edge_type", "source_db", "weight")))).where("from_node <> node_id")
    visited = known.where(F.col("node_id") == start).withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = visited.where(F.col("hop") == hop - 1).select(F.col("node_id").alias("from_node"))
        reached = ways.join(front, "from_node", "left_semi").select("node_id").distinct().join(known, "node_id", "left_semi")
        fresh = reached.join(visited, "node_id", "left_anti").withColumn("hop", F.lit(hop))
        visited = stage(visited.unionByName(fresh), "visited")
    closer = visited.select(F.col("node_id").alias("from_node"), (F.col("hop") + 1).alias("hop"))
    steps = ways.join(visited.where("hop > 0"), "node_id").join(closer, ["from_node", "hop"])
    return steps.join(nodes.select("node_id", "node_type", "display_name"), "node_id").select(
        "node_id", "node_type", "display_name", "hop", F.col("from_node").alias("connected_to"), "edge_type", "source_db", "weight")


def cap_neighbours(steps: DataFrame, n: int) -> DataFrame:
    """The n neighbours with the strongest edge, the total found and whether the list was cut."""
    per = steps.groupBy("node_id", "hop").agg(F.max("weight").alias("best_weight"))
    total = per.agg(F.count(F.lit(1)).alias("t")).scalar()
    top = per.orderBy(F.desc_nulls_last("best_weight"), "node_id").limit(n)
    return top.withColumn("total_found", total).withColumn("truncated", F.col("total_found") > n)


def shared_pathways(memberships: DataFrame, features: list[str]) -> DataFrame:
    rows = memberships.where(F.col("feature").isin(features)).select("feature", "pathway").distinct()
    return rows.groupBy("pathway").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(set(features))).select("pathway")


def direct_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    low, high = min(a, b), max(a, b)
    return edges.where((F.least("source_node_id", "target_node_id") == low) & (F.greatest("source_node_id", "target_node_id") == high)).select("edge_type", "source_db", "weight", "evidence_detail", "n_source_observations")


def feature_context(nodes: DataFrame, edges: DataFrame, features: list[str], cap: int = 10, pathway_cap: int = 5) -> DataFrame:
    """Two lists per requested feature, each in a stable order and capped with its total: all its edges, and its pathways.

    The order is by source, type, neighbour id and detail. A feature that is not in the graph and one without edges differ.
    """
    ids = [f"feature:{f}" for f in features]
    lists = F.explode(F.array(*[F.struct(F.lit(i).alias("focal"), F.lit(x).alias("list")) for i in ids for x in ("edges", "pathways")])).alias("w")
    wanted = edges.sparkSession.range(1).select(lists).select("w.*")
    there = nodes.select(F.col("node_id").alias("focal"), F.lit(True).alias("known"))
    touching = edges.where(F.col("source_node_id").isin(ids) | F.col("target_node_id").isin(ids)).select("edge_type", "source_db", "weight", "evidence_detail", F.inline(F.array(
        F.struct(F.col("source_node_id").alias("focal"), F.col("target_node_id").alias("other")), F.struct(F.col("target_node_id").alias("focal"), F.col("source_node_id").alias("other"))))).where(F.col("focal").isin(ids))
    touching = touching.join(nodes.select(F.col("node_id").alias("other"), "node_type", F.coalesce("feature_id", "pathway_id").alias("neighbour_id")), "other")
    member = F.when(F.col("node_type") == "pathway", F.array(F.lit("edges"), F.lit("pathways"))).otherwise(F.array(F.lit("edges")))
    listed = touching.withColumn("list", F.explode(member))
    order = Window.partitionBy("focal", "list").orderBy("source_db", "edge_type", "neighbour_id", "other", F.coalesce("evidence_detail", F.lit("")))
    most = F.when(F.col("list") == "edges", cap).otherwise(pathway_cap)
    first = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    totals = listed.groupBy("focal", "list").agg(F.count(F.lit(1)).alias("total"))
    out = wanted.join(there, "focal", "left").join(totals, ["focal", "list"], "left").join(first, ["focal", "list"], "left")
    state = F.when(F.col("known").isNull(), "not_in_graph").when(F.col("total").isNull(), "none").otherwise("ok")
    return out.select("focal", "list", state.alias("state"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.col("total") > most, F.lit(False)).alias("truncated"), "place", "source_db", "edge_type", "other", "weight")


def pairwise_shared(memberships: DataFrame, features: list[str]) -> DataFrame:
    """Shared pathways of each requested pair over uncapped sets.

    The requested features of a pathway are at most the request, and only their pairs are formed.
    """
    rows = memberships.where(F.col("feature").isin(features)).groupBy("pathway").agg(F.collect_set("feature").alias("_in"))
    ids = sorted(set(features))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(ids) for b in ids[i + 1:]])
    hit = F.filter(pairs, lambda p: F.array_contains("_in", p["a"]) & F.array_contains("_in", p["b"]))
    found = rows.select("pathway", F.inline(hit)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.concat_ws("|", F.sort_array(F.collect_list("pathway"))).alias("pathways"))
    asked = memberships.sparkSession.range(1).select(F.inline(pairs))
    return asked.join(found, ["a", "b"], "left").na.fill(0, ["n_shared"]).na.fill("", ["pathways"])


def explain_pairs(memberships: DataFrame, associations: DataFrame, interactions: DataFrame, pairs: list[tuple[str, str]], show: int = 5) -> DataFrame:
    """Shared pathways smallest first, the association score, interaction records and source count."""
    ids = sorted({f for p in pairs for f in p})
    asked = memberships.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(min(p)).alias("low"), F.lit(max(p)).alias("high")) for p in pairs])))
    sizes = memberships.select("feature", "pathway").distinct().groupBy("pathway").agg(F.count(F.lit(1)).alias("size"), F.collect_set(F.when(F.col("feature").isin(ids), F.col("feature"))).alias("_in"))
    hit = F.filter(F.array(*[F.struct(F.lit(min(p)).alias("low"), F.lit(max(p)).alias("high")) for p in pairs]), lambda p: F.array_contains("_in", p["low"]) & F.array_contains("_in", p["high"]))
    shared = sizes.where(F.size("_in") > 0).select("pathway", "size", F.inline(hit)).groupBy("low", "high").agg(F.sort_array(F.collect_list(F.struct("size", "pathway"))).alias("_s"))
    out = asked.join(shared, ["low", "high"], "left").join(associations, ["low", "high"], "left").join(interactions, ["low", "high"], "left")
    n = F.coalesce(F.size("_s"), F.lit(0))
    found = n.cast("boolean").cast("int") + F.col("combined_score").isNotNull().cast("int") + F.col("n_records").isNotNull().cast("int")
    return out.select("low", "high", n.alias("n_shared"), F.coalesce(F.array_join(F.transform(F.slice("_s", 1, show), lambda s: s["pathway"]), " | "), F.lit("")).alias("smallest_pathways"),
                      F.col("combined_score").alias("association"), F.coalesce("systems", F.lit("")).alias("systems"), F.coalesce("n_records", F.lit(0)).alias("n_records"), found.alias("n_sources"))


def source_coverage(sources: dict[str, DataFrame], panel: list[str]) -> DataFrame:
    """How many panel features each source knows; a source is a frame with a `feature` column."""
    tagged = union_all([df.where(F.col("feature").isin(panel)).select("feature").distinct().withColumn("source", F.lit(name)) for name, df in sources.items()])
    names = tagged.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in sources])).alias("source"))
    found = tagged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return names.join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_known"), F.lit(len(panel)).alias("n_panel"), F.round(F.lit(100.0) * F.coalesce("n", F.lit(0)) / len(panel), 6).alias("pct"))


def audit_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long (check, item, n): repeated nodes and edges, missing endpoints, counts by type, top degree."""
    repeated_nodes = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_nodes").alias("check"), F.lit("").alias("item"), "n")
    key = edges.groupBy(F.least("source_node_id", "target_node_id").alias("l"), F.greatest("source_node_id", "target_node_id").alias("h"), "edge_type").agg(F.count(F.lit(1)).alias("k"))
    repeated_edges = key.where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_edges").alias("check"), F.lit("").alias("item"), "n")
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    missing = ends.join(nodes, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_endpoints").alias("check"), F.lit("").alias("item"), "n")
    by_type = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("check"), F.col("edge_type").alias("item"), "n")
    by_node = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("check"), F.col("node_type").alias("item"), "n")
    top = ends.agg(F.max("degree").alias("n")).select(F.lit("max_degree").alias("check"), F.lit("").alias("item"), "n")
    return union_all([repeated_nodes, repeated_edges, missing, by_type, by_node, top])


def memberships_of(memberships: DataFrame, features: list[str]) -> DataFrame:
    """Pathways of each requested feature in order; an empty list means checked and none."""
    asked = memberships.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    lists = memberships.where(F.col("feature").isin(features)).groupBy("feature").agg(F.sort_array(F.collect_set("pathway")).alias("_p"))
    out = asked.join(lists, "feature", "left")
    return out.select("feature", F.coalesce(F.size("_p"), F.lit(0)).alias("n"), F.coalesce(F.array_join("_p", "|"), F.lit("")).alias("pathways"))


def compare_builds(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows per type in two builds, with how many rows only one of them has."""
    kind = key[-1]
    tagged = old.select(*key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    per = tagged.groupBy(*key).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return per.groupBy(kind).agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"), F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("only_old"), F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("only_new"))

"""Rank agreement, sweeps, sensitivity indices and negative controls over panel scoring."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelgrid.functions.columns import hash_uniform
from panelgrid.functions.distribution import join_keys, medians, row_positions, value_positions
from panelgrid.operators.score import LAYERS, Panel, Scenario
from panelgrid.session import stage

DIGITS = 9
TAU_BLOCK, TAU_BLOCKS = 1 << 16, 2048  # positions of a block, and blocks of a ranking at most
# Bounds of the swept thresholds.
THRESHOLD_BOUNDS = {"min_group_n": (5, 50), "min_calibration_n": (10, 100), "insufficient_fraction": (0.2, 0.8), "fraction_threshold": (0.5, 0.95), "strong_cutoff": (-1.5, -0.5), "broad_fraction": (0.75, 0.99)}
FACTORS = [f"weight_{layer}" for layer in LAYERS] + list(THRESHOLD_BOUNDS)
# Fixed values: (high_min_layers, moderate_min_layers).
LAYER_COUNT_GRID = [(2, 1), (3, 1), (3, 2), (4, 2), (4, 3)]


def top_lists(parted: DataFrame, k: int = 10) -> DataFrame:
    return parted.where((F.col("bucket") == "ranked") & (F.col("rank") <= k)).select("scenario_id", "query_id", "entity", "rank")


def rbo(a: DataFrame, b: DataFrame, keys: list[str], p: float = 0.9, k: int = 10) -> DataFrame:
    """Extrapolated rank-biased overlap of two lists per key. Lists are (keys, entity, rank) of at most k rows."""
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys)
    depth = sizes.select(*keys, F.least(F.lit(k), "_na", "_nb").cast("int").alias("_k"))
    common = a.withColumnRenamed("rank", "_ra").join(b.withColumnRenamed("rank", "_rb"), [*keys, "entity"]).select(*keys, F.greatest("_ra", "_rb").alias("_at"))
    at = common.groupBy(*keys).agg(F.collect_list("_at").alias("_ats"))
    rows = depth.join(at, keys, "left").select(*keys, "_k", F.coalesce("_ats", F.expr("cast(array() as array<int>)")).alias("_ats"), F.explode(F.sequence(F.lit(1), "_k")).alias("_d"))
    overlap = F.size(F.filter("_ats", lambda x: x <= F.col("_d")))
    terms = rows.withColumn("_o", overlap / F.col("_d"))
    total = terms.groupBy(*keys).agg(F.sum(F.col("_o") * F.pow(F.lit(p), "_d")).alias("_s"), F.max(F.when(F.col("_d") == F.col("_k"), F.col("_o") * F.pow(F.lit(p), "_k"))).alias("_last"))
    return total.select(*keys, F.round(F.col("_last") + F.lit((1 - p) / p) * F.col("_s"), DIGITS).alias("rbo"))


def full_ranking(results: DataFrame, keys: list[str]) -> DataFrame:
    """Position of every scored entity by falling score, then id, counted over ranges of scores."""
    rows = results.where("D is not null").select(*keys, F.struct((-F.col("D")).alias("d"), F.col("entity").alias("e")).alias("_v"))
    places = row_positions(rows, keys, "_v")
    return places.select(*keys, F.col("_v.e").alias("entity"), (F.col("before") + 1).alias("position"))


def inversions(values: np.ndarray) -> int:
    """Number of pairs of distinct values in falling order, by splitting them bit by bit from the highest down."""
    order = np.empty(len(values), np.int64)
    order[np.argsort(values, kind="stable")] = np.arange(len(values))
    total = 0
    for bit in reversed(range(max(len(values) - 1, 0).bit_length())):
        one = (order >> bit) & 1
        prefix = order >> (bit + 1)
        ones = np.cumsum(one)
        start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        before = ones - np.repeat((ones - one)[start], np.diff(np.append(start, len(order))))
        total += int(before[one == 0].sum())
        order = order[np.argsort(order >> bit, kind="stable")]
    return total


def crossing(counts: np.ndarray) -> int:
    """Pairs of items in an earlier row and a later column of a matrix of counts than another."""
    above = np.cumsum(counts, axis=0) - counts
    after = above.sum(1, keepdims=True) - np.cumsum(above, axis=1)
    return int((counts * after).sum())


def kendall_tau(a: DataFrame, b: DataFrame, keys: list[str], block: int = TAU_BLOCK, most: int = TAU_BLOCKS) -> DataFrame:
    """Kendall's tau of two rankings without ties, over common items. Rankings are (keys, entity, position).

    Inversions are counted by merging blocks of positions. Both rankings are cut into blocks of `block` positions (more where there would be
    over `most` blocks). A pair of items lies in different blocks of both: the matrix of counts, blocks x blocks, gives these. Or in one block of the
    first or of the second ranking: a task holds such a block and counts its inversions, and those of both kinds at once are taken off again.
    So an item is sent to two tasks, and none holds a whole ranking.
    """
    both = a.select(*keys, "entity", F.col("position").alias("_a")).join(b.select(*keys, "entity", F.col("position").alias("_b")), [*keys, "entity"])
    both = stage(both, "rankings")
    n = both.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.max("_a"), F.max("_b")).alias("_last"))
    n = n.withColumn("_size", F.greatest(F.lit(block), F.ceil(F.col("_last") / most)))
    cut = join_keys(both, F.broadcast(n.select(*keys, "_last", "_size")), keys).select(
        *keys, "_a", "_b", F.when(F.col("_last") > F.col("_size"), F.col("_size")).otherwise(0).alias("_size"))  # 0 where one block holds all
    block_of = lambda c: F.floor((F.col(c) - 1) / F.col("_size"))
    blocks = F.array(*[F.struct(F.lit(side).alias("_side"), block_of(c).alias("_block")) for side, c in enumerate(("_a", "_b"))])
    rows = cut.select("*", F.inline(F.when(F.col("_size") > 0, blocks).otherwise(F.array(F.struct(F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_block"))))))

    def within(table: pa.Table) -> pa.Table:
        first, second = (table.column(c).to_numpy() for c in ("_a", "_b"))
        size = table.column("_size")[0].as_py()
        order = np.argsort(first)
        found = inversions(second[order])
        if table.column("_side")[0].as_py() == 0 and size:  # pairs of one block in both rankings are also counted on the other side
            other = (second - 1) // size
            order = order[np.argsort(other[order], kind="stable")]
            cells = np.split(second[order], np.flatnonzero(np.diff(other[order])) + 1)
            found -= sum(inversions(c) for c in cells)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_inv": pa.array([found], pa.int64())})

    def between(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy().astype(np.int64) for c in ("_an", "_bn")]
        counts = np.zeros([int(x.max()) + 1 for x in at], np.int64)
        counts[at[0], at[1]] = table.column("_n").to_numpy()
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "_inv": pa.array([crossing(counts)], pa.int64())})

    schema = ", ".join([*(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys), "_inv long"])
    local = rows.groupBy(*keys, "_side", "_block").applyInArrow(within, schema)
    matrix = cut.where("_size > 0").groupBy(*keys, block_of("_a").alias("_an"), block_of("_b").alias("_bn")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).applyInArrow(between, schema)
    total = local.unionByName(matrix).groupBy(*keys).agg(F.sum("_inv").cast("double").alias("_inv"))
    tau = 1.0 - F.try_divide(4.0 * F.coalesce("_inv", F.lit(0.0)), F.col("n") * (F.col("n") - 1))
    return join_keys(n, total, keys, "left").select(*keys, F.col("n").cast("bigint").alias("n"), F.round(tau, DIGITS).alias("tau"))


def membership_change(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Number of entities only one of two lists has, per key."""
    tagged = a.select(*keys, "entity", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, "entity", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = tagged.groupBy(*keys, "entity").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = per.groupBy(*keys).agg(F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("n_diff"))
    return out.withColumn("changed", F.col("n_diff") > 0)


def dirichlet_samples(ids: DataFrame, names: list[str], seed: int, key: str = "sample_id") -> DataFrame:
    """Uniform weights on the simplex, one set per id: exponential draws over their sum."""
    draws = [-F.ln(hash_uniform(seed, key, F.lit(n))) for n in names]
    total = sum(draws[1:], draws[0])
    return ids.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), (d / total).alias("weight")) for n, d in zip(names, draws)])))


def uniform_of(*parts: object) -> float:
    """The same draw as `hash_uniform`, for building a request on the driver."""
    head = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8]
    return (int(head, 16) + 0.5) / 4294967296.0


def dirichlet_scenarios(n: int, seed: int) -> list[Scenario]:
    out = []
    for i in range(n):
        draws = {layer: -math.log(uniform_of(seed, i, layer)) for layer in LAYERS}
        total = sum(draws.values())
        out.append(Scenario(f"dirichlet_{i}", {k: round(v / total, 12) for k, v in draws.items()}))
    return out


def saltelli_design(n: int, seed: int) -> list[Scenario]:
    """Rows A, B and A with one column from B, for n base points, as scenarios.

    The design is a matrix over the unit cube. Its weight columns are scaled to shares (equal ones where a row has none),
    its threshold columns are stretched to their bounds.
    """
    names, cube = [], []
    for j in range(n):
        a, b = ([uniform_of(seed, kind, j, f) for f in FACTORS] for kind in "AB")
        swapped = np.where(np.eye(len(FACTORS), dtype=bool), b, a)
        names += [f"A|{j}|", f"B|{j}|", *(f"AB|{j}|{f}" for f in FACTORS)]
        cube += [a, b, *swapped.tolist()]
    shares, unit = np.hsplit(np.array(cube), [len(LAYERS)])
    total = shares.sum(1, keepdims=True)
    shares = np.where(total > 1e-9, shares / np.maximum(total, 1e-9), 1 / len(LAYERS)).round(12)
    low, high = np.array(list(THRESHOLD_BOUNDS.values())).T
    stretched = low + unit * (high - low)
    counts = [k.endswith("_n") for k in THRESHOLD_BOUNDS]
    return [Scenario(name, dict(zip(LAYERS, w.tolist())), **{k: round(v) if whole else round(v, 6) for k, v, whole in zip(THRESHOLD_BOUNDS, t.tolist(), counts)})
            for name, w, t in zip(names, shares, stretched)]


def compare_to_baseline(tops: DataFrame, baseline: str, queries: DataFrame) -> DataFrame:
    """Overlap and membership change of each scenario's list with the baseline list, per query.

    ``tops`` is (scenario_id, query_id, entity, rank): at most ten rows per scenario and query. ``queries`` is
    (scenario_id, query_id): what is asked. An overlap with an empty list is undefined, hence null.
    """
    keys = ["scenario_id", "query_id"]
    base = tops.where(F.col("scenario_id") == baseline).drop("scenario_id").join(queries, "query_id")
    rest = tops.where(F.col("scenario_id") != baseline).join(queries, keys, "left_semi")
    return (queries.join(rbo(base, rest, keys), keys, "left").join(membership_change(base, rest, keys), keys, "left")
            .select(*keys, "rbo", F.coalesce("n_diff", F.lit(0)).alias("n_diff")))


def tau_to_baseline(results: DataFrame, baseline: str, queries: DataFrame) -> DataFrame:
    """Kendall's tau of each scenario's ranking of all scored entities with the baseline's, per query; null if under two are shared."""
    keys = ["scenario_id", "query_id"]
    full = stage(full_ranking(results, keys), "rankings")
    base = full.where(F.col("scenario_id") == baseline).drop("scenario_id").join(queries, "query_id")
    return queries.join(kendall_tau(base, full.where(F.col("scenario_id") != baseline), keys), keys, "left").select(*keys, "tau")


def sweep_means(compared: DataFrame) -> DataFrame:
    """Means over queries, where an undefined overlap counts as none."""
    overlap = F.coalesce("rbo", F.lit(0.0))
    return compared.groupBy("scenario_id").agg(F.round(F.avg(overlap), DIGITS).alias("mean_rbo"), F.max("n_diff").alias("max_diff"))


def sobol_indices(means: DataFrame) -> DataFrame:
    """First-order and total indices from mean overlaps of a design, by the usual estimators.

    Outputs are standardised first; a constant output has no indices.
    """
    parts = F.split("scenario_id", r"\|")
    y = means.select(parts[0].alias("kind"), parts[1].alias("j"), parts[2].alias("factor"), F.col("mean_rbo").alias("y"))
    moments = y.agg(F.struct(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))).scalar()
    z = y.withColumn("z", F.try_divide(F.col("y") - moments["m"], moments["s"]))
    a, b = z.where("kind = 'A'").select("j", F.col("z").alias("za")), z.where("kind = 'B'").select("j", F.col("z").alias("zb"))
    spread = z.where("kind in ('A', 'B')").agg(F.var_pop("z")).scalar()
    rows = z.where("kind = 'AB'").join(a, "j").join(b, "j")
    out = rows.groupBy("factor").agg(F.avg(F.col("zb") * (F.col("z") - F.col("za"))).alias("_s1"), F.avg(F.pow(F.col("za") - F.col("z"), F.lit(2))).alias("_st"))
    out = out.withColumn("_v", spread)
    return out.select("factor", F.round(F.try_divide("_s1", "_v"), 6).alias("S1"), F.round(F.try_divide(F.col("_st") / 2, F.col("_v")), 6).alias("ST"))


def tier_grid() -> list[Scenario]:
    return [Scenario(f"grid_{h}_{m}", high_min_layers=h, moderate_min_layers=m) for h, m in LAYER_COUNT_GRID]


def unfinished(design: DataFrame, done: DataFrame) -> DataFrame:
    """Design rows without a written result."""
    return design.join(done.select("scenario_id").distinct(), "scenario_id", "left_anti")


def known_negative(results: DataFrame, veto_features: list[str], ceiling: float = 0.10) -> DataFrame:
    """Confident share of a panel that should fail, and how often the expected features veto."""
    sure, some = F.col("tier").isin("High", "Moderate"), F.col("tier") != "Insufficient"
    out = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(sure, 1)).alias("n_confident"), F.count(F.when(some, 1)).alias("n_scored"), F.count(F.when(some & F.col("veto_feature").isin(veto_features), 1)).alias("n_veto"))
    out = out.withColumn("confident_fraction", F.round(F.col("n_confident") / F.col("n"), DIGITS)).withColumn("veto_fraction", F.round(F.coalesce(F.try_divide(F.col("n_veto").cast("double"), F.col("n_scored")), F.lit(0.0)), DIGITS))
    return out.withColumn("passed", (F.col("confident_fraction") <= ceiling) & (F.col("veto_fraction") > 0.5))


def random_panels(battery: list[Panel], features: list[str], reps: int, seed: int) -> list[Panel]:
    """Panels of the same shape with features drawn by hash order from the feature catalogue."""
    out = []
    for p in battery:
        for r in range(reps):
            order = sorted(features, key=lambda f: (uniform_of(seed, p.query_id, r, f), f))
            out.append(Panel(f"{p.query_id}#{r}", tuple(order[: len(p.include)]), tuple(order[len(p.include): len(p.features)]), p.group))
    return out


# A high score, and how far random panels must stay below the real ones.
HIGH_SCORE, RANDOM_MEDIAN, RANDOM_RATIO = 0.7, 0.2, 0.5


def score_summary(results: DataFrame) -> DataFrame:
    """Scores and tiers of real against random panels (id holds '#'), and on the random row whether they stay low enough."""
    rows = stage(results.select("tier", "D", F.when(F.col("query_id").contains("#"), "random").otherwise("real").alias("kind")), "scores")
    scored = rows.where("D is not null")
    middle = medians(scored, ["kind"], "D", "median_D").drop("n")
    collapsed = F.col("tier").isin("Low", "Insufficient").cast("double")
    tiers = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(collapsed), DIGITS).alias("collapse_fraction"))
    out = scored.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_scored"), F.round(F.avg("D"), 6).alias("mean_D"), F.round(F.avg((F.col("D") >= HIGH_SCORE).cast("double")), DIGITS).alias("high_fraction"))
    out = tiers.join(out, "kind", "left").join(middle, "kind", "left").withColumn("median_D", F.round("median_D", DIGITS))
    real = out.where("kind = 'real'").agg(F.max("mean_D")).scalar()
    low = F.coalesce((F.col("median_D") <= RANDOM_MEDIAN) & (F.col("mean_D") < RANDOM_RATIO * real), F.lit(False))
    return out.withColumn("passed", F.when(F.col("kind") == "random", low))


def shuffled_groups(entities: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, entity, cal_grp): group labels permuted over entities, once per draw.

    Position in id order is matched with position in hash order; both come from exact
    distributed positions, so no draw is ordered in one task.
    """
    rows = entities.select("entity", "grp", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    mixed = rows.select("draw", F.struct(hash_uniform(seed, "draw", "entity").alias("u"), F.col("entity").alias("e")).alias("_v"))
    target = value_positions(rows, ["draw"], "entity").select("draw", "entity", F.col("before").alias("_p"))
    source = value_positions(mixed, ["draw"], "_v").select("draw", F.col("_v.e").alias("_from"), F.col("before").alias("_p"))
    labels = entities.select(F.col("entity").alias("_from"), F.col("grp").alias("cal_grp"))
    return target.join(source, ["draw", "_p"]).join(labels, "_from").select("draw", "entity", "cal_grp")


def informative_panels(panels: DataFrame, group_constants: DataFrame) -> DataFrame:
    """Queries with a group in which one of their features has its own constants. ``panels``: query_id, grp, feature."""
    return panels.where("grp is not null").join(group_constants.select("grp", "feature"), ["grp", "feature"], "left_semi").select("query_id").distinct()


def shuffle_verdict(compared: DataFrame, ceiling: float = 0.9) -> DataFrame:
    """Mean overlap of the draws in which it is defined, per query, and whether shuffling changed the list."""
    out = compared.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_draws"), F.count("rbo").alias("n_defined"), F.round(F.avg("rbo"), 8).alias("mean_rbo"))
    return out.withColumn("passed", F.coalesce(F.col("mean_rbo") <= ceiling, F.lit(False)))


def holdout_verdict(compared: DataFrame, ceiling: int = 2) -> DataFrame:
    """One row: the median membership change over all held-out groups and panels, and whether it is small."""
    out = medians(compared.withColumn("_k", F.lit(1)), ["_k"], "n_diff", "median_diff").select("n", "median_diff")
    return out.withColumn("passed", F.col("median_diff") <= ceiling)


def holdout_groups(entities: DataFrame, top: int = 5, min_n: int = 100) -> DataFrame:
    counts = entities.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    return counts.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "grp"))).where(F.col("_r") <= top).drop("_r")



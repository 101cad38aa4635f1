"""Resampling and hold-out kernels over the rows of one pair.

Bootstrap. A pair has one row for each entity, so its rows grow with the data and are never gathered. Rows of a stratum are numbered
and cut into chunks of `CHUNK`. The draws of a chunk of places need no rows; each sends to every chunk the packed replicates and positions
that it drew there, so that (rows of a stratum / `CHUNK`)^2 messages hold replicates x rows draws. A chunk adds them to one vector for each row: how
often each replicate drew it. Equal rows of a chunk are merged. The vectors are then dealt by ranges of values: the totals of
a range for each replicate are summed over the ranges before it, which gives the range that holds the middle of a replicate, and what a range adds
to its ranks. A draw is a hash of seed, stratum, replicate and position, so a retry or another split gives the same numbers.

Hold-outs. Leaving out one group is a replicate that draws its rows not at all and all others once, so equal rows of a group are counted and
get a vector with one place for each group of the pair; medians and ranks come from ranges as above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.functions.distribution import join_keys, value_ranges
from panelgrid.session import stage

BLOCKS = 16  # blocks of replicates that are drawn apart
CHUNK = 1 << 14  # rows of a stratum that are drawn and weighted together


def number_rows(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Exact 1-based position of each row inside its group, as `_pos`.

    Groups are cut into hash buckets by entity; rows are numbered inside (group, bucket) and the
    sizes of earlier buckets are added, so a group of any size is numbered in parallel. The order
    is by bucket, then by the given columns: fixed for the same rows.
    """
    bucketed = rows.withColumn("_b", F.substring(F.md5(F.col("entity").cast("string")), 1, 2))
    local = Window.partitionBy(*group, "_b").orderBy(*order)
    sizes = bucketed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    return bucketed.withColumn("_i", F.row_number().over(local)).join(offsets, [*group, "_b"]).withColumn("_pos", F.col("_i") + F.col("_off")).drop("_i", "_off", "_b")


def drawn_positions(name: str, replicate: int, places: range, n: int) -> np.ndarray:
    """Positions (from 0) that a replicate draws at some places of a stratum of n rows."""
    head = hashlib.md5(f"{name}:{replicate}:".encode())
    digests = []
    for place in places:
        h = head.copy()
        h.update(b"%d" % place)
        digests.append(h.digest())
    numbers = np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4)[:, 0]
    return np.floor((numbers + 0.5) / 4294967296.0 * n).astype(np.int64)


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def sent_draws(sizes: DataFrame, strata: list[str], replicates: int, seed: int) -> DataFrame:
    """strata, _chunk, n and codes: how often each replicate drew the rows of a chunk, as sent by a chunk of places and a block of
    replicates. A code is the replicate (from 0) times `CHUNK` and the place in the chunk. `sizes`: strata and _n."""
    step = -(-replicates // BLOCKS)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // step) - 1)))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK)))
    work = sizes.select(*strata, "_n", places.alias("_from")).select("*", blocks.alias("_block"))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are small and their work is not, so they are not coalesced

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = ":".join([str(seed), *(str(row[c]) for c in strata)])
                slots = range(row["_from"] * CHUNK + 1, 1 + min(row["_n"], (row["_from"] + 1) * CHUNK))
                wanted = range(row["_block"] * step, min(replicates, (row["_block"] + 1) * step))
                at = np.concatenate([drawn_positions(name, r + 1, slots, row["_n"]) for r in wanted])
                codes = np.repeat(np.array(wanted), len(slots)) * CHUNK + at % CHUNK
                order = np.lexsort((codes, at // CHUNK))
                chunks, codes = (at // CHUNK)[order], codes[order]
                starts = np.flatnonzero(np.diff(chunks, prepend=-1))
                parts = np.split(codes, starts[1:])
                packed = [pa.compress(np.diff(p, prepend=0).astype("<u4").tobytes(), codec="zstd", asbytes=True) for p in parts]
                own = [pa.array([row[c]] * len(parts), batch.schema.field(c).type) for c in strata]
                yield pa.RecordBatch.from_arrays([*own, pa.array(chunks[starts]), pa.array([len(p) for p in parts], pa.int64()), pa.array(packed, pa.binary())], names=[*strata, "_chunk", "n", "codes"])

    fields = ", ".join(_field(sizes, c) for c in strata)
    return work.repartition(tasks, *strata, "_from", "_block").mapInArrow(run, f"{fields}, _chunk long, n long, codes binary")


def bootstrap_weights(rows: DataFrame, strata: list[str], values: list[str], replicates: int, seed: int, extra: list[str]) -> DataFrame:
    """strata, values, extra and w: how often each replicate drew a row (32-bit integers), equal rows of a chunk merged.

    Rows of a stratum are numbered by hash bucket of the entity, the values, and the entity. `extra` columns depend on strata and values."""
    numbered = stage(number_rows(rows.select(*strata, "entity", *values, *extra), strata, [*values, "entity"]).withColumn("_chunk", F.floor((F.col("_pos") - 1) / CHUNK)), "numbered")
    draws = sent_draws(numbered.groupBy(*strata).agg(F.max("_pos").cast("long").alias("_n")), strata, replicates, seed)
    names = [*strata, *values, *extra]

    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        codes = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(c, 4 * n, codec="zstd"), "<u4").astype(np.int64)) for n, c in zip(sent.column("n").to_pylist(), sent.column("codes").to_pylist())])
        table = table.take(np.argsort((table.column("_pos").to_numpy() - 1) % CHUNK))
        weights = np.bincount(codes % CHUNK * replicates + codes // CHUNK, minlength=table.num_rows * replicates).reshape(-1, replicates)
        columns = [table.column(v).to_numpy() for v in values]
        order = np.lexsort(columns)
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        merged = np.add.reduceat(weights[order], np.flatnonzero(new), axis=0).astype("<u4")
        return table.select(names).take(order[new]).append_column("w", pa.array([w.tobytes() for w in merged], pa.binary()))

    fields = ", ".join(_field(numbered, c) for c in names)
    weighted = numbered.groupBy(*strata, "_chunk").cogroup(draws.groupBy(*strata, "_chunk")).applyInArrow(run, f"{fields}, w binary")
    return stage(weighted, "weights")


def vectors(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary vectors of one length as the rows of a matrix."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def range_bases(weights: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, `at`, base and total: the weight of each replicate in the ranges before one, and in all (doubles). The ranges of a key have a vector each."""
    parts = weights.groupBy(*keys, at).applyInArrow(
        lambda t: pa.table({**{k: t.column(k).slice(0, 1) for k in [*keys, at]}, "own": pa.array([vectors(t.column("w"), "<u4").sum(axis=0, dtype=np.int64).astype("<f8").tobytes()], pa.binary())}),
        ", ".join([*(_field(weights, k) for k in [*keys, at]), "own binary"]))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(at)
        own = vectors(t.column("own"), "<f8")
        upto = np.cumsum(own, axis=0)
        return t.drop_columns(["own"]).append_column("base", pa.array([x.tobytes() for x in upto - own], pa.binary())).append_column("total", pa.array([upto[-1].tobytes()] * len(own), pa.binary()))

    return parts.groupBy(*keys).applyInArrow(run, ", ".join([*(_field(weights, k) for k in [*keys, at]), "base binary", "total binary"]))


def in_order(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the place of each row's, and the weights of each replicate summed by value."""
    distinct, place = np.unique(values, return_inverse=True)
    order = np.argsort(place, kind="stable")
    return distinct, place, np.add.reduceat(weights[order].astype(np.int64), np.searchsorted(place[order], np.arange(len(distinct))), axis=0)


def replicate_medians(weights: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """keys, replicate (from 1) and m: the median of `value` in each replicate, halfway between the two middle ones."""

    def run(table: pa.Table, base: pa.Table) -> pa.Table:
        distinct, _, sums = in_order(table.column(value).to_numpy(), vectors(table.column("w"), "<u4"))
        before, total = (vectors(base.column(c), "<f8")[0] for c in ("base", "total"))
        upto = before + np.cumsum(sums, axis=0)
        out = []
        for r in np.flatnonzero((before <= np.ceil((total - 1) / 2)) & (upto[-1] > np.floor((total - 1) / 2)) & (total > 0)):
            for side, index in enumerate((np.floor((total[r] - 1) / 2), np.ceil((total[r] - 1) / 2))):
                if before[r] <= index < upto[-1, r]:
                    out.append((int(r) + 1, side, float(distinct[np.searchsorted(upto[:, r], index, side="right")])))
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [(), (), ()], (pa.int32(), pa.int32(), pa.float64()))]
        return pa.table([*(pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys), *columns], names=[*keys, "replicate", "side", "v"])

    found = weights.groupBy(*keys, at).cogroup(range_bases(weights, keys, at).groupBy(*keys, at)).applyInArrow(run, ", ".join([*(_field(weights, k) for k in keys), "replicate int, side int, v double"]))
    low, high = (F.max(F.when(F.col("side") == i, F.col("v"))) for i in (0, 1))
    same = F.when(low == high, low).otherwise(low + (high - low) * 0.5)
    return found.groupBy(*keys, "replicate").agg(same.alias("m"))


def with_ranks(weights: DataFrame, keys: list[str], value: str, at: str, out: str) -> DataFrame:
    """The rows of `weights` with the average rank of `value` in each replicate (a vector of doubles) as `out`."""

    def run(table: pa.Table, base: pa.Table) -> pa.Table:
        _, place, sums = in_order(table.column(value).to_numpy(), vectors(table.column("w"), "<u4"))
        ranks = vectors(base.column("base"), "<f8")[0] + np.cumsum(sums, axis=0) - sums + (sums + 1) / 2.0
        return table.append_column(out, pa.array([ranks[p].astype("<f8").tobytes() for p in place], pa.binary()))

    fields = ", ".join(_field(weights, c) for c in weights.columns)
    return weights.groupBy(*keys, at).cogroup(range_bases(weights, keys, at).groupBy(*keys, at)).applyInArrow(run, f"{fields}, {out} binary")


def replicate_correlations(weights: DataFrame, keys: list[str], x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """keys, replicate and stat: the correlation of the ranks of two columns (column, its range) in each replicate; null where one does not vary."""
    ranked = with_ranks(weights, keys, *x, "rx")
    bases = range_bases(weights, keys, y[1])

    def run(table: pa.Table, base: pa.Table) -> pa.Table:
        w, rx = vectors(table.column("w"), "<u4").astype(float), vectors(table.column("rx"), "<f8")
        _, place, sums = in_order(table.column(y[0]).to_numpy(), vectors(table.column("w"), "<u4"))
        ry = (vectors(base.column("base"), "<f8")[0] + np.cumsum(sums, axis=0) - sums + (sums + 1) / 2.0)[place]
        ends = [f(np.where(w > 0, r, lost), axis=0) for r in (rx, ry) for f, lost in ((np.min, np.inf), (np.max, -np.inf))]
        sums = [(w * f).sum(axis=0) for f in (1.0, rx, ry, rx * rx, ry * ry, rx * ry)]
        n = w.shape[1]
        names = ["n", "sx", "sy", "sxx", "syy", "sxy", "lx", "hx", "ly", "hy"]
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}, "replicate": pa.array(range(1, n + 1), pa.int32()), **dict(zip(names, map(pa.array, [*sums, *ends])))})

    fields = ", ".join([*(_field(weights, k) for k in keys), "replicate int", *(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "lx", "hx", "ly", "hy"))])
    parts = ranked.groupBy(*keys, y[1]).cogroup(bases.groupBy(*keys, y[1])).applyInArrow(run, fields)
    n, sx, sy, sxx, syy, sxy = (F.sum(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    varies = (F.min("lx") < F.max("hx")) & (F.min("ly") < F.max("hy"))
    r = F.when(varies, F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))))
    return parts.groupBy(*keys, "replicate").agg(r.alias("stat"))


def bootstrap_shifts(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """keys, replicate and stat: median of the reference less that of the context, of column value_adj; strata are grp x context."""
    side = [*keys, "context"]
    ranged = join_keys(rows, value_ranges(rows, side, "value_adj", "_range"), [*side, "value_adj"])
    weights = bootstrap_weights(ranged, [*keys, "grp", "context"], ["value_adj"], replicates, seed, ["_range"])
    medians = replicate_medians(weights, side, "value_adj", "_range")
    reference, context = (F.max(F.when(F.col("context") == s, F.col("m"))) for s in ("reference", "context"))
    return medians.groupBy(*keys, "replicate").agg((reference - context).alias("stat"))


def bootstrap_correlations(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """keys, replicate and stat: rank correlation of x_adj and y_adj; strata are grp."""
    ranged = rows
    for c in ("x_adj", "y_adj"):
        ranged = join_keys(ranged, value_ranges(rows, keys, c, f"_range_{c}"), [*keys, c])
    weights = bootstrap_weights(ranged, [*keys, "grp"], ["x_adj", "y_adj"], replicates, seed, ["_range_x_adj", "_range_y_adj"])
    return replicate_correlations(weights, keys, ("x_adj", "_range_x_adj"), ("y_adj", "_range_y_adj"))


def hold_out_weights(rows: DataFrame, keys: list[str], values: list[str], ranges: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """keys, values, the ranges and w: how many rows are left of these with each group of the pair held out, in the order of the groups.

    `ranges`: tables of ranges and the columns they are joined by. A pair's groups are a dimension."""
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("grp")).alias("_groups"))
    counts = rows.groupBy(*keys, "grp", *values).agg(F.count(F.lit(1)).alias("_n"))
    for table, by in ranges:
        counts = join_keys(counts, table, by)
    placed = join_keys(counts, groups, keys).withColumns({"_own": F.array_position("_groups", F.col("grp")) - 1, "_all": F.size("_groups").cast("long")}).drop("_groups", "grp")
    names = [c for c in placed.columns if c not in ("_n", "_own", "_all")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, own, every in zip(*(batch.column(c).to_pylist() for c in ("_n", "_own", "_all"))):
                w = np.full(every, n, "<u4")
                w[own] = 0
                out.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "w"])

    return stage(placed.mapInArrow(run, ", ".join([*(_field(placed, c) for c in names), "w binary"])), "held-out")


def held_out_sizes(rows: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """keys, replicate (from 1), held_out, n_groups left and the number of rows left for each condition of `parts`, for each group of a pair with others."""
    sizes = rows.groupBy(*keys, "grp").agg(*(F.count(F.when(c, 1)).alias(name) for name, c in parts.items()))
    whole = Window.partitionBy(*keys)
    left = [(F.sum(name).over(whole) - F.col(name)).alias(name) for name in parts]
    out = sizes.select(*keys, F.row_number().over(whole.orderBy("grp")).alias("replicate"), F.col("grp").alias("held_out"), (F.count(F.lit(1)).over(whole) - 1).alias("n_groups"), *left)
    return out.where("n_groups > 0")


def shifts_without_each_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, held_out, n_groups, and number, median of value_adj of both sides (context, reference) and `raw` (reference less context) without a group."""
    side = [*keys, "context"]
    weights = hold_out_weights(rows, keys, ["context", "value_adj"], [(value_ranges(rows, side, "value_adj", "_range"), [*side, "value_adj"])])
    medians = replicate_medians(weights, side, "value_adj", "_range").groupBy(*keys, "replicate").agg(
        *(F.max(F.when(F.col("context") == s, F.col("m"))).alias(f"median_{s}") for s in ("context", "reference")))
    sizes = held_out_sizes(rows, keys, {f"n_{s}": F.col("context") == s for s in ("context", "reference")})
    return join_keys(sizes, medians, [*keys, "replicate"], "left").withColumn("raw", F.col("median_reference") - F.col("median_context")).drop("replicate")


def correlations_without_each_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, held_out, n_groups, and number of rows and rank correlation r of x_adj and y_adj without a group."""
    ranges = [(value_ranges(rows, keys, c, f"_range_{c}"), [*keys, c]) for c in ("x_adj", "y_adj")]
    weights = hold_out_weights(rows, keys, ["x_adj", "y_adj"], ranges)
    r = replicate_correlations(weights, keys, ("x_adj", "_range_x_adj"), ("y_adj", "_range_y_adj")).withColumnRenamed("stat", "r")
    return join_keys(held_out_sizes(rows, keys, {"n": F.lit(True)}), r, [*keys, "replicate"], "left").drop("replicate")

"""Approximate nearest neighbours by cosine, with inverted lists and an adaptive scan of dimensions.

Vectors are dealt to the nearest of `lists` centroids, fitted on a bounded sample. A query probes a share of the lists,
nearest first, and more until enough vectors are met. Within a probed list, unit vectors turned by one random rotation
are compared in blocks of columns: after each block the distance so far, scaled up to all dimensions, is tested against
the distance of the k-th best, and candidates that are farther with high confidence are abandoned. What is left at the
end has its exact cosine computed from the original vectors in double precision.

Equal vectors are one candidate that carries its smallest k + 1 ids, and equal queries are searched once, so a vector
that a third of the rows share costs no more than any other; both are exact. Lists and queries are cut into
blocks of bounded size, and a unit of work is a block of a list with a block of queries.

Defined cases: rows without an id, and vectors that are null, empty, zero or hold null or non-finite components, take no
part; nor do vectors of another length than most. Repeated rows count once; an id with several vectors has each as a
candidate and as a query. With fewer than k candidates all are returned. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.session import stage

SAMPLE = 16_384  # vectors the centroids are fitted on
SAMPLE_SHARES = 16
LIST_BLOCK, QUERY_BLOCK = 4_096, 2_048  # rows of a unit of work on either side
COLUMNS = 16  # dimensions compared between two tests
CONFIDENCE = 2.1  # larger: later abandonment, higher recall
PROBE_SHARE, PROBE_LEAST = 0.8, 16


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> Index:
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        centroids = unit[rng.permutation(len(unit))[: min(lists, len(unit))]].copy()
        for _ in range(rounds):
            nearest = np.concatenate([(unit[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(unit), 4096)])
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, unit)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
        rotation, _ = np.linalg.qr(rng.normal(size=(unit.shape[1], unit.shape[1])))
        return cls(centroids, rotation)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors; components are scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan(block: np.ndarray, query: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the candidates of a block that may be among the k nearest, ties with the k-th included.

    `block`, `query`: rotated unit vectors; `first`: squared distances over the first block of columns.
    """
    n, width = block.shape
    seeds = np.argpartition(first, k)[:k] if n > k else np.arange(n)
    limit = np.sort(((block[seeds] - query) ** 2).sum(1))[-1] if n > k else np.inf
    alive, partial, done = np.arange(n), first, min(COLUMNS, width)
    while done < width:
        bound = limit * (1 + CONFIDENCE / np.sqrt(done)) ** 2 * done / width
        stay = partial <= bound
        alive, partial = alive[stay], partial[stay]
        more = slice(done, min(done + COLUMNS, width))
        partial = partial + ((block[alive, more] - query[more]) ** 2).sum(1)
        done = more.stop
    if len(alive) > k:
        kth = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= kth + 1e-9]
    return alive


def search_unit(vectors: pa.Table, queries: pa.Table, index: Index, k: int) -> pa.Table:
    """The k best candidates of a block for each query of a block, with exact cosines."""
    schema = pa.schema([("query", pa.int64()), ("mark", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return schema.empty_table()
    width = len(index.rotation)
    x, q = matrix(vectors.column("embedding"), width), matrix(queries.column("embedding"), width)
    ids = vectors.column("ids").to_pylist()
    turned, turned_q = normed(x) @ index.rotation, normed(q) @ index.rotation
    head, head_q = turned[:, :COLUMNS], turned_q[:, :COLUMNS]
    first = (head_q**2).sum(1)[:, None] + (head**2).sum(1)[None, :] - 2 * head_q @ head.T
    size, size_q = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    plain, plain_q = np.isfinite(size) & (size > 0), np.isfinite(size_q) & (size_q > 0)
    names, marks = queries.column("query").to_pylist(), queries.column("mark").to_pylist()
    out: list[tuple] = []
    for i in range(len(q)):
        near = scan(turned, turned_q[i], first[i], k)
        with np.errstate(all="ignore"):
            score = (x[near] * q[i]).sum(1) / (size[near] * size_q[i])
        odd = ~(plain[near] & plain_q[i] & np.isfinite(score))
        if odd.any():  # products beyond the range of doubles
            score[odd] = normed(x[near][odd]) @ normed(q[i : i + 1])[0]
        for j in sorted(range(len(near)), key=lambda j: (-score[j], ids[near[j]][0]))[:k]:
            out.append((names[i], marks[i], ids[near[j]], float(score[j])))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull())
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return rows.where(fine).withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for every query row. `is_query`: on vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width = widths[0].width
    rows = rows.where(F.size("embedding") == width)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    distinct = stage(few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("mark", F.xxhash64("embedding")), "vectors")

    share = Window.partitionBy("share").orderBy("mark")
    most = min(SAMPLE, max(256, (64 << 20) // (8 * width)))
    marked = distinct.withColumn("share", F.pmod("mark", F.lit(SAMPLE_SHARES)))
    sample = marked.withColumn("place", F.row_number().over(share)).where(F.col("place") <= most // SAMPLE_SHARES).orderBy("mark").select("embedding").toArrow()
    total = distinct.count()
    index = Index.fit(matrix(sample.column(0), width), int(np.clip(np.sqrt(total) / 2, 1, 1024)))
    shared = spark.sparkContext.broadcast(index)  # bounded: at most 1,024 centroids and a rotation

    def deal(batches):
        for batch in batches:
            unit = normed(matrix(batch.column(batch.schema.get_field_index("embedding")), width))
            nearest = (unit @ shared.value.centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "list"])

    dealt = stage(distinct.mapInArrow(deal, "embedding array<double>, ids array<long>, mark long, list int"), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in dealt.groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = r["count"]
    blocks = -(-sizes // LIST_BLOCK)
    probes = max(PROBE_LEAST, int(np.ceil(probe_share * len(sizes))))

    asked = stage(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct(), "queries")
    queries = asked.groupBy("embedding").agg(F.min("query_id").alias("query")).withColumn("mark", F.xxhash64("embedding"))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))

    def probe(batches):
        for batch in batches:
            unit = normed(matrix(batch.column(0), width))
            order = np.argsort(-(unit @ shared.value.centroids.T), axis=1, kind="stable")
            row, lists, block = [], [], []
            for i, o in enumerate(order):
                enough = int(np.searchsorted(np.cumsum(sizes[o]), k + 1)) + 1  # so many lists hold k + 1 vectors
                for x in o[: max(probes, enough)]:
                    row += [i] * int(blocks[x])
                    lists += [int(x)] * int(blocks[x])
                    block += range(int(blocks[x]))
            picked = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(lists, pa.int32()), pa.array(block, pa.int32())], names=["embedding", "query", "mark", "list", "block"])

    count = F.element_at(F.array(*(F.lit(int(max(1, b))) for b in blocks)), F.col("list") + 1)
    left = dealt.withColumn("block", F.pmod(F.shiftright("mark", 8), count).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.mapInArrow(probe, "embedding array<double>, query long, mark long, list int, block int")
    right = right.withColumn("part", F.pmod(F.shiftright("mark", 8), F.lit(parts)).cast("int"))
    unit = ["list", "block", "part"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(lambda a, b: search_unit(a, b, shared.value, k + 1), "query long, mark long, ids array<long>, score double")

    best = Window.partitionBy("query", "mark").orderBy(F.desc("score"), "vec_id")
    found = found.select("query", "mark", F.explode("ids").alias("vec_id"), "score").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    found = found.groupBy("query", "mark").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    own = asked.join(queries.select("embedding", "query", "mark"), "embedding").select("query_id", "query", "mark")
    ranked = own.join(found, ["query", "mark"])
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return ranked.select("query_id", F.posexplode(others).alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")


def nearest_of_corpus(vectors: DataFrame) -> DataFrame:
    """The embeddings table: queries are the ids divisible by 50."""
    return search(vectors, F.col("vec_id") % 50 == 0)

"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words are lower-cased in A-Z and cut at ASCII white space; every shingle of three words is hashed, and a
bit of the fingerprint is set when it is set in over half of the hashes.

Join: distinct fingerprints are the leaves of a trie over their bits. A pair of nodes is traversed together: equal
child bits keep the pair's error budget, different ones take one from it, and a pair without budget is pruned. At most
two bits may differ, so one of three blocks of the 64 bits agrees; three tries, each with another block first, spend
no budget within their first block. This makes the nodes below a block independent units of work, one for each value
of the block. Units with more than `UNIT` fingerprints are split further down the trie by DataFrame steps, four bits
a time, until none is that large; then each unit is traversed in one go. Nothing is dropped at any size.

A unit returns edges from each linked fingerprint to the least of those it was found connected with, not all pairs.
Components come from alternating large-star and small-star steps over these edges, each step written as a table.

Keeping one (the stage of the pipeline) asks for more than two bits tell: documents are similar when the sets of their
five-word shingles have a Jaccard similarity of 0.8 or more. First candidates are the links of the same self-join of tries, over fingerprints of these
shingles, and those that lie side by side in the buckets of a few bands of min-hashes, which connects most of a large group; then every bucket of any band in
which several components meet is compared across these, in units of bounded size, however large it is. A sketch of the min-hashes rules out pairs that are far from the threshold (of those at it, two in ten million);
all others are verified by the shingles themselves, and verified pairs make components as above. Where a unit has more such pairs than rows (a group of copies about as far apart as the
threshold), the pairs are not written: the unit's shingles come to it instead, and it gives back links that connect what all of its similar pairs do.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other; a text of one or two words
is one shingle; equal texts share a fingerprint and hence a component; a null doc_id is never a component's name unless
no document of the component has one (then it is null); every row is returned, repeated ones too; extra columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgrid.session import stage

ROTATIONS = (0, 22, 43)  # the bit at which each trie starts
BLOCKS = (22, 21, 21)  # bits of its first block
BUDGET = 2
UNIT = 4096  # fingerprints of one side of a unit, at most
STRIDE = 4  # bits by which larger units are split
CHUNK = 1 << 16  # shingles counted at a time
SHINGLE, SIMILAR = 5, 0.8  # of the stage that keeps one of similar documents
BANDS, ROWS = 30, 5  # min-hash bands: of pairs at the threshold 7 in a million share none
AGREE = 95  # of the 150 bytes of two sketches; a pair at the threshold agrees in 120 with a deviation of 4.9
FIRST = 6  # bands whose neighbours are compared first
BLOCK = 1024  # rows of one side of a unit in which a bucket is compared across roots
BLOCK_MARKS = 1 << 20  # shingles of these rows, at most, but for those of one text
FOUND = "u long, v long, band int, value long, i int, j int, side int, root long"  # a pair u, v, or a row u of a unit that has more pairs than rows
TEXTS = 256  # texts cut into shingles before these are handed on
FEW_KEYS = 1 << 20  # keys that are sent to the rows instead of shuffling these


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' hashes, unsigned."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    count = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        hashes = np.array([digest(b" ".join(words[i : i + size]), seed) for i in range(at, min(at + CHUNK, count))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, "doc_id long, fp long")


def traverse(values: np.ndarray, pairs: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked values of all start pairs. `values`: sorted within every node; `pairs`: the bounds of
    the two nodes (low, high, low, high) and the budget left. A node is a range of values with equal leading bits."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alo, ahi, blo, bhi, left = pairs
    for bit in range(63 - depth, -1, -1):
        single = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if single.any():  # two leaves: what is left of their bits is compared at once
            rest = np.uint64((1 << (bit + 1)) - 1)
            differ = np.bitwise_count((values[alo[single]] ^ values[blo[single]]) & rest)
            near = differ <= left[single]
            found.append((alo[single][near], blo[single][near]))
            alo, ahi, blo, bhi, left = (x[~single] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        children = [
            (alo, amid, blo, bmid, left, np.ones_like(same)),
            (amid, ahi, bmid, bhi, left, np.ones_like(same)),
            (alo, amid, bmid, bhi, left - 1, np.ones_like(same)),
            (amid, ahi, blo, bmid, left - 1, ~same),  # of a node with itself, the mirror image of the one before
        ]
        alo, ahi, blo, bhi, left, use = (np.concatenate(x) for x in zip(*children))
        use &= (left >= 0) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, left = (x[use] for x in (alo, ahi, blo, bhi, left))
    else:
        found.append((alo, blo))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each position is connected with."""
    label = np.arange(size)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least)  # roots follow their members
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the units of a batch; columns rotation, depth, left, cross, side0, side1."""
    for batch in batches:
        rotation, depth = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for r, d in sorted(set(zip(rotation.tolist(), depth.tolist()))):
            part = batch.filter(pa.array((rotation == r) & (depth == d)))
            left = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cross = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
            nodes, values, at = [], [], 0
            for side in (4, 5):
                lists = part.column(side)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                group = np.repeat(np.arange(len(size)), size)
                values.append(flat[np.lexsort((flat, group))])
                high = at + np.cumsum(size)
                nodes.append((high - size, high))
                at += len(flat)
            values = np.concatenate(values)
            blo, bhi = (np.where(cross, nodes[1][i], nodes[0][i]) for i in (0, 1))
            a, b = traverse(values, [nodes[0][0], nodes[0][1], blo, bhi, left], d)
            turn = np.uint64(ROTATIONS[r])
            whole = values if r == 0 else (values >> turn) | (values << (np.uint64(64) - turn))
            whole, index = np.unique(whole.view(np.int64), return_inverse=True)
            root = forest(len(whole), index[a], index[b])
            linked = np.flatnonzero(root != np.arange(len(root)))
            out.append((whole[linked], whole[root[linked]]))
        u, v = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


UNIT_KEY = ["rotation", "a", "b", "depth", "left"]


def _rotated(fp: Column, turn: int) -> Column:
    return fp if turn == 0 else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))


def _split(members: DataFrame) -> DataFrame:
    """Members of the pairs of children of their units, one row for each child on the other side within the budget."""
    digit = F.expr(f"cast(shiftrightunsigned(shiftleft(v, depth), {64 - STRIDE}) as int)")
    other = F.explode(F.sequence(F.lit(0), F.lit((1 << STRIDE) - 1)))
    wide = members.withColumn("digit", digit).withColumn("other", other)
    wide = wide.withColumn("spent", F.bit_count(F.col("digit").bitwiseXOR(F.col("other")))).where("spent <= left")
    same, first = F.col("a") == F.col("b"), F.col("side") == 0
    low = F.when(same, F.least("digit", "other")).when(first, F.col("digit")).otherwise(F.col("other"))
    high = F.when(same, F.greatest("digit", "other")).when(first, F.col("other")).otherwise(F.col("digit"))
    below = lambda node, child: F.shiftleft(node, STRIDE).bitwiseOR(child.cast("long"))
    return wide.select(
        "rotation", below(F.col("a"), low).alias("a"), below(F.col("b"), high).alias("b"), (F.col("depth") + STRIDE).alias("depth"),
        (F.col("left") - F.col("spent")).cast("int").alias("left"),
        F.when(same & (F.col("digit") > F.col("other")), 1).when(same, 0).otherwise(F.col("side")).alias("side"), "v",
    )


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy(*UNIT_KEY).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))


def link(distinct: DataFrame, unit: int = UNIT) -> DataFrame:
    """Edges u, v between fingerprints (column fp, distinct) that connect all that differ in two bits or fewer."""
    choices = [F.struct(F.lit(i).alias("rotation"), _rotated(F.col("fp"), turn).alias("v"), F.lit(bits).alias("depth")) for i, (turn, bits) in enumerate(zip(ROTATIONS, BLOCKS))]
    members = distinct.select(F.explode(F.array(*choices)).alias("m")).select("m.*")
    block = F.shiftrightunsigned("v", 64 - min(BLOCKS))
    block = F.when(F.col("depth") == max(BLOCKS), F.shiftrightunsigned("v", 64 - max(BLOCKS))).otherwise(block)
    members = members.select("rotation", block.alias("a"), block.alias("b"), "depth", F.lit(BUDGET).alias("left"), F.lit(0).alias("side"), "v")
    ready: list[DataFrame] = []
    while True:
        sizes = _sizes(members)
        large = sizes.where((F.col("n0") > unit) | (F.col("n1") > unit))
        if large.limit(1).count() == 0:
            ready.append(members)
            break
        marked = members.join(sizes.withColumn("large", (F.col("n0") > unit) | (F.col("n1") > unit)), UNIT_KEY)
        useful = F.when(F.col("a") == F.col("b"), F.col("n0") > 1).otherwise((F.col("n0") > 0) & (F.col("n1") > 0))
        marked = stage(marked.where(useful).select(*members.columns, "large"), "trie-units")
        ready.append(marked.where("not large").drop("large"))
        members = _split(marked.where("large").drop("large"))
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    units = rows.groupBy(*UNIT_KEY).agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("v"))).alias("side0"), F.collect_list(F.when(F.col("side") == 1, F.col("v"))).alias("side1"))
    cross = F.col("a") != F.col("b")
    units = units.where(F.when(cross, (F.size("side0") > 0) & (F.size("side1") > 0)).otherwise(F.size("side0") > 1))
    units = units.select("rotation", "depth", "left", cross.alias("cross"), "side0", "side1")
    return units.mapInArrow(_link_units, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component of every node of an edge (u, v)."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id reachable)."""
    marks = stage(fingerprints(docs), "fingerprints")
    classes = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(link(classes.select("fp"), unit))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(named, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; of a shorter text the one of all its words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + size]), 7) for i in range(len(words) - size + 1 if words else 0)], np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct ones of these hashes, sorted."""
    return np.unique(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, the text's among them, but of maps, which have none."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def let_go() -> None:
    """A Python worker that did other stages' tasks before drops what these keep between tasks, and returns the memory to the system."""
    dropped = 0
    for name, kept in (("langtags", "_MEMOS"), ("pieces", "_ENCODERS")):
        if module := sys.modules.get(f"panelgrid.llm.{name}"):
            dropped += len(getattr(module, kept))
            getattr(module, kept).clear()
    if dropped:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # free blocks of the C library stay with the process otherwise
            trim(0)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of all columns), node (the text's words as a hash), fp (the fingerprint of its shingles), the hash of each of `BANDS` bands of min-hashes, the
    sketch (the last byte of every min-hash) and the number of distinct shingles of every document; without words the sketch is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rng = np.random.default_rng(11)
        factor, shift = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(2))
        factor = factor * np.uint64(2) + np.uint64(1)
        weight = rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            node, mark, sketch, size, bands = [], [], [], [], np.zeros((batch.num_rows, BANDS), np.uint64)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                node.append(xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "replace").lower().split()) if text else b"", 5))
                hashes = shingle_hashes(text)
                marks = np.unique(hashes)
                mark.append(majority(hashes))
                sketch.append(b"")
                size.append(len(marks))
                if not len(marks):
                    continue
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
                for at in range(0, len(marks), 1024):
                    mixed = marks[at : at + 1024, None] * factor + shift
                    least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * factor).min(0))
                least ^= least >> np.uint64(32)
                sketch[-1] = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()
                bands[i] = (least.reshape(BANDS, ROWS) * weight).sum(1, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            marked = [batch.column(0), batch.column(2), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, mark)), lists, pa.array(sketch, pa.binary()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(marked, names=["doc_id", "row", "node", "fp", "bands", "sketch", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash(docs).alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, fp long, bands array<long>, sketch binary, size long")


def sketches_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of sketches agree in `AGREE` places at least."""
    return (a == b).sum(-1) >= AGREE


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def in_tries(nodes: DataFrame, unit: int = UNIT) -> DataFrame:
    """Pairs u < v of nodes (node, fp, sketch): those with equal fingerprints, by the least node of each, and the links of the self-join of tries."""
    classes = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "classes")
    same = nodes.join(classes, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    first, second = (classes.select(F.col("fp").alias(k), F.col("first").alias(f"n{k}")) for k in "uv")
    links = link(classes.select("fp"), unit).distinct().join(first, "u").join(second, "v").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
    return estimated(same.unionByName(links).distinct(), nodes)


def neighbours(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of nodes (node, bands, sketch) that follow one another in a bucket of one of the first `FIRST` bands, in the order of the
    next bands, so that the likest lie side by side. Buckets are cut between tasks, and pairs grow with the nodes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            band, value, node = ([np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, x in zip((0, 1, 4), last)])
            at = np.flatnonzero((band[1:] == band[:-1]) & (value[1:] == value[:-1]) & (node[1:] != node[:-1]))
            last = [x[-1:] for x in (band, value, node)]
            u, v = node[at], node[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    after = lambda n: F.expr(f"bands[(band + {n}) % {BANDS}]")
    rows = nodes.select("node", "bands", F.posexplode(F.slice("bands", 1, FIRST)).alias("band", "value")).select("band", "value", after(1).alias("next"), after(2).alias("over"), "node")
    order = ["band", "value", "next", "over", "node"]
    pairs = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "u long, v long").distinct()
    return estimated(pairs, nodes)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs u, v whose nodes' sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["u", "v"]).filter(pa.array(sketches_near(_matrix(batch.column(2)), _matrix(batch.column(3)))))

    first, second = (nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}")) for k in "uv")
    return pairs.join(first, "u").join(second, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def across_roots(nodes: DataFrame, block: int) -> DataFrame:
    """All pairs u < v of nodes (node, root, bands, sketch, size) with an equal band, different roots and near sketches, as `FOUND`.

    Only buckets that hold several roots are looked at. Of these the members outside the bucket's most frequent root
    are compared with all members, in units of at most about `block` rows a side, and a unit gives back the near ones only: its
    pairs, or if these are more than its rows, the rows that have one.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, node, root = (rows.column(c).to_numpy() for c in ("side", "node", "root"))
        sketch = _matrix(rows.column("sketch").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))
        few, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for i in few:
            near = every[sketches_near(sketch[every], sketch[i])]
            near = near[root[near] != root[i]]
            found.append((np.full(len(near), i), near))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        known, place = np.unique(node, return_inverse=True)
        pairs = np.unique(np.minimum(place[a], place[b]) * len(known) + np.maximum(place[a], place[b]))
        if len(pairs) <= rows.num_rows:
            columns = [known[pairs // max(len(known), 1)], known[pairs % max(len(known), 1)]]
        else:
            used = np.unique(np.concatenate([a, b]))
            columns = [node[used], None, *(np.full(len(used), k.as_py()) for k in key), side[used], root[used]]
        columns += [None] * (len(names) - len(columns))
        return pa.Table.from_arrays([pa.nulls(len(columns[0]), t) if c is None else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names, types = zip(*((f.split()[0], pa.int64() if f.endswith("long") else pa.int32()) for f in FOUND.split(", ")))
    keys = ["band", "value"]
    rows = nodes.select("node", "root", "size", F.posexplode("bands").alias("band", "value"))
    counts = [F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("marks")]
    mixed = stage(rows.groupBy(*keys).agg(*counts).where("low < high").select(*keys, "n", "marks"), "mixed-buckets")
    members = stage(rows.drop("size").join(mixed, keys).join(nodes.select("node", "sketch"), "node"), "members")
    main = members.groupBy(*keys, "root").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    parts = F.ceil(F.greatest(F.col("n") / block, F.least(F.col("marks") / BLOCK_MARKS, F.col("n")))).cast("int")
    members = members.join(main, keys).withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")})
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    few = members.where("root != main").select(*keys, F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "node", "root", "sketch")
    used = few.select(*keys, "i").distinct()
    every = members.select(*keys, F.col("own").alias("j"), F.lit(1).alias("side"), "node", "root", "sketch").join(used, keys).select(*few.columns)
    return few.unionByName(every).groupBy(*keys, "i", "j").applyInArrow(run, FOUND).distinct()


def of_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows (doc_id, __row and others) joined with keys (doc_id, row and others), where a null id equals another. The keys are
    counted first: up to `FEW_KEYS` (16 bytes each) they go to the rows, beyond that both are shuffled."""
    keys = stage(keys.withColumnsRenamed({"doc_id": "__of_id", "row": "__of_row"}), "keys")
    keys = keys.hint("broadcast" if keys.count() <= FEW_KEYS else "merge")
    return rows.join(keys, (F.col("__row") == F.col("__of_row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__of_id")), how)


def shingle_sets(wanted: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """node and marks (its shingles) of the wanted nodes. `marks`: doc_id, row and node of the documents; only texts of these nodes are read on."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "marks"])

    first = marks.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("row", "doc_id")).alias("x")).select("node", "x.row", "x.doc_id")
    texts = of_keys(docs.select("doc_id", row_hash(docs).alias("__row"), "text"), first, "inner").select("node", "text")
    sets = texts.mapInArrow(mark, "node long, marks array<long>").groupBy("node").agg(F.any_value("marks").alias("marks"))
    return stage(sets, "shingles")


def verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those pairs u, v whose texts are alike. `marks`: doc_id, row and node of the documents."""
    sets = shingle_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, marks)
    left, right = (sets.select(F.col("node").alias(k), F.col("marks").alias(f"m{k}")) for k in "uv")
    both = F.size(F.array_intersect("mu", "mv"))
    rows = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("both"), (F.size("mu") + F.size("mv") - both).alias("all"))
    return rows.where(F.col("both") >= F.col("all") * SIMILAR).select("u", "v")


def in_crowds(rows: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges u, v between similar nodes that connect all similar pairs of different roots in each unit of rows (`FOUND`), fewer than the rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, node, root = (rows.column(c).to_numpy() for c in ("side", "node", "root"))
        lists = rows.column("marks").combine_chunks()
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]  # shingles by their place
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(size)
        few, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        against = np.concatenate([flat[ends[j] - size[j] : ends[j]] for j in every]) if len(every) else flat[:0]
        starts = np.cumsum(size[every]) - size[every]
        held, found = np.zeros(flat.max() + 1 if len(flat) else 0, np.int32), []
        for i in few if len(every) else ():
            own = flat[ends[i] - size[i] : ends[i]]
            held[own] = 1
            both = np.add.reduceat(held[against], starts)
            held[own] = 0
            near = every[(both >= (size[i] + size[every] - both) * SIMILAR) & (root[every] != root[i])]
            found.append((np.full(len(near), i), near))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        known, place = np.unique(node, return_inverse=True)
        least = forest(len(known), place[a], place[b])
        linked = np.flatnonzero(least != np.arange(len(known)))
        return pa.table({"u": pa.array(known[least[linked]]), "v": pa.array(known[linked])})

    rows = rows.withColumnRenamed("u", "node").drop("v")
    sets = shingle_sets(rows.select("node").distinct(), docs, marks)
    return rows.join(sets, "node").groupBy("band", "value", "i", "j").applyInArrow(run, "u long, v long").distinct()


def similar_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, row (its hash), node (equal for equal words) and root (equal for all that similar pairs connect).

    Links of the tries and neighbours connect most of a large group first; then every bucket that still holds several roots is compared across them.
    """
    marks = stage(signatures(docs), "signatures")
    nodes = stage(marks.where(F.octet_length("sketch") > 0).groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("size").alias("size")), "nodes")
    marks = marks.select("doc_id", "row", "node")
    edges = stage(verified(stage(in_tries(nodes).unionByName(neighbours(nodes)).distinct(), "candidates"), docs, marks), "similar")
    roots = components(edges)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = stage(across_roots(rooted, block).to(T.StructType.fromDDL(FOUND)), "candidates")
    pairs, crowds = found.where("v is not null").select("u", "v"), found.where("v is null")
    edges = edges.unionByName(stage(verified(pairs, docs, marks), "similar"))
    if crowds.limit(1).count():
        edges = edges.unionByName(stage(in_crowds(crowds, docs, marks), "similar"))
    roots = components(edges)
    return marks.join(roots, "node", "left").select("doc_id", "row", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group of similar documents: of the least id (null comes last), then of the least hash of its row.

    Texts stay where they are but for a group whose kept row is repeated: the keys of the rows that go are joined to them.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    groups = stage(similar_groups(docs), "groups")
    kept = groups.groupBy("root").agg(least).select("least.doc_id", "least.row")
    same = groups.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    marked = stage(same.join(kept.withColumn("kept", F.lit(True)), same["row"].eqNullSafe(kept["row"]) & same["doc_id"].eqNullSafe(kept["doc_id"]), "left")
                   .select(same["doc_id"], same["row"], "n", F.col("kept").isNotNull().alias("kept")), "kept")
    rows = docs.withColumn("__row", row_hash(docs))
    goes, repeated = (marked.where(x).select("doc_id", "row") for x in ("not kept or n > 1", "kept and n > 1"))
    out = of_keys(rows, goes, "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return out
    once = of_keys(rows, repeated, "left_semi").dropDuplicates(["doc_id", "__row"])
    return out.unionByName(once.select(*docs.columns))

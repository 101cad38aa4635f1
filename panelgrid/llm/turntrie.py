"""Conversations as a prefix trie, in double arrays for each shard.

A turn is known by a digest of its role and text, so that texts are read once and never shuffled. The conversations of one
base meet in one task, sorted, and are rebuilt as they stream by; a conversation leaves as paths of `PATH` turns at most, each under
the key of the prefix before it (a chained digest). Equal paths are added up before they are shuffled. Paths are then dealt by
ranges of their order, so that a shard holds neighbours whatever many begin alike, and a task takes `SHARD` turns at a time:

* the turns of a shard get dense ids, and its paths become a trie in two arrays: the child of state s by turn id t is BASE[s] + t,
  if CHECK of it is s. Places for the children of a state are sought from the first free one on;
* every path is traversed through the arrays and adds its conversations to the states that it visits;
* states become rows (prefix key, parent's key, conversations, smallest member), and prefixes that several shards share, mostly
  upper ones, are merged by their key.

What is summed over subtrees needs no walk up the whole trie: a node belongs to its smallest member, and the nodes of one conversation are the
end of its path, the chain. A node's sum is that of its own chain from there on, and of all chains that begin below. So chains' sums are
sent down a second traversal of the same tries, as far as each path is not its own, and merged like the first.

The ids of conversations that end at one node may be a third of all. They are sorted by ranges over all tasks, joined into pieces of `PIECE`
ids, and only these stream through the digest of their node in order.

Defined cases: null role and text are empty; turns are ordered by turn (null first), those with an equal turn by digest, and repeated rows are
turns of their own; rows without conv_id take no part; conv_id % 100 keeps the sign of conv_id, so the base of -150 is -100; a
conversation may have any number of turns; extra columns are not read; an empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.session import stage

SPAN, HEADS = 100, 6  # conversations of a base, and of how many turns heads are chosen
PATH = 64  # turns of a path, at most
SHARD = 100_000  # turns of the tries that are built together
PIECE = 4096  # ids joined before they are dealt by node
WIDTH = 16  # bytes of a digest
ROOT = bytes(WIDTH)  # key of the empty prefix
TRIES = 64  # places tried for the children of a state before they go behind all others


def read_turns(rows: DataFrame) -> DataFrame:
    """conv_id, base, turn, code (digest of role and text) and chars of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    conv = F.col("conv_id").cast("long")
    rows = rows.select(conv.alias("conv_id"), "turn", F.unhex(F.left(code, F.lit(2 * WIDTH))).alias("code"), F.length(text).alias("chars"))
    return rows.where("conv_id is not null").withColumn("base", F.col("conv_id") - F.col("conv_id") % SPAN)


def extended(prefix: bytes, code: bytes) -> bytes:
    """Key of a prefix with one more turn."""
    return hashlib.sha256(prefix + code).digest()[:WIDTH]


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, start, prefix (key of the turns before the path), codes (joined), chars (32 bits each), key (with the path) and last.

    The first h turns of a conversation are those of its base, h = crc32(conv_id) % HEADS; its own follow after its first h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base = conv = None
        heads: list[tuple[bytes, int]] = []
        state: list = []  # start, prefix, key, codes, chars of the open path
        seen = skip = 0

        def add(code: bytes, chars: int) -> None:
            if len(state[3]) == PATH:
                close(False)
            state[2] = extended(state[2], code)
            state[3].append(code)
            state[4].append(chars)

        def close(last: bool) -> None:
            start, prefix, key, codes, chars = state
            out.append((conv, start, prefix, b"".join(codes), np.array(chars, "<i4").tobytes(), key, last))
            state[:] = [start + len(codes), key, key, [], []]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "start", "prefix", "codes", "chars", "key", "last"])

        for batch in batches:
            for b, c, code, chars in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv:
                    if conv is not None:
                        close(True)
                    if b != base:
                        base, heads = b, []
                    conv, seen = c, 0
                    skip = zlib.crc32(str(c).encode()) % HEADS
                    state = [0, ROOT, ROOT, [], []]
                    if c != b:
                        for head in heads[:skip]:
                            add(*head)
                if c == b:
                    if len(heads) < HEADS - 1:
                        heads.append((code, chars))
                    add(code, chars)
                elif seen >= skip:
                    add(code, chars)
                seen += 1
                if len(out) >= 4096:
                    yield batch_of(out)
                    out.clear()
        if conv is not None:
            close(True)
            yield batch_of(out)

    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.asc_nulls_first("turn"), F.col("code")]
    dealt = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "code", "chars")
    return dealt.mapInArrow(run, "conv_id long, start long, prefix binary, codes binary, chars binary, key binary, last boolean")


class DoubleArray:
    """A trie of paths of dense ids in two arrays. State 0 is above all; a path begins with the id of its prefix."""

    def __init__(self, paths: list[list[int]], ids: int):
        self.base, self.check = np.zeros(2 * ids + 2, np.int64), np.full(2 * ids + 2, -1, np.int64)
        self.check[0] = 0
        self._free = self._end = 1
        self._pack(paths)

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, symbols: list[int]) -> int:
        """A base (maybe below zero) at which the places of all these (ascending) ids are free."""
        check, first, at = self.check, symbols[0], self._free
        for _ in range(TRIES):
            while at < self._end and check[at] >= 0:
                at += 1
            if all(at - first + s >= self._end or check[at - first + s] < 0 for s in symbols):
                return at - first
            at += 1
        return self._end - first

    def _pack(self, paths: list[list[int]]) -> None:
        """Give the children of each state their places, level by level; `paths` are sorted, so a state's are neighbours."""
        level = [(0, 0, len(paths))] if paths else []
        depth = 0
        while level:
            below = []
            for state, low, high in level:
                children, at = [], low
                while at < high:
                    if len(paths[at]) == depth:
                        at += 1
                        continue
                    symbol, to = paths[at][depth], at + 1
                    while to < high and paths[to][depth] == symbol:
                        to += 1
                    children.append((symbol, at, to))
                    at = to
                if not children:
                    continue
                base = self._place([s for s, _, _ in children])
                self._end = max(self._end, base + children[-1][0] + 1)
                self._room(self._end)
                self.base[state] = base
                for symbol, a, b in children:
                    self.check[base + symbol] = state
                    below.append((base + symbol, a, b))
                while self._free < self._end and self.check[self._free] >= 0:
                    self._free += 1
            level, depth = below, depth + 1

    def walk(self, path: list[int]) -> list[int]:
        """The states that a path visits."""
        state, out = 0, []
        for symbol in path:
            to = int(self.base[state]) + symbol
            if not 0 < to < self._end or self.check[to] != state:
                raise KeyError(symbol)
            out.append(to)
            state = to
        return out


def tries(rows: list[tuple[int, bytes, bytes]]) -> tuple[DoubleArray, list[list[int]], list[tuple[int, bytes]]]:
    """The trie of a shard's paths (start, prefix, codes), the states that each visits, and depth and key of the states' roots, by id."""
    roots = sorted({(start, prefix) for start, prefix, _ in rows})
    ids: dict = {r: i for i, r in enumerate(roots)}
    split = [[codes[i : i + WIDTH] for i in range(0, len(codes), WIDTH)] for _, _, codes in rows]
    for column in zip_longest(*split):  # the children of a state get ids close together
        for code in column:
            if code is not None and code not in ids:
                ids[code] = len(ids)
    paths = [[ids[start, prefix], *map(ids.__getitem__, codes)] for (start, prefix, _), codes in zip(rows, split)]
    trie = DoubleArray(sorted(paths), len(ids))
    return trie, [trie.walk(p) for p in paths], roots


def shards(batches: Iterator[pa.RecordBatch], codes: int, turns: int) -> Iterator[list[tuple]]:
    """Rows of the batches, so many turns at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += 1 + len(row[codes]) // WIDTH
            if size >= turns:
                yield held
                held, size = [], 0
    if held:
        yield held


def by_ranges(paths: DataFrame) -> DataFrame:
    """Paths dealt and sorted by their order, so that those that begin alike are neighbours."""
    return paths.repartitionByRange("start", "prefix", "codes", "key").sortWithinPartitions("start", "prefix", "codes")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """key, parent (its key), depth, chars, n_convs, member (the smallest) and childless of every prefix. `paths`: start, prefix, codes, chars, key, n, member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards(batches, 2, SHARD):
            trie, visited, _ = tries([r[:3] for r in rows])
            size = len(trie.check)
            count, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
            inner = np.zeros(size, bool)
            known: dict[int, tuple[bytes, bytes | None, int, int]] = {}  # key, parent, depth and characters of a state
            for (start, prefix, codes, chars, _, n, member), states in zip(rows, visited):
                at = np.array(states)
                count[at] += n
                least[at] = np.minimum(least[at], member)
                inner[at[:-1]] = True
                if states[0] not in known:
                    known[states[0]] = (prefix, None, start, 0)
                sizes = np.frombuffer(chars, "<i4")
                for i, state in enumerate(states[1:]):
                    if state not in known:
                        above = known[states[i]][0]
                        known[state] = (extended(above, codes[i * WIDTH : (i + 1) * WIDTH]), above, start + i + 1, int(sizes[i]))
            # a root that is no empty prefix is the last state of other paths, and counted there
            kept = [s for s, (_, parent, depth, _) in known.items() if parent is not None or depth == 0 or inner[s]]
            own = np.array([known[s][1] is not None or known[s][2] == 0 for s in kept], bool)
            columns = list(zip(*(known[s] for s in kept)))
            at = np.array(kept)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))), pa.array(np.where(own, count[at], 0)), pa.array(least[at]), pa.array(~inner[at])],
                names=["key", "parent", "depth", "chars", "n", "member", "childless"])

    rows = by_ranges(paths.select("start", "prefix", "codes", "chars", "key", "n", "member"))
    rows = rows.mapInArrow(run, "key binary, parent binary, depth long, chars long, n long, member long, childless boolean")
    return rows.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"),
                                   F.min("member").alias("member"), F.min("childless").alias("childless"))


def trie_sums(paths: DataFrame) -> DataFrame:
    """key, below_tokens and below_leaves: sums of the chains that begin under a prefix. `paths`: start, prefix, codes, key, own, tokens, leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards(batches, 2, SHARD):
            trie, visited, roots = tries([r[:3] for r in rows])
            sums = np.zeros((2, len(trie.check)), np.int64)
            keys: dict[int, bytes] = {}
            for (start, prefix, codes, _, own, tokens, leaves), states in zip(rows, visited):
                key = prefix
                for i, state in enumerate(states):
                    if i:
                        key = keys.get(state) or extended(key, codes[(i - 1) * WIDTH : i * WIDTH])
                    if start + i >= own or i == 0 and start:  # of its own chain, or counted by the path before
                        continue
                    keys[state] = key
                    sums[0, state] += tokens
                    sums[1, state] += leaves
            at = np.fromiter(keys, np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(list(keys.values()), pa.binary()), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["key", "below_tokens", "below_leaves"])

    rows = by_ranges(paths.select("start", "prefix", "codes", "key", "own", "tokens", "leaves"))
    rows = rows.mapInArrow(run, "key binary, below_tokens long, below_leaves long")
    return rows.groupBy("key").agg(F.sum("below_tokens").alias("below_tokens"), F.sum("below_leaves").alias("below_leaves"))


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 (of the ids joined by commas, ascending) of rows (key, conv_id)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, ids, out = None, 0, [], []

        def close() -> None:
            if ids:
                out.append((held, first, ",".join(map(str, ids))))
                ids.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])
            out.clear()
            return made

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != held or len(ids) == PIECE:
                    close()
                    held, first = key, conv
                ids.append(conv)
                if len(out) >= 1024:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != held:
                    if held is not None:
                        out.append((held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([k for k, _ in out], [d for _, d in out])], names=["key", "ends_sha256"])
                out = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    sort = ["key", "conv_id"]
    pieces = ends.select(*sort).repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(join, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    paths = stage(rebuilt_paths(read_turns(conversations)), "paths")
    distinct = paths.groupBy("key").agg(*(F.first(c).alias(c) for c in ("start", "prefix", "codes", "chars")), F.count("*").alias("n"), F.min("conv_id").alias("member"))
    nodes = stage(trie_nodes(distinct), "nodes")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    chains = nodes.groupBy("member").agg(F.min("depth").alias("own"), F.sum(saved).alias("tokens"), F.sum(F.col("childless").cast("long")).alias("leaves"))
    chains = stage(chains, "chains")
    sent = paths.join(chains.where("own > 0"), paths["conv_id"] == chains["member"]).where("start < own")
    sums = trie_sums(sent.select("start", "prefix", "codes", "key", "own", "tokens", "leaves"))
    rest = Window.partitionBy("member").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.withColumn("tokens", F.sum(saved).over(rest)).withColumn("leaves", F.sum(F.col("childless").cast("long")).over(rest))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("member").alias("parent_conv_id"))
    out = own.join(parents, "parent", "left").join(children, "key", "left").join(sums, "key", "left").join(end_digests(paths.where("last")), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("member").alias("conv_id"), "depth", "parent_conv_id", "n_convs", zero("n_children").alias("n_children"),
        (F.col("leaves") + zero("below_leaves")).alias("n_leaves"), (F.col("tokens") + zero("below_tokens")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


ORACLE = f"""
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    [coalesce(role, ''), coalesce(text, '')] AS t FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {SPAN} AS base, list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM o WHERE pos = 1),
h AS (SELECT conv_id, base, xor(crc, 4294967295) % {HEADS} AS h FROM c),
r AS (SELECT h.conv_id, o.pos, o.t FROM h JOIN o ON o.conv_id = h.base AND o.pos <= h.h
    UNION ALL SELECT h.conv_id, o.pos, o.t FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
p AS (SELECT h.conv_id, coalesce(list(r.t ORDER BY r.pos) FILTER (WHERE r.t IS NOT NULL), []) AS path FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
m AS (SELECT conv_id, len(path) AS n, depth, CAST(list_slice(path, 1, depth) AS VARCHAR) AS k, CAST(list_slice(path, 1, depth - 1) AS VARCHAR) AS up,
    CASE WHEN depth = 0 THEN 0 ELSE length(path[depth][2]) END AS chars FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM p)),
n AS (SELECT k, depth, CASE WHEN depth > 0 THEN any_value(up) END AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM m GROUP BY k, depth),
w AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.up = n.k AND c.depth = n.depth + 1) AS n_children FROM n LEFT JOIN n u ON u.k = n.up AND u.depth = n.depth - 1),
s AS (SELECT a.k, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
    FROM m y JOIN w a ON a.k = y.k AND a.depth = y.depth JOIN m x ON x.conv_id = y.conv_id AND x.depth >= y.depth JOIN w b ON b.k = x.k AND b.depth = x.depth AND b.conv_id = x.conv_id
    GROUP BY a.k, a.depth)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, w.parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.k = w.k AND s.depth = w.depth
"""

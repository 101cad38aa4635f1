"""Audit of how the sources of a language differ in their terms, by sorting pointers to the starts of terms.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased. The texts of an Arrow batch lie
in one buffer. A slice of it (a shard of whole documents, `SLICE_BYTES` or one longer text) is not cut into strings: the places where a term starts
become pointers, and these are sorted by multikey quicksort, whose key is the next eight bytes at the pointers. A
part is split around a pivot into less, equal and greater; equal ones go on eight bytes deeper until the term ends. Terms are
padded with zero bytes, which no term holds. The pointers that end equal are a run: one term. Its pointers' documents give the
term's occurrences and documents in each (lang, source) of the slice.

Slices send one row for each term and group, and tasks add up their own before the shuffle. Each language keeps the terms in `LEAST` documents at least. From
there on the work is on kept terms only. Shares are exact whole numbers, p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)).

Differences of sources are sums over blocks of terms: a task holds the shares of a block of terms in two tiles of sources as
a matrix, and gives the sums for the pairs of these sources and the number of terms it had. All other terms, which neither
tile has, add the same known difference each. A tile has about `TILE` sources, so neither many sources nor many terms meet in one task.

Defined cases: null text, lang and source are read as empty, and are groups like others; a group without terms has the
share of unseen terms; a language without kept terms has differences of zero and no terms; repeated rows count each; no
documents give no row; extra columns are not read. Results have one row for each ordered pair of a language's sources, as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.session import stage

LEAST = 30  # documents of a language that hold a kept term
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50  # terms of a report
SLICE_BYTES = 4 << 20  # of text whose pointers are sorted together
SMALL = 1 << 15  # pointers of a part that is ordered at once
TERMS, TILE = 2048, 256  # terms of a block and sources of a tile

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)  # of the first n of eight bytes


def pointers(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every term of the texts between the offsets; no term reaches over two texts."""
    letter = LETTER[buffer]
    before = np.empty_like(letter)
    before[:1], before[1:] = False, letter[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(buffer))]
    before[edges] = False
    start = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[-1:], after[:-1] = False, letter[1:]
    after[edges - 1] = False
    stop = np.flatnonzero(letter & ~after) + 1
    return start, stop - start, np.searchsorted(offsets, start, "right") - 1


def sort_pointers(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and the run (from 0) that each of them, so ordered, belongs to.

    `words`: at each place of the buffer, the next eight bytes as a number.
    """
    order, first = np.arange(len(start)), np.zeros(len(start), bool)

    def keys(part: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[part] - depth, 0, 8)
        at = np.minimum(start[part] + depth, len(words) - 1)
        return words[at].astype(np.uint64) & MASK[left]

    todo = [(0, len(start), 0)] if len(start) else []
    while todo:
        low, high, depth = todo.pop()
        part = order[low:high]
        key = keys(part, depth)
        if high - low > SMALL:  # three parts around the median of nine
            pivot = np.sort(key[np.linspace(0, len(key) - 1, 9).astype(int)])[4]
            less, more = key < pivot, key > pivot
            same = ~(less | more)
            order[low:high] = np.concatenate([part[less], part[same], part[more]])
            a, b = low + np.count_nonzero(less), high - np.count_nonzero(more)
            if a > low:
                todo.append((low, a, depth))
            if high > b:
                todo.append((b, high, depth))
            if pivot & np.uint64(0xFF):
                todo.append((a, b, depth + 8))
            else:
                first[a] = True
            continue
        at, run = np.arange(low, high), np.zeros(high - low, np.int64)
        while len(at):  # a small part at once: all its runs, eight bytes deeper each time
            by = np.lexsort((key, run))
            order[at], key, run = order[at[by]], key[by], run[by]
            cut = np.concatenate([[True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])])
            first[at[cut]] = True
            run = np.cumsum(cut)
            more = (np.bincount(run)[run] > 1) & ((key & np.uint64(0xFF)) != 0)
            at, run, depth = at[more], run[more], depth + 8
            key = keys(order[at], depth)
    return order, np.cumsum(first) - 1


def slice_counts(buffer: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents of every term and group of a slice. `group`: of each document, from 0."""
    buffer = LOWER[buffer]
    place = np.argsort(group, kind="stable")  # documents in the order of groups, so that those of a group are neighbours
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    start, length, document = pointers(buffer, offsets)
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buffer), ">u8", padded, strides=(1,))
    order, run = sort_pointers(words, start, length)
    both, times = np.unique(run * len(place) + rank[document[order]], return_counts=True)
    run_of, group_of = both // len(place), group[place[both % len(place)]]
    first = np.flatnonzero(np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1])]))
    count, documents = np.add.reduceat(times, first), np.diff(np.append(first, len(both)))
    leader = order[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))]
    size = length[leader]
    ends = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(start[leader] - ends[:-1], size) + np.arange(ends[-1])
    terms = pa.StringArray.from_buffers(len(leader), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buffer[source]))
    return terms.take(pa.array(run_of[first])), group_of[first], count, documents


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of each slice of documents (text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(0)
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + batch.num_rows + 1].astype(np.int64)
            data = text.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            names = pa.StructArray.from_arrays(batch.columns[1:], names=["lang", "source"]).to_pandas()
            code, groups = pd.factorize(names.map(lambda x: (x["lang"], x["source"])))
            lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
                term, group, n, documents = slice_counts(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], code[at:to])
                group = pa.array(group)
                yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), term, pa.array(n), pa.array(documents)], names=["lang", "source", "term", "n", "docs"])
                at = to

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def read_groups(docs: DataFrame) -> DataFrame:
    """text, lang and source, nulls read as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def kept_counts(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n and all (occurrences in the language) of the kept terms of each group that has them."""
    sums = count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"all": F.sum("n").over(same), "held": F.sum("docs").over(same)})
    return stage(sums.where(F.col("held") >= least).select("lang", "source", "term", "n", "all"), "terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in units of 1 / SCALE, exact for any counts; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = F.nullif((total + terms * PRIOR).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", above, below) + 1


def group_totals(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), lang_total and terms (V) of every group of the documents."""
    groups = rows.select("lang", "source", F.lit(0).alias("n")).unionByName(kept.select("lang", "source", "n"))
    groups = groups.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    groups = groups.join(terms, "lang", "left")
    return groups.select("lang", "source", "total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total")))


def tile_sums(marks: DataFrame) -> DataFrame:
    """lang, a, b, near (sum of differences over the terms of the block that the tiles have) and seen (number of those) for sources a < b.

    `marks`: lang, block, low, high (tiles), tile, source, unseen (share of a term that it has not), term, p; a source without a
    term has a row with a null one.
    """

    def run(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[0].as_py()
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        source = rows.column("source").combine_chunks().dictionary_encode()
        term = rows.column("term").combine_chunks().dictionary_encode()
        s = source.indices.to_numpy(zero_copy_only=False)
        has = ~np.asarray(term.is_null())
        t = term.indices.fill_null(0).to_numpy(zero_copy_only=False)
        names, width = source.dictionary.to_pylist(), len(term.dictionary)
        unseen, tile = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        unseen[s] = rows.column("unseen").to_numpy()
        tile[s] = rows.column("tile").to_numpy()
        p = np.repeat(unseen[:, None], width, 1)
        p[s[has], t[has]] = rows.column("p").to_numpy()[has].astype(np.int64)
        left, right, sums = [], [], []
        own, other = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        for i in own:
            with_ = other if low != high else other[other > i]
            left += [names[i]] * len(with_)
            right += [names[j] for j in with_]
            for k in range(0, len(with_), 32):  # a bounded part of the differences at a time
                sums.append(np.abs(p[with_[k : k + 32]] - p[i]).sum(1))
        near = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        swap = [a > b for a, b in zip(left, right)]
        a, b = ([y if w else x for x, y, w in zip(*xs, swap)] for xs in ((left, right), (right, left)))
        n = len(near)
        return pa.table([pa.array([lang] * n, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(near), pa.array(np.full(n, width))], names=["lang", "a", "b", "near", "seen"])

    return marks.groupBy("lang", "block", "low", "high").applyInArrow(run, "lang string, a string, b string, near long, seen long")


def source_differences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, the sum of absolute differences of shares over all kept terms."""
    known = groups.withColumn("unseen", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)))
    sizes = known.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    known = known.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    shares = kept.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = shares.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TERMS)).cast("int"))
    empty = known.withColumns({"term": F.lit(None).cast("string"), "p": F.lit(None).cast("long")})
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("terms") / TERMS).cast("int"), F.lit(1)) - 1))
    columns = ["lang", "block", "tile", "tiles", "source", "unseen", "term", "p"]
    marks = shares.select(*columns).unionByName(empty.withColumn("block", blocks).select(*columns))
    marks = marks.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    marks = marks.select("lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "source", "unseen", "term", "p")
    sums = tile_sums(marks).groupBy("lang", "a", "b").agg(F.sum("near").alias("near"), F.sum("seen").alias("seen"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rest = known.select("lang", "source", "unseen", "terms")
    for k in "ab":
        sums = sums.join(rest.select("lang", F.col("source").alias(k), F.col("unseen").alias(f"u{k}"), "terms" if k == "a" else F.lit(0).alias("_")), ["lang", k]).drop("_")
    value = F.col("near") + F.abs(F.col("ua") - F.col("ub")) * (F.col("terms") - F.col("seen"))
    return sums.withColumn("value", value).select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def leading_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the group has) and value, by how much its share exceeds the language's."""
    rows = kept.join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all"), F.col("lang_total"), F.col("terms"))
    return rows.select("lang", "source", F.col("term").alias("item"), above.alias("value")).where("value > 0")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank (value descending, item ascending) of every group."""
    rows = read_groups(docs)
    kept = kept_counts(rows, least)
    groups = stage(group_totals(rows, kept), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_differences(kept, groups).withColumn("rank", F.row_number().over(ranked))
    terms = leading_terms(kept, groups).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS raw FROM d),
t AS (SELECT lang, source, r, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
k AS (SELECT lang, term, count(*) AS every FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(every) AS m FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR}) // (s.n + {PRIOR} * v.v) AS p,
    1 + CAST({SCALE} AS HUGEINT) * (k.every + {PRIOR}) // (v.m + {PRIOR} * v.v) AS q
  FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY x.lang, x.source, y.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

"""Lexical retrieval over a stored index, whose postings lie in blocks of equal impact.

A posting's impact is what one occurrence list of a term adds to a document's score before the term's weight. The index is three
tables: postings in folders by a hash of the term (`part`) and in buckets of documents, sorted by term and `level` of impact; blocks (one row for a term and level, with
its size and largest impact); and the corpus' numbers. Building it shuffles the texts once, by document; a word in all documents is in all buckets.

A search finds the exact k best documents of each query in four steps, each a join of some blocks with the postings:

1. the blocks that promise most are read until they hold `SEEDS` postings; the documents that lead by these are scored, and the k-th
   score is a lower bound for the query;
2. the terms whose largest possible gains together stay under a share of the bound cannot bring a document in by themselves and are left out, and a block of another term
   too if its largest gain and the most of all other terms stay under the bound. Postings of the blocks that are left
   are added up by document. Those that lead give a second, higher bound;
3. the same under the higher bound; a document stays if its sum and the most of what was left out reach it;
4. these documents are scored with all their terms.

Queries come in blocks of about `TERMS` terms. What a block asks of the postings (its terms, blocks and bounds, and the leading documents of a query) is small and goes to every task, and
sums by document are made in its bucket. So neither postings nor sums are shuffled or written.

So a word that all documents share makes no rows for the pairs of queries and documents that it alone connects. Queries without k documents of a positive score
have no bound, and all their blocks are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.operators.runs import same_as_before, whole_keys
from panelgrid.operators.text import EPSILON, K1, B, postings, token_array
from panelgrid.session import scratch_path, stage

PARTS = 32  # folders of postings by term
TERMS = 1 << 15  # of the queries of a block, about
LEVELS = 20  # of impact
SEEDS = 4000  # postings read for the first lower bound of a query
REST = 0.5  # share of the bound that terms left out at first may bring together
SLACK = 1e-5  # more than rounding can move a score


@dataclass(frozen=True)
class Index:
    """`postings`: part, term, level, doc, gain; `blocks`: term, level, n, top; `corpus`: n, terms' mean idf (one row)."""

    postings: DataFrame
    blocks: DataFrame
    corpus: DataFrame


def part_of(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def impact_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", b: float = B) -> DataFrame:
    """Rows of the index, by buckets of documents: part, term, doc, gain, level.

    The texts are shuffled once, by document; terms are counted where a document's rows lie together, and rows of a document with as many terms add up.
    """
    sized = docs.select(F.col(key).alias("doc"), token_array(text).alias("_t")).withColumn("dl", F.size("_t"))
    average = stage(sized.agg(F.avg("dl").alias("average")), "average").scalar()
    dealt = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text")).repartition(buckets_of(docs), "doc").sortWithinPartitions("doc")
    counted = dealt.select("doc", token_array("_text").alias("_t")).where(F.size("_t") > 0)
    tf = counted.mapInArrow(_occurrences, f"doc {sized.schema['doc'].dataType.simpleString()}, dl int, term string, tf long")
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - b + b * F.col("dl") / average))
    rows = tf.select(part_of("term").alias("part"), "term", "doc", gain.alias("gain"))
    return rows.withColumn("level", F.least(F.floor(F.col("gain") * (LEVELS / (K1 + 1))), F.lit(LEVELS - 1)).cast("int"))


def buckets_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def store_postings(rows: DataFrame) -> str:
    """Write the rows of `impact_postings` to the shared folder, as an external table of the session's catalog. Returns its name."""
    name = f"panelgrid_postings_{uuid.uuid4().hex}"
    out = rows.write.partitionBy("part").bucketBy(buckets_of(rows), "doc").sortBy("term", "level")
    out.option("path", scratch_path(rows.sparkSession, "postings")).format("parquet").saveAsTable(name)
    return name


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, dl, term, tf: the distinct terms of each document, whose rows come one after the other."""
    for table in whole_keys(batches, "doc", 0):
        for part in table.to_batches():  # one, as the table is combined
            doc, tokens = part.column("doc"), part.column("_t")
            flat = tokens.flatten().dictionary_encode()
            dl = pc.list_value_length(tokens).to_numpy()
            new = ~same_as_before(doc)
            row = np.arange(len(doc))
            if not new.all():  # rows of a document with equal length are one
                seen: dict[tuple[int, int], int] = {}
                group = np.cumsum(new)
                row = np.array([seen.setdefault((int(g), int(n)), i) for i, (g, n) in enumerate(zip(group, dl))])
            n = len(flat.dictionary)
            found, tf = np.unique(row[pc.list_parent_indices(tokens).to_numpy()].astype(np.int64) * n + flat.indices.to_numpy(), return_counts=True)
            at = found // n
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array(dl[at], pa.int32()), flat.dictionary.take(pa.array(found % n)), pa.array(tf)], names=["doc", "dl", "term", "tf"])


def impact_blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("gain").alias("top"))


def idf(df: Column, n: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def corpus_numbers(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """n (documents) and mean_idf (over terms), one row."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    frequency = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    mean = frequency.agg(F.avg(idf(F.col("df"), n.scalar())).alias("mean_idf"))
    return n.select("n", mean.scalar().alias("mean_idf"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", b: float = B) -> Index:
    """The index of a table of texts, written to the shared folder."""
    rows = docs.sparkSession.table(store_postings(impact_postings(docs, key, text, b)))
    blocks = stage(impact_blocks(rows), "blocks")
    return Index(rows, blocks, stage(corpus_numbers(docs, blocks), "corpus"))


def weights_of(queries: DataFrame, index: Index, query_key: str, text: str) -> DataFrame:
    """q, term, w (its weight in the query) and most (the largest gain of a document by it, zero at least)."""
    terms = index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    rows = postings(queries.select(F.col(query_key).alias("q"), F.col(text).alias("text")), "q").join(terms, "term")
    weight = idf(F.col("df"), index.corpus.select("n").scalar())
    weight = F.col("tf") * F.when(weight < 0, index.corpus.select("mean_idf").scalar() * EPSILON).otherwise(weight)
    return rows.select("q", "term", weight.alias("w"), F.greatest(weight * F.col("top"), F.lit(0.0)).alias("most"))


def _scores(pairs: DataFrame, weights: DataFrame, rows: DataFrame) -> DataFrame:
    """q, doc and score of pairs (q, doc), over all terms they share. The weights are those of a block of queries."""
    gains = rows.select("doc", "term", "gain").join(pairs, "doc").join(F.broadcast(weights.select("q", "term", "w")), ["q", "term"])
    return gains.groupBy("q", "doc").agg(F.round(F.sum(F.col("w") * F.col("gain")), 6).alias("score"))


def promising(blocks: DataFrame, weights: DataFrame, bounds: DataFrame, rest: float = REST) -> DataFrame:
    """q, term, level, w, bound and rest (the most that blocks left out can add to a document) of the blocks to read for documents at the bound
    (q, bound; zero without).

    Left out are the terms whose gains together stay under the share `rest` of the bound, and blocks that cannot reach it.
    """
    total = Window.partitionBy("q")
    upto = total.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = weights.join(bounds, "q", "left").withColumns({"bound": F.coalesce("bound", F.lit(0.0)) - SLACK, "all": F.sum("most").over(total), "upto": F.sum("most").over(upto)})
    rows = rows.join(blocks, "term").withColumn("gain", F.greatest(F.col("w") * F.col("top"), F.lit(0.0)))
    rows = rows.withColumn("kept", (F.col("upto") >= F.col("bound") * rest) & (F.col("gain") + F.col("all") - F.col("most") >= F.col("bound")))
    rows = rows.withColumn("out", F.max(F.when(~F.col("kept"), F.col("gain")).otherwise(0.0)).over(Window.partitionBy("q", "term")))
    once = F.row_number().over(Window.partitionBy("q", "term").orderBy("level")) == 1
    rows = rows.withColumn("once", once).withColumn("rest", F.sum(F.when(F.col("once"), F.col("out")).otherwise(0.0)).over(total))
    return rows.where("kept").select("q", "term", "level", "w", "bound", "rest")


def seeds(blocks: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """q, term, level and w of the blocks that promise most, until they hold `size` postings."""
    first = Window.partitionBy("q").orderBy(F.desc(F.col("w") * F.col("top")), "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    rows = weights.join(blocks, "term").withColumn("upto", F.sum("n").over(first))
    return rows.where(F.col("upto") - F.col("n") < size).select("q", "term", "level", "w")


def candidates(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """q, doc, seen (its gains in kept blocks) and upper (with the most of the blocks left out) of the documents that may reach the bound."""
    seen = rows.select("term", "level", "doc", "gain").join(F.broadcast(kept.select("q", "term", "level", "w")), ["term", "level"])
    sums = seen.groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("gain")).alias("seen")).join(F.broadcast(kept.select("q", "rest", "bound").distinct()), "q")
    return sums.withColumn("upper", F.col("seen") + F.col("rest")).where("upper >= bound").select("q", "doc", "seen", "upper")


def kth_scores(sums: DataFrame, weights: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """q and bound, the k-th score among the documents that lead by what was seen of them; no row for fewer with a positive score."""
    place = lambda by: F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "doc"))
    first = sums.withColumn("_place", place("seen")).where(F.col("_place") <= 2 * k).select("q", "doc")
    scored = _scores(F.broadcast(first), weights, rows).where("score > 0").withColumn("_place", place("score"))
    return scored.where(F.col("_place") == k).select("q", F.col("score").alias("bound"))


def search(queries: DataFrame, index: Index, k: int, query_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", size: int = SEEDS) -> DataFrame:
    """The k best documents per query with a positive score, exactly; ties to the smaller document."""
    weights = stage(weights_of(queries, index, query_key, text), "query-terms")
    blocks = -(-weights.count() // TERMS)
    dealt = F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1)))
    found = reduce(DataFrame.unionByName, [_search_block(weights.where(dealt == i), index, k, size) for i in range(max(blocks, 1))])
    return found.select(F.col("q").alias(query_key), F.col("doc").alias(doc_key), "score", "rank")


def _search_block(weights: DataFrame, index: Index, k: int, size: int) -> DataFrame:
    """q, doc, score and rank of the k best documents of the queries of a block."""
    folders = [r.part for r in weights.select(part_of("term").alias("part")).distinct().collect()]  # PARTS at most
    terms = weights.select("term").distinct()
    rows = index.postings.where(F.col("part").isin(folders)).drop("part").join(F.broadcast(terms), "term", "left_semi")
    blocks = stage(index.blocks.join(F.broadcast(terms), "term", "left_semi"), "query-blocks")
    first = rows.join(F.broadcast(seeds(blocks, weights, size)), ["term", "level"]).groupBy("q", "doc").agg(F.sum(F.col("w") * F.col("gain")).alias("seen"))
    low = stage(kth_scores(first, weights, rows, k), "bounds")
    high = kth_scores(candidates(promising(blocks, weights, low), rows), weights, rows, k)
    bounds = stage(low.unionByName(high).groupBy("q").agg(F.max("bound").alias("bound")), "bounds")
    left = candidates(stage(promising(blocks, weights, bounds), "kept"), rows).select("q", "doc")
    scores = _scores(left, weights, rows).where("score > 0")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).select("q", "doc", "score", "rank")

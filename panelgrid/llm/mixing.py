"""Mixing sources to target weights by budgeting down a tree of domain, language and source.

Every node has a weight among its siblings, and can supply its tokens `epochs` times. The root's budget is dealt down:
siblings get shares by weight, those that can't fill theirs are filled up and the shortage goes to their siblings, in
proportion to weight (water filling, in closed form by running sums over the siblings sorted by supply for weight).
A node never gets more than all below it can supply, so a shortage reaches its parent's siblings only when its own
siblings are exhausted. Siblings without weight get nothing.

A leaf whose budget is f times its tokens and a rest takes f whole epochs, and of the next one the prefix that holds
the rest: documents are put in the order of a hash seeded with the epoch and taken until the rest is spent. The last
document is taken with what is left (`take_tokens`). A hot leaf is never sorted in one task: hash ranges are summed
first, and only the range that holds the end of the prefix is sorted. What is joined back to the documents is one row
for each leaf, so texts are not shuffled for it unless the leaves are too many to broadcast (Spark decides by size).

Defined cases: a null or empty text has no tokens and is taken with whole epochs only; null levels are nodes of their
own; repeated rows are separate documents that stand next to each other, and share the rest where the prefix ends with
them; no documents give no rows; extra columns pass through, also those with the names used here.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.session import stage

WORDS = r"[^\x20\x09-\x0D]+"
RANGES = 1 << 12  # hash ranges of a leaf


@dataclass
class Level:
    """A level of the tree: a name, the column it is read from, and weights of its values (others have `other`)."""

    name: str
    value: Column
    weights: dict[str, float] = field(default_factory=dict)
    other: float = 1.0

    def weight(self) -> Column:
        column = F.col(self.name)
        cases = [F.when(column == k, float(w)) for k, w in self.weights.items()]
        return reduce(lambda rest, case: F.coalesce(case, rest), reversed(cases), F.lit(float(self.other)))


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, where nulls are equal too; the names come from the left."""
    renamed = right.select(*(F.col(n).alias(f"__{n}") for n in names), *(c for c in right.columns if c not in names))
    condition = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    return left.join(renamed, condition, how).drop(*(f"__{n}" for n in names))


def deal(budget: Column, parent: list[str]) -> Column:
    """The share of each row (columns supply and weight) of its parent's budget; rows of a parent are siblings."""
    siblings = Window.partitionBy(*(F.col(p) for p in parent)) if parent else Window.partitionBy(F.lit(0))
    ranked = siblings.orderBy(F.col("supply") / F.col("weight"), "supply", "name")
    before = F.coalesce(F.sum("supply").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    remaining = F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    filled = F.col("supply") * remaining <= F.col("weight") * (budget - before)
    share = F.col("weight") * F.greatest(F.lit(0.0), budget - before) / remaining
    # the first unfilled row has the level of filling that holds for all after it; theirs come out lower
    level = F.max(F.when(~filled, share / F.col("weight"))).over(siblings)
    return F.when(filled, F.col("supply")).otherwise(F.col("weight") * level)


def leaf_budgets(leaves: DataFrame, levels: list[Level], fraction: float, epochs: int) -> DataFrame:
    """Columns of the levels, tokens and budget. `leaves`: a row for each leaf with its tokens; the root's budget is
    `fraction` of all tokens."""
    names = [x.name for x in levels]
    weighted = leaves.where("tokens > 0")
    for x in levels:
        weighted = weighted.where(x.weight() > 0)
    weighted = weighted.withColumn("supply", F.col("tokens") * float(epochs))
    dealt = None
    for depth, level in enumerate(levels, 1):
        path = names[:depth]
        nodes = weighted.groupBy(*path).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", level.weight()).withColumn("name", F.col(level.name))
        if dealt is None:
            wanted = F.sum("tokens").over(Window.partitionBy(F.lit(0))) * float(fraction)
            nodes = nodes.withColumn("given", F.least(wanted, F.sum("supply").over(Window.partitionBy(F.lit(0)))))
        else:
            above = dealt.select(*path[:-1], F.col("budget").alias("given"))
            nodes = _join(nodes, above, path[:-1])
        dealt = nodes.withColumn("budget", F.least("supply", deal(F.col("given"), path[:-1])))
    return dealt.select(*names, "tokens", F.round("budget").cast("long").alias("budget"))


def plan(marks: DataFrame, levels: list[Level], fraction: float, epochs: int, seed: int) -> DataFrame:
    """One row for each leaf: budget, whole epochs, the rest, and where the prefix of the next epoch ends.

    `marks`: the columns of the levels, mark (an identity of the document) and tokens.
    """
    names = [x.name for x in levels]
    leaves = marks.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, levels, fraction, epochs)
    budgets = budgets.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    budgets = stage(budgets, "budgets")
    rows = _join(marks.where("tokens > 0"), budgets.where("rest > 0").select(*names, "whole", "rest"), names)
    rows = rows.withColumn("place", order_hash(seed, F.col("whole"), F.col("mark")))
    rows = rows.withColumn("range", F.shiftrightunsigned("place", 64 - RANGES.bit_length() + 1))
    sums = rows.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*names).orderBy("range"))
    last = sums.withColumn("before", upto - F.col("sum")).where("before < rest and before + sum >= rest").drop("sum", "rest")
    inside = _join(rows, last, [*names, "range"])
    tied = inside.groupBy(*names, "range", "place", "rest", "before").agg(F.sum("tokens").alias("sum"), F.count("*").alias("copies"))
    # places as signed numbers keep the order within a range
    before = F.col("before") + F.sum("sum").over(Window.partitionBy(*names).orderBy("place")) - F.col("sum")
    ends = tied.withColumn("left", F.col("rest") - before).where("left > 0 and left <= sum")
    ends = ends.select(*names, F.col("range").alias("end_range"), F.col("place").alias("end"), F.ceil(F.col("left") / F.col("copies")).alias("end_tokens"))
    return _join(budgets, ends, names, "left")


def order_hash(seed: int, epoch: Column, mark: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), mark)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix(docs: DataFrame, levels: list[Level], fraction: float = 0.6, epochs: int = 2, seed: int = 17, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` mixed, as struct `row` of its columns, with the levels, tokens, epoch (from 0) and take_tokens.

    A document is returned once for each epoch that takes it.
    """
    names = [x.name for x in levels]
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(x.value.alias(x.name) for x in levels))
    body = F.col(f"row.`{text}`")
    keyed = keyed.withColumn("mark", F.xxhash64(f"row.`{doc_id}`", body)).withColumn("tokens", count_words(body))
    marks = stage(keyed.select(*names, "mark", "tokens"), "marks")
    leaf = plan(marks, levels, fraction, epochs, seed).drop("tokens", "budget", "rest")
    leaf = stage(leaf, "leaves")
    taken = _join(keyed, leaf, names)
    place = order_hash(seed, F.col("whole"), F.col("mark"))
    range_ = F.shiftrightunsigned(place, 64 - RANGES.bit_length() + 1)
    in_prefix = F.col("end").isNotNull() & (F.col("tokens") > 0) & ((range_ < F.col("end_range")) | ((range_ == F.col("end_range")) & (place <= F.col("end"))))
    takes = F.col("whole") + F.when(in_prefix, 1).otherwise(0)
    taken = taken.where(takes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), takes - 1)))
    at_end = (F.col("epoch") == F.col("whole")) & (place == F.col("end"))
    take = F.when(at_end, F.least("tokens", "end_tokens")).otherwise(F.col("tokens"))
    return taken.select("row", *names, "tokens", F.col("epoch").cast("int").alias("epoch"), take.alias("take_tokens"))


def corpus_levels(docs: DataFrame) -> list[Level]:
    """The tree of the documents table. It names no domain, so sources are grouped into four by a hash of their name."""
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(docs["source"].cast("binary")), F.lit(4)).cast("string"))
    return [
        Level("domain", domain, {"d0": 4, "d1": 3, "d2": 2}, 1),
        Level("language", docs["lang"], {"en": 4, "de": 2, "fr": 2}, 2),
        Level("origin", docs["source"]),
    ]


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, domain, language, origin, tokens, epoch and take_tokens of the mixed documents."""
    return mix(docs, corpus_levels(docs)).select("row.doc_id", "domain", "language", "origin", "tokens", "epoch", "take_tokens")


def keep_mixture(docs: DataFrame) -> DataFrame:
    """The mixed documents with the columns of `docs`, once for each epoch that takes them."""
    return mix(docs, corpus_levels(docs)).select("row.*")

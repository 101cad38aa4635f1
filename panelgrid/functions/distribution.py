"""Exact ranks, percentiles and rank correlations, keyed by any columns.

A group may hold a third of all rows, so no group is ever gathered in one task. Rows are collapsed to distinct
(key, value) counts; a group with many distinct values is cut into value ranges at split points taken from a hash
sample, ranges are ordered locally, and the counts of earlier ranges are added. The split points only balance the work; the
counts are exact. The number of ranges follows the number of distinct values. A caller whose groups are
bounded by their grain says so (``bounded=True``); then one window or one `percentile` aggregate for each group gives the
same numbers. Nothing is switched by size.

The sample is chosen by a hash of the value, so a re-run task sees the same split points. A null key is a key like any
other; operators whose group-by leaves null groups out filter them first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_VALUES = 1 << 16  # distinct values of a range, about
OVERSAMPLE = 4
SALTS = 16
_ALL = "_all"


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, where nulls are equal too; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))


def _with_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def value_positions(df: DataFrame, keys: list[str], value: str, bounded: bool = False, weight: str | None = None) -> DataFrame:
    """One row per distinct (keys, value): `cnt`, `before` (rows with smaller values), `n`.

    With ``weight`` a row counts that many times.
    """
    df, keys = _with_keys(df, keys)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows.alias("cnt"))
    if bounded:
        order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            *keys, value, "cnt",
            (F.sum("cnt").over(order) - F.col("cnt")).alias("before"),
            F.sum("cnt").over(Window.partitionBy(*keys)).alias("n"),
        )
    return _ranged_positions(counts, keys, value)


def _ranged_positions(counts: DataFrame, keys: list[str], value: str, range_values: int | None = None) -> DataFrame:
    range_values = range_values or RANGE_VALUES
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > range_values)
    splits = split_points(counts, keys, value, range_values, sizes).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tagged = (
        join_keys(counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")), splits, [*keys, "_salt"], "left")
        .select(*keys, value, "cnt", _points_under(value).alias("_range"))
    )
    return _summed_ranges(tagged, keys, value)


def split_points(df: DataFrame, keys: list[str], value: str, range_values: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(keys, `_pts`): sorted split points, one for about so many distinct values, from a hash sample; of the keys of `among`, if given."""
    rate = F.least(F.lit(1.0), F.lit(float(OVERSAMPLE)) / (range_values or RANGE_VALUES))  # a share of all values, so points follow their number
    draw = F.pmod(F.xxhash64(F.col(value), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = df.where(F.col(value).isNotNull() & (draw < rate)).select(*keys, value).distinct()
    drawn = drawn if among is None else join_keys(drawn, among, keys)
    points = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_pts"))
    return points.select(*keys, F.expr(f"filter(_pts, (x, i) -> i % {OVERSAMPLE} = 0)").alias("_pts"))


def _points_under(value: str) -> Column:
    """The number of points in `_pts` under the value (none without points): a binary search, from the largest step that the points allow down."""
    largest = F.floor(F.log2(F.greatest(F.size("_pts"), F.lit(1)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(largest, F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    under = lambda at: F.coalesce(F.get("_pts", at - 1) < F.col(value), F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((step <= F.size("_pts") - at) & under(at + step), step).otherwise(0))
    return F.when(F.col("_pts").isNull(), 0).otherwise(found)


def in_ranges(df: DataFrame, points: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rows with the range of their value between `split_points`, few enough for every task to have them; rows are not shuffled."""
    return join_keys(df, F.broadcast(points), keys, "left").withColumn(out, _points_under(value)).drop("_pts")


def row_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, `before`) of distinct values, like `value_positions`, for values that hardly repeat: rows are shuffled once, uncounted."""
    df, keys = _with_keys(df.where(F.col(value).isNotNull()), keys)
    rows = in_ranges(df.select(*keys, value), split_points(df, keys, value), keys, value, "_range")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    bases = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in")).select(*keys, "_range", (F.sum("_in").over(earlier) - F.col("_in")).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    places = rows.withColumns({"_place": F.rank().over(inside), "_nth": F.row_number().over(inside)}).where("_place = _nth")  # a value's first row
    return join_keys(places, F.broadcast(bases), [*keys, "_range"]).select(*keys, value, (F.col("_base") + F.col("_place") - 1).alias("before"))


def _summed_ranges(tagged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions from counts of distinct values that know their `_range`: those of earlier ranges and the local ones before."""
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        tagged.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_in"))
        .select(*keys, "_range", (F.sum("_in").over(earlier) - F.col("_in")).alias("_base"),
                F.sum("_in").over(Window.partitionBy(*keys)).alias("n"))
    )
    local = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_keys(tagged.withColumn("_upto", F.sum("cnt").over(local)), ranges, [*keys, "_range"])
        .select(*keys, value, "cnt", (F.col("_base") + F.col("_upto") - F.col("cnt")).alias("before"), "n")
    )


def value_ranges(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, `out`): the range of about `RANGE_VALUES` rows that each distinct value lies in, made once for all subsets of the rows."""
    places = value_positions(df, keys, value)
    return places.select(*keys, value, F.floor(F.col("before") / F.lit(RANGE_VALUES)).alias(out))


def spearman_in_ranges(df: DataFrame, keys: list[str], x: tuple[str, str], y: tuple[str, str], out: str = "rho") -> DataFrame:
    """`spearman` of columns that come with their range (column, range column), from `value_ranges` of any rows that hold these."""
    (x, xr), (y, yr) = x, y
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for value, at, name in ((x, xr, "_rx"), (y, yr, "_ry")):
        both = both.withColumn("_range", F.col(at))
        sizes = both.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_in"))
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
        bases = sizes.select(*keys, "_range", (F.sum("_in").over(earlier) - F.col("_in")).alias("_base"))
        inside, ties = Window.partitionBy(*keys, "_range").orderBy(value), Window.partitionBy(*keys, "_range", value)
        both = both.withColumns({"_place": F.rank().over(inside), "_ties": F.count(F.lit(1)).over(ties)})
        both = join_keys(both, bases, [*keys, "_range"]).withColumn(name, F.col("_base") + F.col("_place") - 1 + (F.col("_ties") + 1) / F.lit(2.0)).drop("_range", "_base", "_place", "_ties")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr("_rx", "_ry").alias(out))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, bounded: bool = False) -> DataFrame:
    """Add the 1-based average rank of ``value`` among non-null values of the key group."""
    df, all_keys = _with_keys(df, keys)
    if bounded:
        ordered = Window.partitionBy(*all_keys, F.col(value).isNull()).orderBy(value)
        ties = Window.partitionBy(*all_keys, value)
        ranked = df.withColumn(
            out, F.when(F.col(value).isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)))
    else:
        places = value_positions(df, all_keys, value).select(
            *all_keys, value, (F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)).alias(out))
        ranked = join_keys(df, places, [*all_keys, value], "left")
    return ranked.drop(_ALL)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool = False, weight: str | None = None) -> DataFrame:
    """Linear-interpolation percentiles and `n` per key group, one row per group."""
    frame, all_keys = _with_keys(df, keys)
    if bounded:
        wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
        qs = F.percentile(F.col(value), wanted) if weight is None else F.percentile(F.col(value), wanted, F.col(weight))
        rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
        out = frame.where(F.col(value).isNotNull()).groupBy(*all_keys).agg(qs.alias("_q"), rows.alias("n"))
        return out.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)], "n")
    places = value_positions(frame, all_keys, value, weight=weight)
    return percentiles_from_positions(places, all_keys, value, probs).drop(_ALL)


def percentiles_from_positions(places: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    aggs = []
    for i, p in enumerate(probs.values()):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for tag, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}{i}"))
    out = places.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("n") - 1)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(name))
    return out.select(*keys, *cols, "n")


def medians(df: DataFrame, keys: list[str], value: str, out: str, bounded: bool = False) -> DataFrame:
    return percentiles(df, keys, value, {out: 0.5}, bounded)


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null for constant input instead of a division error."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(df: DataFrame, keys: list[str], x: str, y: str, out: str = "r") -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr(x, y).alias(out))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho", bounded: bool = False) -> DataFrame:
    """Pairwise-complete Spearman correlation per key group, with the number of shared rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(both, keys, "_x", "_rx", bounded), keys, "_y", "_ry", bounded)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr("_rx", "_ry").alias(out))


def group_residual(df: DataFrame, group: list[str], values: list[str], min_n: int = 15, bounded: bool = False) -> DataFrame:
    """Centre each value on its group median, keeping groups with at least ``min_n`` rows.

    Adds `<value>_adj` and `group_n`. The medians are one small row per group, joined back.
    Residuals are rounded to 9 digits, so that equal ones tie in later ranks.
    """
    out = df
    for i, value in enumerate(values):
        centre = medians(df, group, value, f"_med_{value}", bounded)
        if i == 0:
            centre = centre.withColumnRenamed("n", "group_n").where(F.col("group_n") >= min_n)
        else:
            centre = centre.drop("n")
        out = join_keys(out, centre, group).withColumn(f"{value}_adj", F.round(F.col(value) - F.col(f"_med_{value}"), 9)).drop(f"_med_{value}")
    return out


def rank_biserial(df: DataFrame, keys: list[str], value: str, is_first: str, out: str = "rank_biserial", bounded: bool = False) -> DataFrame:
    """`u` of the flagged group and its rank-biserial effect, per key group."""
    rows = df.where(F.col(value).isNotNull() & F.col(is_first).isNotNull())
    ranked = average_ranks(rows, keys, value, "_r", bounded)
    flag = F.col(is_first)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(flag, F.col("_r"))).alias("_r1"),
        F.count(F.when(flag, 1)).alias("n_first"), F.count(F.when(~flag, 1)).alias("n_second"))
    u = F.col("_r1") - F.col("n_first") * (F.col("n_first") + 1) / F.lit(2.0)
    return sums.select(
        *keys, "n_first", "n_second", u.alias("u"),
        (F.try_divide(2.0 * u, (F.col("n_first") * F.col("n_second")).cast("double")) - 1.0).alias(out))

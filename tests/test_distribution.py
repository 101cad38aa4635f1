"""Exact kernels against pandas, with whole and cut groups, with a hot key and many ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.functions import distribution as d
from panelgrid.session import small_frame


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n))
    x = np.round(rng.normal(size=n), 2)
    x[: n // 3] = 1.25  # a third of all rows share one value
    y = np.round(x + rng.normal(size=n), 3)
    return pd.DataFrame({"k": key, "x": x, "y": y, "i": np.arange(n)})


@pytest.fixture(scope="module")
def frame(spark, rows):
    return small_frame(spark, list(rows.itertuples(index=False, name=None)), "k string, x double, y double, i bigint")


def test_percentiles(frame, rows, path):
    got = d.percentiles(frame, ["k"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).toPandas().set_index("k").sort_index()
    want = rows.groupby("k")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got[["lo", "mid", "hi"]].to_numpy(), want.to_numpy(), atol=1e-12)
    assert got["n"].to_dict() == rows.groupby("k").size().to_dict()


def test_percentile_without_keys(frame, rows, path):
    got = d.percentiles(frame, [], "y", {"p": 0.25}).first()
    assert got["p"] == pytest.approx(rows["y"].quantile(0.25)) and got["n"] == len(rows)


def test_average_ranks(frame, rows, path):
    got = d.average_ranks(frame, ["k"], "x", "r").toPandas().sort_values("i")
    want = rows.groupby("k")["x"].rank(method="average")
    np.testing.assert_allclose(got["r"].to_numpy(), want.to_numpy())


def test_spearman(frame, rows, path):
    got = {r["k"]: r["rho"] for r in d.spearman(frame, ["k"], "x", "y").collect()}
    for k, part in rows.groupby("k"):
        want = np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]
        assert got[k] == pytest.approx(want, abs=1e-10)


def test_spearman_is_pairwise_complete_and_guarded(spark, path):
    df = small_frame(spark, [("a", 1.0, 5.0), ("a", 2.0, None), ("a", 3.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("one", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["n"], r["rho"]) for r in d.spearman(df, ["k"], "x", "y").collect()}
    assert got == {"a": (2, pytest.approx(-1.0)), "flat": (2, None), "one": (1, None)}


def test_group_residual_gate(spark, path):
    data = [("g14", float(i)) for i in range(14)] + [("g15", float(i)) for i in range(15)]
    got = d.group_residual(small_frame(spark, data, "g string, v double"), ["g"], ["v"], 15).toPandas()
    assert set(got["g"]) == {"g15"} and got["v_adj"].median() == 0.0


def test_rank_biserial(frame, rows, path):
    got = d.rank_biserial(frame.withColumn("first", F.col("i") % 3 == 0), ["k"], "y", "first").toPandas().set_index("k")
    for k, part in rows.groupby("k"):
        a, b = part[part["i"] % 3 == 0]["y"].to_numpy(), part[part["i"] % 3 != 0]["y"].to_numpy()
        u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert got.loc[k, "rank_biserial"] == pytest.approx(2 * u / (len(a) * len(b)) - 1)


def test_row_order_and_partitions_change_nothing(frame):
    a = sorted(d.percentiles(frame, ["k"], "x", {"p": 0.3}).collect())
    b = sorted(d.percentiles(frame.orderBy("y").repartition(5), ["k"], "x", {"p": 0.3}).collect())
    assert a == b


def test_null_keys_and_odd_values(spark, path):
    nan = float("nan")
    data = [(None, 1.0), (None, 3.0), (None, 3.0), ("a", -0.0), ("a", 0.0), ("a", None), ("a", 2.0), ("b", nan), ("b", 1.0)]
    df = small_frame(spark, data, "k string, v double")
    got = {r["k"]: (r["p"], r["n"]) for r in d.percentiles(df, ["k"], "v", {"p": 0.5}).collect()}
    assert got[None] == (3.0, 3) and got["a"] == (0.0, 3) and got["b"][1] == 2
    for bounded in (True, False):
        ranks = sorted(((r["k"] or "", str(r["v"]), r["r"]) for r in d.average_ranks(df, ["k"], "v", "r", bounded).collect()), key=str)
        assert ranks == sorted([("", "1.0", 1.0), ("", "3.0", 2.5), ("", "3.0", 2.5), ("a", "-0.0", 1.5), ("a", "0.0", 1.5), ("a", "None", None), ("a", "2.0", 3.0), ("b", "nan", 2.0), ("b", "1.0", 1.0)], key=str)


def test_many_distinct_values_are_cut_evenly(spark):
    rows = spark.range(20000).select((F.col("id") % 3 == 0).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    counts = rows.groupBy("k", "v").agg(F.count("*").alias("cnt"))
    got = d._ranged_positions(counts, ["k"], "v", 500)
    want = d.value_positions(rows, ["k"], "v", bounded=True)
    assert sorted(got.collect()) == sorted(want.collect())

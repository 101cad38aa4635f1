"""Tables that are built from the joined line items, on rows with null, repeated and unmatched keys."""

import numpy as np
import pytest

from panelgrid.functions import distribution
from panelgrid.operators import relations
from panelgrid.plans.binding import FROM_LINES, Bound, with_bindings
from panelgrid.session import small_frame


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(5)
    lines = [(None if i % 41 == 0 else int(rng.integers(0, 70)), int(rng.integers(0, 25)), int(rng.integers(1, 40)), 1 + i % 7, float(rng.integers(1, 51)), float(rng.integers(900, 9000)), i % 11 / 100,
              i % 9 / 100, "RAN"[i % 3], "OF"[i % 2]) for i in range(600)]
    lines += lines[:40]
    orders = [(i, None if i % 10 == 0 else i % 13) for i in range(60)] + [(7, 4)]
    tables = {
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
        "orders": (orders, "o_orderkey bigint, o_custkey bigint"), "part": ([(i, f"Brand#{11 + i % 5}") for i in range(20)], "p_partkey bigint, p_brand string")}
    for name, (rows, ddl) in tables.items():
        df = small_frame(spark, rows, ddl)
        (df.selectExpr("*", "date'1995-01-01' AS l_shipdate") if name == "lineitem" else df).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", FROM_LINES)
def test_tables_from_lines_need_no_shuffle_of_their_own(spark, folder, name):
    bound = Bound(spark, folder)
    built = bound.sql(f"SELECT * FROM {name}", building=name)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    for table in ("lineitem", "orders", "part"):
        bound.table(table).createOrReplaceTempView(table)
    want = spark.sql(with_bindings(f"SELECT * FROM {name}"))
    got = bound(name)
    assert got.columns == want.columns and want.count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_policy_grid_holds_no_group_whole(spark, monkeypatch, path):
    """Against the settings one by one; groups are cut into ranges."""
    def unbounded(*args, **named):
        assert not named.get("bounded") and not any(a is True for a in args)
        return distribution_percentiles(*args, **named)

    distribution_percentiles = distribution.percentiles
    monkeypatch.setattr(relations, "percentiles", unbounded)
    monkeypatch.setattr(distribution, "percentiles", unbounded)
    rng = np.random.default_rng(8)
    rows = [(t, i, g, float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 2))) for t in ("t1", "t2") for g, n in (("a", 60), ("b", 30), ("c", 8)) for i in range(n)]
    rows += rows[:20]
    grid = [{"scenario": "base", "low": 0.2, "high": 0.8, "min_group": 15, "min_side": 10, "min_total": 30}, {"scenario": "thirds", "low": 0.33, "high": 0.67, "min_group": 1, "min_side": 10, "min_total": 30},
            {"scenario": "large", "low": 0.2, "high": 0.8, "min_group": 40, "min_side": 400, "min_total": 900}]
    got = {(r.scenario, r.task): r for r in relations.policy_sensitivity(small_frame(spark, rows, "task string, entity bigint, grp string, source_value double, value double"), grid).collect()}
    assert len(got) == 6
    for g in grid:
        for task in ("t1", "t2"):
            sides, groups = {"context": [], "reference": []}, 0
            for grp in "abc":
                x, y = np.array([r[3:] for r in rows if r[0] == task and r[2] == grp]).T
                low, high = np.round(np.quantile(x, [g["low"], g["high"]]), 9)
                if len(x) >= g["min_group"] and high > low:
                    groups += 1
                    adj = np.round(y - np.median(y), 9)
                    sides["context"] += adj[x >= high].tolist()
                    sides["reference"] += adj[x <= low].tolist()
            row = got[g["scenario"], task]
            assert (row.n_context, row.n_reference, row.n_groups) == (len(sides["context"]), len(sides["reference"]), groups)
            assert row["shift"] == pytest.approx(np.median(sides["reference"]) - np.median(sides["context"]), abs=1e-9)
            assert row.estimable == (min(map(len, sides.values())) >= g["min_side"] and sum(map(len, sides.values())) >= g["min_total"] and groups >= 2)

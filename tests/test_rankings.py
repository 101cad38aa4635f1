"""Kendall's tau by blocks against all pairs, and correlations of pairs by ranges of their features."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from panelgrid.functions import distribution
from panelgrid.operators import score, stability
from panelgrid.session import small_frame

SCHEMA = "key string, entity string, position bigint"


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 64, 200):
        values = rng.permutation(n) * 3
        assert stability.inversions(values) == sum(a > b for a, b in itertools.combinations(values.tolist(), 2))


def test_crossing():
    counts = np.random.default_rng(2).integers(0, 4, (5, 6))
    cells = list(np.ndenumerate(counts))
    want = sum(x * y for ((a, b), x), ((c, d), y) in itertools.product(cells, cells) if a < c and b > d)
    assert stability.crossing(counts) == want


@pytest.mark.parametrize("block,most", [(1 << 16, 2048), (7, 2048), (3, 5)])
def test_tau_equals_all_pairs(spark, block, most):
    pick, ranks = random.Random(4), {}
    for key, n in (("x", 60), ("y", 2), ("z", 1), ("same", 20), ("falling", 20)):
        items = [f"e{i}" for i in range(n)]
        other = {"same": items, "falling": items[::-1]}.get(key) or pick.sample(items, n)
        ranks[key] = items + ["only here"], other[: n // 2] + ["only there"] + other[n // 2:]
    frames = [small_frame(spark, [(k, e, i + 1) for k, v in ranks.items() for i, e in enumerate(v[side])], SCHEMA) for side in (0, 1)]
    got = {r["key"]: (r["n"], r["tau"]) for r in stability.kendall_tau(*frames, ["key"], block, most).collect()}
    assert got.keys() == ranks.keys()
    for key, (a, b) in ranks.items():
        common = [e for e in a if e in b]
        signs = [1 if (a.index(x) < a.index(y)) == (b.index(x) < b.index(y)) else -1 for x, y in itertools.combinations(common, 2)]
        n, tau = got[key]
        assert n == len(common) and (tau == pytest.approx(np.mean(signs), abs=1e-9) if signs else tau is None)


def test_pairs_of_features_by_ranges(spark, monkeypatch):
    """Incomplete and tied columns, in one range and in many; no window holds the rows of a pair."""
    rng = np.random.default_rng(5)
    rows = [(f"e{i}", f, float(np.round(rng.normal() + (i % 7 if f == "B" else 0), 1))) for i in range(300) for f in "ABCD" if rng.random() < 0.8 and f != "D"]
    rows += [("e0", "D", 1.0), ("e1", "D", 1.0)] + [(f"e{i}", "A", 0.5) for i in range(3)]
    layer = small_frame(spark, rows, "entity string, feature string, value double")
    pairs = [("A", "B"), ("A", "C"), ("B", "C"), ("A", "D")]
    wide = pd.DataFrame(rows, columns=["entity", "feature", "value"]).pivot_table(index="entity", columns="feature", values="value")
    for size in (1 << 16, 11):
        monkeypatch.setattr(distribution, "RANGE_VALUES", size)
        frame = score.pair_spearman(layer, pairs)
        got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in frame.collect()}
        for a, b in pairs:
            both = wide[[a, b]].dropna()
            if not len(both):
                assert (a, b) not in got
                continue
            want = both[a].rank().corr(both[b].rank())
            assert got[a, b][0] == len(both) and (got[a, b][1] == pytest.approx(want, abs=1e-12) if want == want else got[a, b][1] is None)
        windows = re.findall(r"windowspecdefinition\(([^)]*?) ASC", frame._jdf.queryExecution().optimizedPlan().toString())
        assert windows and all("_range" in w for w in windows)

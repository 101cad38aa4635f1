"""Both forms of what has two: resampling in arrays and over all tasks, short and long feature lists, staged folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid import session
from panelgrid.functions import distribution
from panelgrid.operators import relations, resample, stability
from panelgrid.operators.concordance import pca
from panelgrid.operators.text import chunk, dense_topk
from panelgrid.session import clear_staged, scratch_path, shared_folder, small_frame, stage
from panelgrid.sources.tables import LITERAL_LIST_LIMIT, read_features


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(3)
    rows = [("t" + str(t), i, "gA" if i % 3 else "gB", "context" if rng.random() < 0.4 else "reference", float(np.round(rng.normal(), 1)), float(np.round(rng.normal(), 2))) for t in range(2) for i in range(90)]
    return small_frame(spark, rows, "task string, entity bigint, grp string, context string, x_adj double, y_adj double").withColumn("value_adj", F.col("x_adj"))


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 16), (16, 12)])
def test_bootstrap_equals_repeated_rows(pair, monkeypatch, sizes):
    """Against the drawn rows themselves, in one chunk and range or in many."""
    monkeypatch.setattr(resample, "CHUNK", sizes[0])
    monkeypatch.setattr(distribution, "RANGE_VALUES", sizes[1])
    drawn = relations.bootstrap_draws(pair, ["task"], ["grp", "context"], ["value_adj"], 40, 7).toPandas()
    got = {(r.task, r.replicate): r.stat for r in resample.bootstrap_shifts(pair, ["task"], 40, 7).collect()}
    assert len(got) == 80
    for key, part in drawn.groupby(["task", "replicate"]):
        side = {c: np.median(np.repeat(p.value_adj, p.weight)) for c, p in part.groupby("context")}
        assert got[key] == pytest.approx(side["reference"] - side["context"])
    drawn = relations.bootstrap_draws(pair, ["task"], ["grp"], ["x_adj", "y_adj"], 40, 7).toPandas()
    got = {(r.task, r.replicate): r.stat for r in resample.bootstrap_correlations(pair, ["task"], 40, 7).collect()}
    assert len(got) == 80
    for key, part in drawn.groupby(["task", "replicate"]):
        both = part.loc[part.index.repeat(part.weight), ["x_adj", "y_adj"]]
        assert got[key] == pytest.approx(both.rank().corr().iloc[0, 1])


def test_no_pair_is_gathered_for_its_bootstrap(pair, monkeypatch):
    """A hot value is one row for each chunk before ranges meet."""
    monkeypatch.setattr(resample, "CHUNK", 16)
    same = pair.withColumn("value_adj", F.lit(1.0)).withColumn("_range", F.lit(0))
    weights = resample.bootstrap_weights(same, ["task", "grp", "context"], ["value_adj"], 40, 7, ["_range"])
    assert weights.count() == pair.groupBy("task", "grp", "context").count().select(F.sum(F.ceil(F.col("count") / 16))).first()[0]


def test_hold_out_equals_filtering(pair, monkeypatch):
    monkeypatch.setattr(distribution, "RANGE_VALUES", 12)
    both = pair.withColumn("grp", F.when(F.col("entity") % 5 == 0, "gC").otherwise(F.col("grp")))
    rows, shifts, correlations = both.toPandas(), resample.shifts_without_each_group(both, ["task"]).collect(), resample.correlations_without_each_group(both, ["task"]).collect()
    assert len(shifts) == len(correlations) == 6
    for r in shifts:
        part = rows[(rows.task == r.task) & (rows.grp != r.held_out)]
        sides = part.groupby("context").value_adj
        assert r.n_groups == 2 and r.n_context == sides.size()["context"] and r.n_reference == sides.size()["reference"]
        assert r.median_context == pytest.approx(sides.median()["context"]) and r.raw == pytest.approx(sides.median()["reference"] - sides.median()["context"])
    for r in correlations:
        part = rows[(rows.task == r.task) & (rows.grp != r.held_out)]
        assert r.n == len(part) and r.r == pytest.approx(part[["x_adj", "y_adj"]].rank().corr().iloc[0, 1])


def test_hold_outs_that_leave_nothing(spark):
    rows = [("a", 1, "g1", "context", 1.0, 1.0), ("a", 2, "g2", "reference", 2.0, 2.0), ("b", 1, "g1", "context", 1.0, 1.0)]
    few = small_frame(spark, rows, "task string, entity bigint, grp string, context string, x_adj double, y_adj double").withColumn("value_adj", F.col("x_adj"))
    shifts = {r.held_out: r for r in resample.shifts_without_each_group(few, ["task"]).collect()}
    assert shifts.keys() == {"g1", "g2"} and shifts["g1"].n_context == 0 and shifts["g1"].median_context is None and shifts["g1"].raw is None and shifts["g2"].median_context == 1.0
    assert [(r.n, r.r) for r in resample.correlations_without_each_group(few, ["task"]).collect()] == [(1, None)] * 2
    assert resample.shifts_without_each_group(few.limit(0), ["task"]).count() == resample.correlations_without_each_group(few.limit(0), ["task"]).count() == 0
    assert relations.bootstrap_shift(few.limit(0), ["task"], 20).count() == relations.bootstrap_rho(few.limit(0), ["task"], 20).count() == 0


def test_an_unestimable_replicate_voids_the_interval(spark):
    rows = [("t", i, "gA", 1.0 if i else 2.0, float(i)) for i in range(40)] + [("t", 100 + i, "gB", 1.0, float(i)) for i in range(40)]
    adj = small_frame(spark, rows, "task string, entity bigint, grp string, x double, y double")
    got = relations.eval_codependency(adj, small_frame(spark, [("t", False)], "task string, broad boolean"), 50).first()
    assert got.estimable and got.ci_low is None and got.ci_high is None and got.status == "exploratory"


def test_feature_lists_of_any_length(spark):
    table = small_frame(spark, [(f"F{i}", float(i)) for i in range(700)], "feature string, value double")
    names = [f"F{i}" for i in range(LITERAL_LIST_LIMIT + 1)]
    assert read_features(table, names).count() == len(names) and read_features(table, names[:3]).count() == 3


def test_undefined_overlaps_stay_undefined(spark):
    tops = small_frame(spark, [("default", "q", 1, 1), ("default", "q", 2, 2), ("a", "q", 1, 1), ("a", "p", 5, 1)], "scenario_id string, query_id string, entity bigint, rank int")
    asked = small_frame(spark, [("a", "q"), ("b", "q"), ("a", "p")], "scenario_id string, query_id string")
    got = {(r.scenario_id, r.query_id): (r.rbo is None, r.n_diff) for r in stability.compare_to_baseline(tops, "default", asked).collect()}
    assert got == {("a", "q"): (False, 1), ("b", "q"): (True, 2), ("a", "p"): (True, 1)}
    assert not stability.shuffle_verdict(stability.compare_to_baseline(tops, "default", asked).where("rbo is null")).first().passed


def test_components_are_centred_and_leave_incomplete_features_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4)) * [1, 5, 2, 1]
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(30) for j in range(4) if (i, j) != (3, 3)]
    scores, loadings = pca(small_frame(spark, rows, "entity bigint, feature string, value double"))
    values, vectors = np.linalg.eigh(np.cov(x[:, :3].T))
    got = {(r.component, r.feature): (abs(r.loading), r.explained) for r in loadings.collect()}
    assert scores.count() == 30 and {f for _, f in got} == {"f0", "f1", "f2"}
    assert got[1, "f1"] == pytest.approx((abs(vectors[1, -1]), values[-1] / values.sum()))


def test_chunks_of_a_section(spark):
    body = "\n\n".join([" ".join(f"a{i}" for i in range(6)), "  ", " ".join(f"b{i}" for i in range(5)), " ".join(f"c{i}" for i in range(30))])
    got = chunk(small_frame(spark, [(1, body), (2, None), (3, " \n ")], "doc_id bigint, body string"), 10, 2).orderBy("doc_id", "chunk_no").collect()
    assert [r.text.split()[0] for r in got] == ["a0", "a4", "b3"] and [len(r.text.split()) for r in got] == [6, 7, 32]


def test_dense_ranking_over_blocks_and_ties(spark):
    vectors = small_frame(spark, [(i, [1.0, 0.0]) for i in range(20)] + [(50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    queries = small_frame(spark, [(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "label int, embedding array<double>")
    got = dense_topk(queries, vectors.repartition(5), 3, "label", "vec_id", block=2).orderBy("label", "rank").collect()
    assert [(r.label, r.vec_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 50), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


def test_staged_folders_are_shared_and_deleted(spark, monkeypatch, tmp_path):
    frame = stage(spark.range(5), "probe")
    path = session._STAGED[-1]
    assert frame.count() == 5 and os.path.isdir(path)
    before = session.staged_generation()
    monkeypatch.setattr(session, "_STAGED", [path])
    assert clear_staged(spark) == 1 and not os.path.isdir(path) and session.staged_generation() == before + 1

    class Conf:
        def __init__(self, **values):
            self.values = {k.replace("_", "."): v for k, v in values.items()}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf(spark_master="yarn")

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
    Session.conf = Conf(spark_master="yarn", **{"spark_checkpoint_dir": "hdfs:///shared/"})
    assert shared_folder(Session) == "hdfs:///shared"


def test_a_request_may_not_include_and_exclude_one_feature(spark):
    from panelgrid.operators.score import Panel, check_request

    reference = small_frame(spark, [("F1", "one"), ("F2", "two"), ("F3", "two")], "feature string, symbol string")
    assert check_request(Panel("q", ("one",), ("F2",)), reference).include == ("F1",)
    for panel, words in ((Panel("q", ("one",), ("F1",)), "both included and excluded"), (Panel("q", ("two",)), "not resolved"), (Panel("q", (), ("one",)), "at least one inclusion")):
        with pytest.raises(ValueError, match=words):
            check_request(panel, reference)
    with pytest.raises(ValueError, match="ploidy"):
        check_request(Panel("q", ("one",)), reference, 3.0, 2.0)

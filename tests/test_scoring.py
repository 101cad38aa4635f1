"""Hand-worked cases for desirability, combination, tiers and buckets."""

import pytest
from pyspark.sql import functions as F

from panelgrid.functions.columns import explicit_bool, finite, ramp
from panelgrid.operators import score
from panelgrid.operators.score import Panel
from panelgrid.plans import QUERIES
from panelgrid.session import small_frame

SF = "/root/testdata/sf0.001"


def test_ramp_edges(spark):
    df = small_frame(spark, [(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (None,)], "y double")
    low, high = F.lit(2.0), F.lit(4.0)
    got = df.select(ramp(F.col("y"), low, high, F.lit("inclusion")).alias("i"), ramp(F.col("y"), low, high, F.lit("exclusion")).alias("e"), ramp(F.col("y"), high, high, F.lit("inclusion")).alias("f")).collect()
    assert [r["i"] for r in got] == [0.0, 0.0, 0.5, 1.0, 1.0, None]
    assert [r["e"] for r in got] == [1.0, 1.0, 0.5, 0.0, 0.0, None]
    assert {r["f"] for r in got} == {None}


def test_scrubbing(spark):
    df = small_frame(spark, [("1.5", "Yes "), ("NaN", "N"), ("true", "maybe"), ("Infinity", None), ("x", "0")], "a string, b string")
    got = df.select(finite("a").alias("a"), explicit_bool("b").alias("b")).collect()
    assert [r["a"] for r in got] == [1.5, None, None, None, None]
    assert [r["b"] for r in got] == [True, False, None, None, False]


def test_query_validation():
    with pytest.raises(ValueError):
        score.validate_query(Panel("q", (), ("F01",)))
    with pytest.raises(ValueError):
        score.validate_query(Panel("q", ("F01",), ("F01",)))
    with pytest.raises(ValueError):
        score.validate_query(Panel("q", ("F01",)), ploidy_min=3, ploidy_max=2)
    with pytest.raises(ValueError):
        score.validate_query(Panel("q", ("F01",)), top_k=101)


@pytest.fixture(scope="module")
def battery(spark):
    return QUERIES["f22_score_battery"](spark, SF).toPandas()


def test_buckets_partition_candidates(battery):
    assert not battery.duplicated(["query_id", "entity"]).any()
    assert set(battery["bucket"]) <= {"insufficient", "disqualified", "ranked", "ranked_beyond_top_n", "low_confidence"}


def test_scores_are_bounded_and_zero_means_veto(battery):
    scored = battery[battery["D"].notna()]
    assert scored["D"].between(0, 1).all()
    assert ((scored["D"] == 0) == scored["veto_feature"].notna()).all()


def test_ranks_follow_scores(battery):
    for _, part in battery[battery["bucket"] == "ranked"].groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and len(part) <= 10
        assert part["D"].is_monotonic_decreasing


def test_exclusion_only_panel_is_insufficient(battery):
    assert set(battery[battery["query_id"] == "no_inclusion"]["bucket"]) == {"insufficient"}


def test_top_n_is_the_same_on_both_strategies(spark, battery):
    spark.conf.set("spark.panelgrid.smallBytes", "-1")
    try:
        other = QUERIES["f20_score_panel"](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.panelgrid.smallBytes")
    mine = battery[battery["query_id"] == "flagship"].sort_values("entity").reset_index(drop=True)
    other = other.sort_values("entity").reset_index(drop=True)
    assert (mine["bucket"] == other["bucket"]).all()
    assert (mine["D"].fillna(-1) == other["D"].fillna(-1)).all()
    assert (mine["rank"].fillna(0) == other["rank"].fillna(0)).all()


PANELS = [Panel("one", ("F01", "F02"), ("F03",)), Panel("two", ("F02",), group="G1")]


def small_grid(spark, copies=1):
    """A scored grid of 40 entities, whose cells come `copies` times, in two scenarios."""
    groups = [f"G{i % 2}" if i else None for i in range(40)]
    entities = small_frame(spark, list(enumerate(groups)), "entity int, grp string")
    candidates = entities.selectExpr("entity", "grp", "if(entity % 5 = 0, 'not_assayed', 'measured') mutations_state", "if(entity % 7 = 0, 'not_assayed', 'measured') fusions_state")
    cells = [(i, f"F0{f}", float(i * f % 11), float(i % 3), 1.0, i / 10, i % 4 > 0, f - i / 20, 1 + i / 40) for i in range(40) for f in (1, 2, 3) if (i + f) % 6] * copies
    measures = small_frame(spark, cells, "entity int, feature string, rna double, hpa double, geo double, zscore double, detected boolean, effect double, copy_number double")
    mutations = small_frame(spark, [(i, "F02", "HIGH", i % 2 == 0, False) for i in range(0, 40, 3)], "entity int, feature string, impact string, is_driver boolean, is_hotspot boolean")
    fusions = small_frame(spark, [(i, "F03", True, i % 2 == 0) for i in range(0, 40, 4)], "entity int, feature string, confidence_high boolean, in_frame boolean")
    roles = small_frame(spark, [("F01", "oncogene"), ("F02", "tumour_suppressor")], "feature string, gene_class string")
    runs = [score.Scenario("a"), score.Scenario("b", {"rna": 1.0}, min_group_n=5)]
    return score.score_features(candidates, measures, mutations, fusions, entities, roles, PANELS, runs)


def test_groups_are_hashed_not_sorted(spark):
    grid = small_grid(spark)
    scores = score.combine_features(grid, PANELS).drop("grp")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan.split("BroadcastExchange")[0]
    plain = score.combine_features(grid).drop("grp")
    key = ["scenario_id", "query_id", "entity"]
    assert sorted(map(str, scores.orderBy(*key).collect())) == sorted(map(str, plain.orderBy(*key).collect()))
    assert scores.where("veto_feature is not null").count() > 0


def test_evidence_is_dealt_once_and_repeated_cells_stay(spark):
    once, twice = small_grid(spark), small_grid(spark, 2)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" in plan and not [x for x in plan.split("\n") if "hashpartitioning(entity" in x and "feature" in x.split("hashpartitioning(entity")[1].split(")")[0] and "REPARTITION" in x]
    per = lambda df: df.groupBy("scenario_id", "query_id", "entity", "feature").count()
    assert per(once).where("count != 1").count() == 0 and per(once).count() == (40 * 3 + 20) * 2
    assert per(twice).where("count = 2").count() == once.where("rna is not null").count()


def test_shown_only_is_the_ranked_bucket(spark):
    scores = score.combine_features(small_grid(spark), PANELS).drop("grp")
    whole = score.partition_results(scores, 3).where("bucket = 'ranked'")
    shown = score.partition_results(scores, 3, shown_only=True)
    assert shown.columns != [] and sorted(map(str, shown.select(*whole.columns).collect())) == sorted(map(str, whole.collect())) and shown.count() > 3

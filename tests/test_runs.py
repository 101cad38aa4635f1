"""Scores of all scenarios in one pass against the spread grid: repeated cells and candidates, null entities and groups, batches that cut entities."""

import pytest
from pyspark.sql import functions as F

from panelgrid.operators import runs, score
from panelgrid.operators.score import Panel, Scenario
from panelgrid.session import small_frame

PANELS = [Panel("one", ("F01", "F02"), ("F03",)), Panel("two", ("F02",), group="G1"), Panel("both", ("F01", "F03"), ("F01",)), Panel("none", (), ("F02", "F09")), Panel("gone", ("F09",), ("F03",))]
RUNS = [Scenario("a"), Scenario("b", {"rna": 1.0}, min_group_n=5), Scenario("c", {"rna": 0.2, "effect": 1.0, "copy_number": 0.5}, min_calibration_n=20, insufficient_fraction=0.9, fraction_threshold=0.4, strong_cutoff=2.0, broad_fraction=0.3, high_min_layers=2, moderate_min_layers=1)]


def arguments(spark, copies=1, twice=()):
    groups = [f"G{i % 2}" if i else None for i in range(60)]
    people = [*enumerate(groups), *((i, groups[i]) for i in twice), (7, "G0"), (None, "G1"), (None, None)]
    entities = small_frame(spark, people, "entity int, grp string")
    candidates = entities.selectExpr("entity", "grp", "if(entity % 5 = 0, 'not_assayed', 'measured') mutations_state", "if(entity % 7 = 0, 'not_assayed', if(entity % 11 = 0, null, 'measured')) fusions_state")
    cells = [(i, f"F0{f}", float(i * f % 11) if i % 13 else None, float(i % 3), None if i % 8 == 0 else float(i % 2), i / 10, i % 4 > 0 if i % 9 else None, f - i / 20, 1 + i / 40) for i in range(60) for f in (1, 2, 3) if (i + f) % 6] * copies
    cells += [(2, "F01", float("nan"), 1.0, 1.0, 0.1, True, float("nan"), 1.0)]
    measures = small_frame(spark, cells, "entity int, feature string, rna double, hpa double, geo double, zscore double, detected boolean, effect double, copy_number double")
    mutations = small_frame(spark, [(i, "F02", ("HIGH", "MODERATE", "LOW")[i % 3], i % 2 == 0, False) for i in range(0, 60, 4)], "entity int, feature string, impact string, is_driver boolean, is_hotspot boolean")
    fusions = small_frame(spark, [(i, "F03", True, None if i % 3 == 0 else i % 2 == 0) for i in range(0, 60, 4)], "entity int, feature string, confidence_high boolean, in_frame boolean")
    roles = small_frame(spark, [("F01", "oncogene"), ("F02", "tumour_suppressor"), ("F02", "oncogene"), ("F03", "unknown")], "feature string, gene_class string")
    return candidates, measures, mutations, fusions, entities, roles, PANELS, RUNS


def plain(df):
    return sorted(str([f"{v:.9f}" if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("copies,twice,chunk", [(1, (), 4096), (2, range(0, 60, 3), 7)])
def test_one_pass_equals_the_spread_grid(spark, monkeypatch, copies, twice, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    monkeypatch.setattr(runs, "OUT_ROWS", 50)
    given = arguments(spark, copies, twice)
    wide = score.combine_features(score.score_features(*given), PANELS).drop("grp")
    evidence = score.score_features(*given, spread=False)
    slim = score.combine_features(evidence, PANELS)
    assert slim.columns == wide.columns and plain(slim) == plain(wide) and wide.where("veto_feature is not null").count() > 0
    shown = lambda df: score.partition_results(df, 3, shown_only=True).select("scenario_id", "query_id", "entity", "D", "rank")
    assert plain(shown(score.combine_features(evidence, PANELS, 3))) == plain(shown(wide)) and shown(wide).count() > 6


def test_no_row_is_made_for_a_scenario(spark):
    """What goes to the scores of many scenarios is a row per candidate."""
    evidence = score.score_features(*arguments(spark), spread=False)
    assert evidence.rows.count() == evidence.rows.select(F.count(F.lit(1))).first()[0] == 63
    plan = score.combine_features(evidence, PANELS)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "Generate" not in plan.split("_variants")[0] and "only_scenario" not in plan


def test_queries_of_scores_do_not_spread(spark):
    from panelgrid.plans.binding import Bound
    from panelgrid.plans.ranking import BATTERY, results

    frame = results(Bound(spark, "/root/testdata/sf0.001"), BATTERY, RUNS)
    assert "MapInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()

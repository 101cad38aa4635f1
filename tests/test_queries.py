"""Registered queries against their SQL equivalents, a few per family, on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SPARSE = {"h8_event_context"}  # no rows on the smallest tables
NAMES = [
    "a4_read_measurements", "a7_describe_tables", "a10_build_manifest", "a12_snapshot", "b1_unpivot_matrix", "b10_symmetrise", "b11_impute_floor", "b18_choose_profile",
    "c1_resolve", "c6_symbol_bridge", "c17_consensus_role", "c19_id_algebra", "d2_coverage3", "d8_route_cohorts", "d9_waterfall", "e2_calibrate_group", "e9_calibrate_without", "e12_burden", "e19_rate_by_decile",
    "f3_score_layers", "f19_similar_entities", "f22_score_battery", "g2_build_ledger", "g10_leave_one_group_out", "g16_policy_sensitivity", "g20_pair_table", "h1_percentile_profiles", "h8_event_context", "i2_kendall_tau",
    "i11_shuffle_null", "j5_association_topk", "j9_neighbourhood", "k1_entity_concordance", "k6_chain_consistency", "l2_compare_ranking", "l7_event_prevalence", "m1_sections", "m4_bm25", "m8_check_numbers", "m11_registry",
]


@pytest.fixture(scope="module")
def con():
    return {sf: connect(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    sf = LARGER if name in SPARSE else SF
    verdict, note, _ = compare(spark, con[sf], entry.queries()[name], entry.oracle_sql()[name], sf)
    assert verdict == "ok", note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

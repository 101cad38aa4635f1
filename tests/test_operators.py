"""Operators against brute force on small fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrid.operators import graph, identity, relations, reshape, retrieval, stability, text
from panelgrid.session import small_frame
from panelgrid.sources import sinks, tables


def test_repeated_key_fails(spark):
    df = small_frame(spark, [(1, "a", 1.0), (1, "a", 2.0)], "entity bigint, feature string, value double")
    with pytest.raises(Exception, match="repeated key"):
        tables.require_unique(df, ["entity", "feature"], "m").collect()


def test_validated_join(spark):
    one = small_frame(spark, [(1, "x"), (2, "y")], "k bigint, a string")
    two = small_frame(spark, [(1, "p"), (1, "q")], "k bigint, b string")
    assert identity.validated_join(one, two, ["k"], "inner", "1:m").count() == 2
    with pytest.raises(Exception, match="repeats key"):
        identity.validated_join(one, two, ["k"], "left", "m:1").collect()


def test_symmetrise_keeps_self_pairs_twice_and_drops_null_focal(spark):
    df = small_frame(spark, [("a", "b", 1), ("c", "c", 2), ("d", None, 3)], "g1 string, g2 string, n int")
    got = sorted((r["feature"], r["partner"], r["n"]) for r in reshape.symmetrise(df, "g1", "g2").collect() if r["partner"])
    assert got == [("a", "b", 1), ("b", "a", 1), ("c", "c", 2), ("c", "c", 2)]
    assert reshape.symmetrise(df, "g1", "g2").count() == 5


def test_snapshot_id_ignores_order_but_not_repeats(spark):
    a = small_frame(spark, [(1, "x"), (2, "y")], "k bigint, v string")
    b = small_frame(spark, [(2, "y"), (1, "x")], "k bigint, v string")
    c = small_frame(spark, [(1, "x"), (2, "y"), (2, "y"), (2, "y")], "k bigint, v string")
    ids = [sinks.content_id(f, {"t": 1}) for f in (a, b, c)]
    assert ids[0] == ids[1] != ids[2]


def test_kendall_matches_pair_counting(spark, path):
    rng = np.random.default_rng(3)
    a, b = rng.permutation(40), rng.permutation(40)
    fa = small_frame(spark, [("q", i, int(a[i]) + 1) for i in range(40)], "query_id string, entity bigint, position bigint")
    fb = small_frame(spark, [("q", i, int(b[i]) + 1) for i in range(40)], "query_id string, entity bigint, position bigint")
    want = np.mean([np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in itertools.combinations(range(40), 2)])
    assert stability.kendall_tau(fa, fb, ["query_id"]).first()["tau"] == pytest.approx(want, abs=1e-9)


def test_rbo_matches_definition(spark):
    x, y = list("abcdefghij"), list("bacdxyzefg")
    seen = [len(set(x[:d]) & set(y[:d])) for d in range(1, 11)]
    want = seen[-1] / 10 * 0.9**10 + 0.1 / 0.9 * sum(o / d * 0.9**d for d, o in enumerate(seen, 1))
    fx, fy = (small_frame(spark, [("q", e, i) for i, e in enumerate(v, 1)], "query_id string, entity string, rank int") for v in (x, y))
    assert stability.rbo(fx, fy, ["query_id"]).first()["rbo"] == pytest.approx(want, abs=1e-9)


def test_driver_and_column_draws_agree(spark):
    ids = small_frame(spark, [(i,) for i in range(5)], "sample_id bigint")
    got = {(r["sample_id"], r["layer"]): r["weight"] for r in stability.dirichlet_samples(ids, ["rna", "protein"], 9).collect()}
    for i in range(5):
        e = {n: -math.log(stability.uniform_of(9, i, n)) for n in ("rna", "protein")}
        assert got[i, "rna"] == pytest.approx(e["rna"] / sum(e.values()))


def test_shuffle_is_a_permutation(spark, path):
    df = small_frame(spark, [(i, "abc"[i % 3]) for i in range(90)], "entity bigint, grp string")
    got = stability.shuffled_groups(df, 2, 4).toPandas()
    for _, part in got.groupby("draw"):
        assert len(part) == 90 and part["cal_grp"].value_counts().to_dict() == {"a": 30, "b": 30, "c": 30}


@pytest.mark.parametrize("block", [2, 4, 50])
def test_association_over_several_blocks(spark, block):
    rng = np.random.default_rng(1)
    m = pd.DataFrame(rng.normal(size=(60, 9)), columns=[f"f{i}" for i in range(9)])
    m["f1"] += m["f0"]
    m["f8"] -= m["f2"]
    m = m.mask(rng.random(m.shape) < 0.2)
    z = ((m - m.mean()) / m.std(ddof=0)).fillna(0.0)
    long = m.stack().reset_index()
    df = small_frame(spark, [(int(e), f, float(v)) for e, f, v in long.itertuples(index=False, name=None)], "entity bigint, feature string, value double")
    got = {(r["low"], r["high"]): (r["score"], r["n_shared"]) for r in graph.association_topk(df, k=9, min_abs=0.0, min_n=1, block=block).collect()}
    assert len(got) == 36
    for a, b in itertools.combinations(m.columns, 2):
        n = int((m[a].notna() & m[b].notna()).sum())
        assert got[a, b][1] == n and got[a, b][0] == pytest.approx(float(z[a] @ z[b]) / (n - 1), abs=1e-8)


def test_neighbourhood_keeps_only_inward_edges(spark):
    nodes = small_frame(spark, [(n, "feature", n) for n in "abcde"], "node_id string, node_type string, display_name string")
    edges = small_frame(spark, [("a", "b", "t", "s", 1.0), ("a", "c", "t", "s", 2.0), ("b", "c", "t", "s", 3.0), ("c", "d", "t", "s", 4.0), ("d", "x", "t", "s", 5.0)],
                        "source_node_id string, target_node_id string, edge_type string, source_db string, weight double")
    got = sorted((r["node_id"], r["hop"], r["connected_to"]) for r in graph.neighbourhood(nodes, edges, "a", 2).collect())
    assert got == [("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")]
    assert graph.neighbourhood(nodes, edges, "missing", 2).count() == 0


def test_bootstrap_draws_keep_stratum_sizes(spark, path):
    df = small_frame(spark, [("t", "g" if i < 20 else "h", i, float(i)) for i in range(50)], "task string, grp string, entity bigint, v double")
    got = relations.bootstrap_draws(df, ["task"], ["grp"], ["v"], 6, 1).groupBy("grp", "replicate").agg(F.sum("weight").alias("n")).collect()
    assert {(r["grp"], r["n"]) for r in got} == {("g", 20), ("h", 30)} and len(got) == 12


def test_chunks_pack_paragraphs_and_overlap(spark):
    bodies = ["a b c\n\nd e\n\n\n\nf g h i", "", "a b c d e f g"]
    rows = text.chunk(small_frame(spark, list(enumerate(bodies)), "id int, body string"), 5, 2).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(0, "a b c d e"), (0, "d e f g h i"), (2, "a b c d e f g")]
    assert text.chunk(small_frame(spark, [(0, bodies[0])], "id int, body string"), 5, 0).where("chunk_no = 1").first()["text"] == "f g h i"


def test_heading_path_pops_levels(spark):
    doc = "lead\n# A\nx\n### C\ny\n## B\nz\n# D\n"
    df = small_frame(spark, [(1, doc)], "doc_id bigint, text string")
    got = [(r["heading_path"], r["body"]) for r in text.sections(df).orderBy("section_no").collect()]
    assert got == [("1", "lead"), ("A", "x"), ("A > C", "y"), ("A > B", "z")]  # without a heading the document's name stands in


def test_numbers_skip_years_and_identifiers(spark):
    df = small_frame(spark, [(1, "In 2024 ACH-000123 had 1,234.50 or 12% [ref 9]; -3 left, 7-fold")], "text_id bigint, text string")
    got = [(r["token"], r["value"], r["decimals"]) for r in text.numbers_of(df).orderBy("pos").collect()]
    assert got == [("1,234.50", 1234.5, 2), ("12%", 0.12, 0), ("-3", -3.0, 0)]


def test_bm25_against_direct_formula(spark):
    docs = ["the cat sat", "the dog sat down", "a bird", "cat cat dog"]
    frame = small_frame(spark, list(enumerate(docs)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.search(small_frame(spark, [(0, "Cat, sat!")], "item_id bigint, text string"), retrieval.build_index(frame), 10).collect()}
    split = [d.split() for d in docs]
    df = {t: sum(t in s for s in split) for s in split for t in s}
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    mean = sum(map(len, split)) / len(split)
    for i, s in enumerate(split):
        want = sum((idf[t] if idf[t] >= 0 else floor) * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / mean)) for t in ("cat", "sat"))
        assert got.get(i, 0.0) == pytest.approx(max(want, 0.0), abs=1e-6)


def test_dense_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    df = small_frame(spark, v, "vec_id bigint, embedding array<double>")
    q = small_frame(spark, [(i, x) for i, x in v[:7]], "label bigint, embedding array<double>")
    a = sorted(text.dense_topk(q, df, 3, "label", "vec_id").collect())
    assert a == sorted(text.dense_topk(q, df, 3, "label", "vec_id", block=2).collect()) and all(r["vec_id"] == r["label"] for r in a if r["rank"] == 1)


def test_skip_lines_over_many_splits(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.gct").write_text("#1.2\n5 2\nid value\n" + "".join(f"{i} {i * 2}\n" for i in range(2000)))
    schema = T.StructType().add("id", "integer").add("value", "integer")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.scan_delimited(spark, str(tmp_path), schema, " ", True, 2).agg(F.count("id"), F.sum("id"), F.sum("value")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (2000, 1999000, 3998000)

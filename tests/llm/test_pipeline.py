"""Each stage of the pipeline against its definition on its own input."""

import hashlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from panelgrid.llm import pii
from panelgrid.session import clear_staged, stage
from tests.llm.test_langtags import UNLEARNED, letter_salad
from tests.llm.test_simtrie import jaccard_groups

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frames(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, step in pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF), f"test-{name}"))
    yield out
    clear_staged(spark)


def test_columns(frames):
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    assert frames[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_rejects_little(frames):
    before, after = frames[0].collect(), {r.doc_id: r for r in frames[1].collect()}
    assert len(after) > 0.97 * len(before)
    assert sum(after[r.doc_id].lang == r.lang for r in before if r.doc_id in after) > 0.97 * len(after)
    assert all(after[r.doc_id].text == r.text for r in before if r.doc_id in after)


def test_language_rejects_unlearned_texts(spark, frames):
    """Planted texts of five other languages and letter salad go, in any number of copies; planted texts of the corpus stay."""
    columns = frames[0].columns
    planted = [*UNLEARNED.values(), letter_salad()]
    rows = [dict(doc_id=-1 - i, text="\n".join([t] * (1 + i % 3)), lang=None, source="src0", n_chars=len(t)) for i, t in enumerate(planted)]
    rows += [dict(doc_id=-100 - i, text=t, lang=None, source="src0", n_chars=len(t)) for i, t in enumerate(r.text for r in frames[0].where("lang is not null").orderBy("doc_id").limit(40).collect())]
    extra = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], frames[0].schema)
    kept = dict(pipeline.STAGES)["language"](spark, frames[0].unionByName(extra), SF)
    assert sorted(r.doc_id for r in kept.where("doc_id < 0").select("doc_id").collect()) == [-100 - i for i in reversed(range(40))]


def test_one_of_each_group_stays(frames):
    """Of documents that five-word shingles with a Jaccard similarity of 0.8 or more connect, the one with the least id."""
    want = jaccard_groups([(r.doc_id, r.text) for r in frames[1].select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in frames[2].select("doc_id").collect()) == sorted(want) and len(want) < frames[1].count()


def test_no_base_span_is_left(frames):
    before, after = {r.doc_id: r for r in frames[2].collect()}, {r.doc_id: r for r in frames[3].collect()}
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d].text != after[d].text]
    assert changed and all(d in changed for d in before if pii.base_spans(before[d].text))
    assert not any(pii.base_spans(r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixture_keeps_rows_whole(frames):
    before, after = {r.doc_id: r for r in frames[3].collect()}, frames[4].collect()
    assert after and all(before[r.doc_id] == r for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_encoding_equals_library(frames):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    rows = frames[5].collect()
    assert len(rows) == frames[4].count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())


def test_empty_documents(spark, frames):
    docs = frames[0].limit(0)
    for name, step in pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (None, "the cat", "en", "a", 7), (4, "le chat " * 30000, "fr", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, SF), f"odd-{name}")
    assert docs.count() > 0


def test_extra_columns_with_clashing_names(spark, frames):
    names = ["score", "lang_pred", "certainty", "fp", "tokens", "epoch", "row", "place", "ids", "decoded", "spans", "root", "mark"]
    docs = frames[0].limit(120).select("*", *(F.lit(n).alias(n) for n in names))
    columns = docs.columns
    for name, step in pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), f"clash-{name}")
        assert docs.columns == columns and docs.where(" and ".join(f"`{n}` = '{n}'" for n in names)).count() == docs.count() > 0
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()

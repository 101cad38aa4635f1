"""Encoding against the library, on texts with runs of spaces, unknown characters, nulls and very long words."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece

from panelgrid.llm.pieces import Encoder, Vocabulary, token_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.load(PATH))


def reference(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def same(library, encoder, text):
    ids = reference(library, text)
    packed = encoder.encode(text)
    assert array("I", packed).tolist() == ids, text[:80]
    assert encoder.decode(packed) == library.decode(ids), text[:80]


@pytest.mark.parametrize("text", ["", " ", "a", "  a", "a ", "\n", "\n\n a\t b", "▁", "a▁b", "\x00", "<s></s><unk><0x41>", "héé ñandú", "日本語のテスト", "👩‍👩‍👧 ok", "a" * 5000, "ab" * 3000, "=" * 999, "...!!!???", "x́y"])
def test_edges(library, encoder, text):
    same(library, encoder, text)


def test_runs_of_spaces(library, encoder):
    for n in range(70):
        same(library, encoder, " " * n)
        same(library, encoder, "x" + " " * n + "the end")
        same(library, encoder, "x" + " " * n + "日" + " " * (n % 17) + "\n")


def test_random_texts(library, encoder):
    rng = random.Random(5)
    for alphabet in ("ab ", "the and of in ", "aeiounrst \n", "éèaàü日本 ", "0123456789.,- ", "=-_#* ", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(150):
            same(library, encoder, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))))
    names = [p for p, k in zip(encoder.v.pieces, encoder.v.kinds) if k == "n"]
    for _ in range(1500):
        same(library, encoder, "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(1, 6))))


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in token_digests(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = reference(library, row.text)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(1, None, "x", 3), (1, "", "x", 3), (2, "a b", None, 4), (2, "a b", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = sorted(tuple(r)[:2] for r in token_digests(docs, PATH).collect())
    assert got == [(1, 2), (1, 2), (2, 4), (2, 4)]
    assert token_digests(docs.limit(0), PATH).count() == 0

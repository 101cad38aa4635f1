"""The corpus pipeline: each stage reads the documents that its predecessor wrote, and all of them.

Languages are identified and texts whose words belong to none clearly, or that letter trigrams tell from every learned
language, are rejected; of near-duplicates one document stays; personal data is masked; documents are mixed to target
weights; what is left is encoded.

Defined cases: a null text, and one without letters, is rejected by the first stage; few words never suffice for that by
their trigrams. Rows with a null id, repeated rows and extra columns of any name pass through as any others, but that equal
texts are near-duplicates. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.llm import langtags, mixing, pieces, pii, simtrie
from panelgrid.llm.queries import piece_model, table
from panelgrid.session import drop_staged, stage, staged_paths

MEMO_SEGMENTS = 150_000  # kept by an encoding worker, which shares its executor with what earlier stages left in memory
MEMO_WORDS = 100_000  # kept by a tagging worker, for the same reason
LEAST_CERTAINTY = 0.4  # of the words' languages, below which a document is rejected
LEAST_EVIDENCE = -20.0  # nats, below which a text is rejected as of no learned language (odds of 5e8 to 1 against them)
ORACLE_SQL = None  # trained models and encoding cannot be stated in SQL; tests compare each stage with its definition


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; `lang` becomes the predicted one."""
    lines = langtags.fit_sample(docs, F.col("lang"), F.lit(True))
    tagged = langtags.tag_documents(docs, langtags.fit(lines), docs.columns, prefix="__", most=MEMO_WORDS)
    kept = tagged.where((F.col("__lang_pred") != "und") & (F.col("__certainty") >= LEAST_CERTAINTY) & (F.col("__evidence") >= LEAST_EVIDENCE))
    return kept.select(*(F.col("__lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simtrie.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; `n_chars` follows the text."""
    clean = pii.redact(docs, pii.train(pii.labelled_regions(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights; one taken by two epochs comes twice."""
    return mixing.keep_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text of every document."""
    return pieces.token_digests(docs, piece_model(), most=MEMO_SEGMENTS)


_LEFT: list[str] = []  # folders that stages staged for themselves


def alone(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what stages before it staged for themselves: their results are written when the next one is called.
    Folders that its own documents are read from stay."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, _LEFT, docs)
        before = set(staged_paths())
        out = step(spark, docs, sf_dir)
        _LEFT[:] = [p for p in staged_paths() if p in _LEFT or p not in before]
        return out

    return call


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (step.__name__, alone(step)) for step in (language, near_duplicates, personal_data, mixture, encode)
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""Registered queries of the subpackage: one for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelgrid.llm import archives, hosts, riskrules, termaudit, turntrie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The installed vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text of every document."""
    from panelgrid.llm.pieces import token_digests

    return token_digests(table(spark, sf_dir, "documents"), piece_model())


def op1_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    from panelgrid.llm.hosts import judge_corpus

    return judge_corpus(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to the weights of domains, languages and sources."""
    from panelgrid.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document to the good ones."""
    from panelgrid.llm.crossent import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    from panelgrid.llm.nearest import nearest_of_corpus

    return nearest_of_corpus(table(spark, sf_dir, "embeddings"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archives of all pages, resolved."""
    from panelgrid.llm.archives import archive_corpus

    return archive_corpus(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from panelgrid.llm.langtags import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from panelgrid.llm.simtrie import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    from panelgrid.llm.riskrules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    from panelgrid.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from panelgrid.llm.maintext import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their terms."""
    return termaudit.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES["op7_near_duplicates"] = op7_near_duplicates
QUERIES["op1_url_verdicts"] = op1_url_verdicts
ORACLES["op1_url_verdicts"] = hosts.ORACLE
QUERIES["op2_mixture"] = op2_mixture
QUERIES["op3_cross_entropy"] = op3_cross_entropy
QUERIES["op4_nearest"] = op4_nearest
QUERIES["op5_archives"] = op5_archives
ORACLES["op5_archives"] = archives.ORACLE
QUERIES["op6_language"] = op6_language
QUERIES["op8_quality"] = op8_quality
ORACLES["op8_quality"] = riskrules.ORACLE
QUERIES["op9_personal_data"] = op9_personal_data
QUERIES["op10_encode"] = op10_encode
QUERIES["op11_main_text"] = op11_main_text
QUERIES["op12_source_audit"] = op12_source_audit
ORACLES["op12_source_audit"] = termaudit.ORACLE
QUERIES["op13_prefix_trie"] = op13_prefix_trie
ORACLES["op13_prefix_trie"] = turntrie.ORACLE

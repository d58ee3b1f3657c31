"""The driver's queries of this subpackage: thin calls of the operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import bpe, embeddings, langid, linededup, minhash, mixing, pii, simhash, toxicity, urlfilter
from siltworks.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of all ``documents``, with the hash of the text that is left."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at a cosine of 0.9."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all ``documents`` at a multiset Jaccard similarity of 0.8 over five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all ``documents`` and of their edited texts."""
    return simhash.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all ``documents``, learned from ``labels``."""
    return toxicity.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all ``documents``."""
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents`` by the public byte-level vocabulary, and the text that they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every URL of ``pages``."""
    listed = urlfilter.rules(spark, urlfilter.DOMAIN_RULES, urlfilter.PATTERN_RULES)
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_line_dedup,
        op3_embedding_near_dedup,
        op4_minhash_near_dedup,
        op5_fingerprints,
        op6_toxicity,
        op7_source_mixing,
        op8_pii,
        op9_bpe,
        op10_url_filters,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op7_source_mixing": mixing.ORACLE_SQL,
    "op10_url_filters": urlfilter.oracle_sql(),
}

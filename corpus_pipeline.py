"""A training corpus from ``documents``: language ID, line dedup, MinHash near-dedup, source mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all but the last
return the columns of documents, with ``n_chars`` that of the text that is left.

Results in odd cases: documents without text or letters go in the first stage, and all of them do where no training document has a language.
A document whose every line goes stays with an empty text, gives nothing to the mix and so isn't encoded. Rows that repeat an id
and text become one in the third stage. Rows with a null id stay until the mix. Other columns are kept until the last
stage, whatever their names. An empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import bpe, langid, linededup, minhash, mixing
from siltworks.llm.common import cut, table
from siltworks.llm.queries import tokenizer_path


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or of no language with enough certainty, go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier line equals or is within an edit of."""
    return _recounted(linededup.dedup(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once or twice, the last of a source cut where its share ends."""
    return _recounted(mixing.mix(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of the mix; decoding the ids gives the text again."""
    rows = bpe.encoded(docs, tokenizer_path(), keep=("doc_id", "source"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", encode),
]

#: SQL can't express the trained model of the first stage, the signatures of the third and the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each cut off from the lineage of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs

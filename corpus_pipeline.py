"""A training corpus from raw documents: quality, exact and near duplicates, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.bpe import encode, word_bpe
from tidewire.llm.common import save, table
from tidewire.llm.exact_dedup import exact_dedup
from tidewire.llm.mixing import mix
from tidewire.llm.quality import keep_good
from tidewire.llm.simhash import near_dedup


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs, scores under one half go."""
    return keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating; a row is repeated as often as the mix takes its document."""
    return mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, which has become ids."""
    return encode(docs, word_bpe(), keep=[c for c in docs.columns if c not in ("doc_id", "text")])


STAGES = [
    ("quality classifier", drop_poor),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("bpe encoding", to_tokens),
]

#: The classifier, SimHash, the random rounding and BPE are beyond SQL; tests hold each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

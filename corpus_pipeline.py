"""From raw documents to packed training sequences.

Each stage reads what the stage before wrote: documents with poor quality go,
one document of each near-duplicate group stays, secrets are masked, sources
are mixed to their target weights, and the rest is packed. The last stage
returns the pieces of the sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramvec.llm.common import staged, table
from gramvec.llm.mixing import mix_documents
from gramvec.llm.packing import pack
from gramvec.llm.risk_rules import keep_good
from gramvec.llm.secret_index import redact
from gramvec.llm.simhash_pivots import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs, which ``labels`` decides."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; a document taken twice has two rows."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the fingerprints nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

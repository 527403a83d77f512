"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.llm.common import table
from gramvec.llm.html_region import extract
from gramvec.llm.huffman_ids import huffman_round_trip
from gramvec.llm.language_codes import identify
from gramvec.llm.merkle_butterfly import lowered, verified_manifest
from gramvec.llm.merkle_butterfly import oracle as merkle_oracle
from gramvec.llm.mixing import mix_digest
from gramvec.llm.mixing import oracle as mixing_oracle
from gramvec.llm.packing import pack
from gramvec.llm.phrase_fingerprints import collocations
from gramvec.llm.phrase_fingerprints import oracle as phrase_oracle
from gramvec.llm.risk_rules import quality_verdicts
from gramvec.llm.scaled_sketch import edit_likeness
from gramvec.llm.secret_index import listed, secret_spans
from gramvec.llm.secret_index import oracle as secret_oracle
from gramvec.llm.simhash_pivots import near_duplicates
from gramvec.llm.subword_quality import quality_scores
from gramvec.llm.warc_bundles import warc_round_trip

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, one row per piece."""
    return pack(table(spark, sf_dir, "documents"))


@register("op9_huffman_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Huffman-coded id files, one row per document as read back."""
    return huffman_round_trip(table(spark, sf_dir, "documents"))


@register("op10_risk_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and certified verdict of all documents."""
    found = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register(
    "op8_warc_bundles",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC bundles, one row per record as read back."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


@register("op5_secret_index", secret_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secret_spans(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind_no"] < 3)
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@register("op6_mixing", mixing_oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target weights."""
    return mix_digest(table(spark, sf_dir, "documents"))


@register("op7_language_codes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the folds that aren't held out."""
    return identify(table(spark, sf_dir, "documents"))


@register("op3_html_region")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


@register("op2_scaled_sketch")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents against their edited and next texts."""
    return edit_likeness(table(spark, sf_dir, "documents"))


@register("op1_simhash_pivots")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op11_subword_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents, learned from the folds that aren't held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_merkle_butterfly", merkle_oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, held against a copy in which every third text is in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verified_manifest(table(spark, sf_dir, "documents"), tampered, {"text": lowered(F.col("text"))})


@register("op13_phrase_fingerprints", phrase_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents, per language."""
    return collocations(table(spark, sf_dir, "documents"))

"""Corpus sources.

* ``read_documents``: the ``documents`` parquet table, re-split so that one big
  file does not become one task.
* ``read_corpus``: a text file or a directory of text files, scanned line by
  line, so any large file is split by the scan. Sentences that run over line
  ends or splits are put together again; each is one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.functions.text import STOP_MARK, WS, mark_sentences
from gramvec.operators.ordinals import global_ordinal, materialize, ordinal_in_place
from gramvec.session import require_path

DOCUMENT_COLUMNS = ["doc_id", "lang", "text"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_documents(spark: SparkSession, sf_dir: str, min_partitions: int | None = None) -> DataFrame:
    """``documents(doc_id, lang, text)``; only the needed columns reach the scan.

    The driver's parquet files are single row groups, so the scan alone is one
    task; a round-robin repartition spreads the regex-heavy sentence work.
    At cluster scale (many files / row groups) the scan itself is parallel and
    ``min_partitions`` can stay unset.
    """
    df = read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    n = min_partitions if min_partitions is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() < n:
        df = df.repartition(n)
    return df


def read_text_corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Other text tables as corpora: ``benchmark`` (item_id) and ``conversations`` (conv_id, turn)."""
    if name == "benchmark":
        return read_table(spark, sf_dir, name).select(
            F.col("item_id").alias("doc_id"), F.lit("en").alias("lang"), "text"
        )
    if name == "conversations":
        # one document per turn, ordered by (conv_id, turn)
        df = read_table(spark, sf_dir, name).select("conv_id", "turn", "text")
        df = global_ordinal(df, ["conv_id", "turn"], "doc_id")
        return df.select("doc_id", F.lit("en").alias("lang"), "text")
    if name == "documents":
        return read_documents(spark, sf_dir)
    raise ValueError(f"unknown corpus table {name}")


def read_corpus(spark: SparkSession, path: str, language: str = "german") -> DataFrame:
    """Text file or directory of files (not recursive) -> ``documents(doc_id, lang, text)``, a row per sentence.

    Lines stay where the scan finds them, in file order (path, then position):
    a task counts the sentence starts of each file part it reads, and the parts
    before are added from one number a part. A line is cut after its sentence
    marks; the first cut piece goes on with what the lines before left open. The
    number of a sentence is the count of sentence starts before it. A file
    always starts a sentence. Text without any sentence mark is one sentence and
    so one row. Line ends inside a sentence are kept as one line feed; blank
    sentences are left out. One shuffle, to ranges of sentence numbers, puts
    sentences together and orders them.
    """
    require_path(spark, path, "corpus")
    pieces = mark_sentences(F.concat("value", F.lit("\n")), F.lit(language))
    raw = (
        spark.read.option("recursiveFileLookup", "false")
        .text(path)
        .select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), pieces.alias("pieces"))
    )
    lines = materialize(raw.mapInArrow(_started, f"{LINE_SCHEMA}, pieces array<string>"), "lines")
    parts = lines.groupBy("_path", "_block").agg(F.sum(F.size("pieces") - 1).cast("long").alias("n")).orderBy("_path", "_block")
    before, running, last = [], -1, None
    for r in parts.collect():
        running += r["_path"] != last
        before.append((r["_path"], r["_block"], len(before), running))
        running, last = running + r["n"], r["_path"]
    before = spark.createDataFrame(before, "_path string, _block long, part int, before long")
    numbered = lines.join(F.broadcast(before), ["_path", "_block"])
    found = numbered.select("part", "line", (F.col("before") + F.col("open")).alias("open"), F.posexplode("pieces").alias("k", "piece"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = found.select((F.col("open") + F.col("k")).alias("sentence"), "part", "line", "k", "piece").repartitionByRange(n, "sentence")
    joined = found.groupBy("sentence").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "line", "k", "piece")))["piece"], "").alias("text")
    )
    text = F.regexp_replace(F.regexp_replace("text", f"^{WS}+|{WS}+$", ""), STOP_MARK, ".")
    # exploded, so that the filter doesn't make the text again
    rows = joined.select("sentence", F.explode(F.array(text)).alias("text")).where("text <> ''").sortWithinPartitions("sentence")
    docs, _ = ordinal_in_place(rows, "doc_id")
    return docs.select("doc_id", F.lit(language).alias("lang"), "text")


LINE_SCHEMA = "_path string, _block long, line long, open long"


def _started(records):
    """Lines in the order of the scan with, in their file part, their number and the sentence starts before them."""
    part, line, opened = None, 0, 0
    for b in records:
        paths, blocks = b["_path"].dictionary_encode(), b["_block"].to_numpy()
        places = paths.indices.to_numpy()
        starts = b["pieces"].value_lengths().to_numpy() - 1
        cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if lo == hi:
                continue
            here = (paths.dictionary[places[lo]].as_py(), blocks[lo])
            if here != part:
                part, line, opened = here, 0, 0
            sums = opened + np.cumsum(starts[lo:hi], dtype=np.int64)
            some = b.slice(lo, hi - lo)
            cols = [some["_path"], some["_block"], pa.array(line + np.arange(hi - lo)), pa.array(sums - starts[lo:hi]), some["pieces"]]
            yield pa.RecordBatch.from_arrays(cols, ["_path", "_block", "line", "open", "pieces"])
            line, opened = line + hi - lo, int(sums[-1])

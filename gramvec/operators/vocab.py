"""Word counts, corpus size, drop probabilities and the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.operators.ordinals import global_ordinal
from gramvec.operators.text import tokens

# position of an occurrence packed into one decimal so the first occurrence is
# a fixed-width min() (hash aggregation) instead of a min over a struct (sort
# aggregation): doc_id * 2^62 + sent_idx * 2^31 + pos, all terms non-negative.
_P62 = 4611686018427387904
_P31 = 2147483648
_POS_TYPE = "decimal(38,0)"


def _packed_sentence():
    return (
        F.col("doc_id").cast(_POS_TYPE) * F.lit(_P62).cast(_POS_TYPE) + F.col("sent_idx").cast(_POS_TYPE) * F.lit(_P31).cast(_POS_TYPE)
    ).cast(_POS_TYPE)


def sentence_word_counts(sents: DataFrame, count_empty: bool = True) -> DataFrame:
    """``word_counts`` of the tokens of ``sents``; a sentence's place is packed once, not for each of its tokens."""
    placed = sents.select("words", F.explode(F.array(_packed_sentence())).alias("_at"))
    return word_counts(tokens(placed, count_empty, keep=("_at",)))


def word_counts(toks: DataFrame) -> DataFrame:
    """``word_counts(word, cnt, first_doc, first_sent, first_pos)``.

    A hot word is no problem: partial (map-side) aggregation sends one row
    per word and task into the shuffle.
    """
    at = F.col("_at") if "_at" in toks.columns else _packed_sentence()
    agg = toks.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.min((at + F.col("pos").cast(_POS_TYPE)).cast(_POS_TYPE)).alias("_first"))
    first = F.col("_first")
    return agg.select(
        "word",
        "cnt",
        F.floor(first / F.lit(_P62)).cast("bigint").alias("first_doc"),
        F.floor((first % F.lit(_P62)) / F.lit(_P31)).cast("int").alias("first_sent"),
        (first % F.lit(_P31)).cast("int").alias("first_pos"),
    )


def corpus_total(counts: DataFrame) -> DataFrame:
    """One-row ``(total)``: the number of tokens (A2)."""
    return counts.agg(F.sum("cnt").cast("bigint").alias("total"))


def drop_p_expr(threshold: float, total) -> "F.Column":
    return F.lit(1.0) - F.sqrt(F.lit(float(threshold)) / (F.col("cnt") / total))


def drop_probability(counts: DataFrame, threshold: float) -> DataFrame:
    """``(word, cnt, drop_p)`` with ``drop_p = 1 - sqrt(t / (cnt / total))`` for every word.

    The corpus total is a scalar subquery: evaluated once, used as a value.
    """
    total = corpus_total(counts).scalar()
    return counts.select("word", "cnt", drop_p_expr(threshold, total).alias("drop_p"))


def frequent_words(dropp: DataFrame) -> DataFrame:
    """Words that can be dropped (``drop_p > 0``), i.e. frequency above the threshold.

    There are fewer than ``1 / threshold`` of them (10,000 at the default), a
    bound that holds at any corpus size, so this table is always broadcastable.
    """
    return dropp.where(F.col("drop_p") > 0).select("word", "cnt", "drop_p")


def rank_cutoff(counts: DataFrame, k: int) -> int:
    """Largest power of two ``c`` with at least ``k`` words of count >= ``c`` (1 if none).

    Every word of the top ``k`` has a count >= ``c``, so ranking only those
    words is exact; it drops the long tail of rare words (most of the
    distinct words) before the sort. One aggregation, 63 numbers returned.
    """
    levels = [1 << i for i in range(63)]
    row = counts.agg(*[F.sum((F.col("cnt") >= c).cast("long")).alias(f"c{i}") for i, c in enumerate(levels)]).first()
    best = 1
    for i, c in enumerate(levels):
        n = row[f"c{i}"]
        if n is not None and n >= k:
            best = c
    return best


def vocabulary(counts: DataFrame, vocabulary_size: int, threshold: float) -> DataFrame:
    """``vocab(word, word_id, cnt, drop_p)``: the ``vocabulary_size`` most frequent words.

    Ids are dense from 0 by count descending, ties by first occurrence. The
    ranking is a distributed global ordinal (range partitioning), never a
    single-task top-k merge, over the words above an exact count cutoff.
    """
    c = rank_cutoff(counts, vocabulary_size)
    ranked = global_ordinal(
        counts.where(F.col("cnt") >= c).select("word", "cnt", "first_doc", "first_sent", "first_pos"),
        [F.col("cnt").desc(), "first_doc", "first_sent", "first_pos"],
        "rank",
    )
    total = corpus_total(counts).scalar()
    return ranked.where(F.col("rank") < int(vocabulary_size)).select(
        "word", F.col("rank").cast("int").alias("word_id"), "cnt", drop_p_expr(threshold, total).alias("drop_p")
    )

"""Sentences and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.functions.text import clean_sentence_words, is_blank, mark_sentences

#: Between words that travel as one string; no letter, so no word has it.
WORD_MARK = "\u0001"


def sentences(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> ``sentences(doc_id, sent_idx, words array<string>)``.

    ``sent_idx`` is the chunk position in the document; blank chunks (empty or
    whitespace-only text, trailing whitespace) are no sentences. A sentence
    without letters keeps an empty ``words`` array. A ``lang`` column decides
    which abbreviations end no sentence.
    """
    lang = F.col("lang") if "lang" in documents.columns else None
    chunks = documents.select("doc_id", F.posexplode(mark_sentences("text", lang)).alias("sent_idx", "raw"))
    # exploded, so that filters on the words above don't make them again
    return chunks.where(~is_blank("raw")).select(
        "doc_id", F.col("sent_idx").cast("int").alias("sent_idx"), F.explode(F.array(clean_sentence_words("raw"))).alias("words")
    )


def clean_sentences(sents: DataFrame) -> DataFrame:
    """Display form: the words of each sentence joined by one space."""
    return sents.select("doc_id", "sent_idx", F.array_join("words", " ").alias("sentence"))


def tokens(sents: DataFrame, count_empty: bool = True, keep: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """``tokens(doc_id, sent_idx, pos, word)``: one row per word occurrence, with ``keep`` of its sentence.

    With ``count_empty`` a sentence without words yields the empty word at
    pos 0 (the original splits the empty sentence string into ``['']``).
    """
    words = F.col("words")
    if count_empty:
        words = F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)
    return sents.select(*keep, F.posexplode(words).alias("pos", "word"))

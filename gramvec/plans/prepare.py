"""Preprocessing composite (M1): documents -> vocabulary and training batches.

Order follows the original pipeline: sentences, tokens, counts, total,
drop probabilities, top-k vocabulary; then pairs of sentences with the drop
probabilities, labels and n-gram buckets of their words -> subsample -> label ->
number -> batch -> pad. Written to the shared checkpoint folder on the way:
sentences, word counts, known words and the samples (in chunks), so the
expensive upstream runs once and lineage stays short. Only with a vocabulary
too large to broadcast are the words looked up by a shuffle of tokens.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.operators import batches as BA
from gramvec.operators import coded as CO
from gramvec.operators import pairs as PA
from gramvec.operators import samples as SA
from gramvec.operators import text as TX
from gramvec.operators import vocab as VO
from gramvec.operators.joins import fits
from gramvec.operators.ordinals import materialize
from gramvec.params import Params


class Pipeline:
    """Lazily built stages of preprocessing over one ``documents`` DataFrame."""

    def __init__(self, documents: DataFrame, params: Params, materialize_counts: bool = True, counts_only: bool = False):
        """``counts_only``: no pairs follow, so the sentences are read by the counts alone and not written."""
        self.documents = documents
        self._counts_only = counts_only
        self.p = params
        self.spark: SparkSession = documents.sparkSession
        self._mat = materialize_counts

    @cached_property
    def sentences(self) -> DataFrame:
        """Written once: the counts and the pairs both read them."""
        sents = TX.sentences(self.documents)
        return materialize(sents, "sentences") if self._mat else sents

    @cached_property
    def tokens(self) -> DataFrame:
        return TX.tokens(self.sentences, self.p.count_empty)

    @cached_property
    def word_counts(self) -> DataFrame:
        sents = TX.sentences(self.documents) if self._counts_only else self.sentences
        wc = VO.sentence_word_counts(sents, self.p.count_empty)
        return materialize(wc, "word_counts") if self._mat else wc

    @cached_property
    def drop_probability(self) -> DataFrame:
        return VO.drop_probability(self.word_counts, self.p.rejection_threshold)

    @cached_property
    def frequent(self) -> DataFrame:
        return VO.frequent_words(self.drop_probability)

    @cached_property
    def vocab(self) -> DataFrame:
        return VO.vocabulary(self.word_counts, self.p.vocabulary_size, self.p.rejection_threshold)

    @cached_property
    def pairs(self) -> DataFrame:
        return PA.skipgram_pairs(self.sentences, self.p.skip_window, self.p.seed, self.p.passes)

    @cached_property
    def word_buckets(self) -> DataFrame:
        return self.word_counts.select("word", SA.buckets_of("word", self.p.ngram_size, self.p.num_buckets).alias("bucket_ids"))

    @property
    def _direct(self) -> bool:
        """Whether the words that pairs look up, bounded in number, fit a broadcast."""
        return fits(self.spark, self.p.vocabulary_size + math.ceil(1 / self.p.rejection_threshold), PA.VOCAB_ROW_BYTES)

    def _direct_pairs(self, in_order: bool = False) -> DataFrame:
        words = materialize(CO.known_words(self.vocab, self.frequent), "known-words")
        return CO.direct_pairs(self.sentences, words, self.p.skip_window, self.p.seed, self.p.passes, in_order)

    def _coded_tokens(self) -> DataFrame:
        """Tokens with what the dictionary, written once, has of their words."""
        words = CO.dictionary(self.drop_probability, self.vocab, self.p.vocabulary_size)
        return CO.coded_tokens(self.sentences, materialize(words, "dictionary"), self.frequent)

    @cached_property
    def coded_pairs(self) -> DataFrame:
        """Pairs with what decides on both words, in any order."""
        if self._direct:
            return self._direct_pairs()
        coded = CO.coded_sentences(self._coded_tokens(), self.p.skip_window)
        return CO.coded_pairs(coded, self.p.skip_window, self.p.seed, self.p.passes)

    @cached_property
    def samples(self) -> DataFrame:
        """Subsampled, labelled pairs."""
        return CO.coded_samples(self.coded_pairs, self.p.seed)

    @cached_property
    def hashed(self) -> DataFrame:
        return self.hashed_as()

    def hashed_as(self, text: bool = False) -> DataFrame:
        """Samples with the buckets of their targets (P9, P12), in any order; with ``text`` joined by commas where they are made."""
        return self.samples.withColumn("bucket_ids", SA.buckets_of("target", self.p.ngram_size, self.p.num_buckets, text=text))

    @property
    def _ordered_samples(self) -> DataFrame:
        """Samples in stream order across partitions and inside each."""
        p = self.p
        if self._direct:
            pairs = self._direct_pairs(in_order=True)
        else:
            sentences = CO.ordered_sentences(materialize(self._coded_tokens(), "coded-tokens"), p.skip_window, p.passes)
            pairs = CO.coded_pairs(sentences, p.skip_window, p.seed)
        return CO.coded_samples(pairs, p.seed)

    @cached_property
    def ordered(self) -> DataFrame:
        """Samples with their ordinal and batch, written once."""
        return BA.sample_ordinals(self._ordered_samples, self.p.batch_size)[0]

    @cached_property
    def _chunks(self) -> tuple[DataFrame, int]:
        return BA.sample_chunks(self._ordered_samples, self.p.batch_size)

    @property
    def total_samples(self) -> int:
        return self._chunks[1]

    @property
    def total_batches(self) -> int:
        """Batches are numbered from 0 to below this."""
        return BA.full_batches(self.total_samples, self.p.batch_size)

    def _batches(self, padded: bool = False, words: bool = False) -> DataFrame:
        return BA.batches(*self._chunks, self.p.batch_size, self.p.ngram_size, self.p.num_buckets, padded, words)

    @cached_property
    def batches(self) -> DataFrame:
        return self._batches()

    @cached_property
    def padded_batches(self) -> DataFrame:
        """The same, padded where they are made."""
        return self._batches(padded=True)

    @cached_property
    def worded_batches(self) -> DataFrame:
        """The same with words, which training hashes and pads where it reads them (``batches.hashed_batches``)."""
        return self._batches(words=True)


def prepare(documents: DataFrame, params: Params, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Write ``vocab`` and the sharded ``batches`` under ``out_dir``; return both read back.

    Raises ``Warning`` if not a single full batch could be formed (as the
    original writer does).
    """
    from gramvec.sources.batch_io import write_batches, read_batches

    pl = Pipeline(documents, params)
    spark = documents.sparkSession
    vocab_path = f"{out_dir.rstrip('/')}/vocab"
    pl.vocab.write.mode("overwrite").parquet(vocab_path)
    batches_path = f"{out_dir.rstrip('/')}/batches"
    write_batches(pl.padded_batches, batches_path, params.num_batch_files)
    return spark.read.parquet(vocab_path), read_batches(spark, batches_path, params.batch_size)

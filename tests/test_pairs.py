"""Skip-gram pairs, repeats, subsampling and label lookup."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramvec.operators import coded as CO
from gramvec.operators import pairs as PA
from gramvec.operators import samples as SA
from gramvec.operators import text as TX
from gramvec.operators import vocab as VO
from gramvec.operators.ordinals import materialize
from tests.conftest import SMALL_CORPUS, docs


@pytest.fixture()
def small_sents(spark):
    return TX.sentences(docs(spark, [SMALL_CORPUS]))


def test_first_pairs_within_window(small_sents):
    pairs = PA.skipgram_pairs(small_sents, 5, 42).collect()
    first = [r for r in pairs if r["sent_idx"] == 0 and r["pos"] == 0]
    assert first and all(r["target"] == "dies" for r in first)
    assert {r["context"] for r in first} <= {"ist", "eine", "test", "datei"}
    ist = [r for r in pairs if r["sent_idx"] == 0 and r["pos"] == 1]
    assert {r["context"] for r in ist} <= {"dies", "eine", "test", "datei"}


def test_pairs_offsets_and_window(spark, small_sents):
    rows = PA.skipgram_pairs(small_sents, 2, 7).collect()
    by_tok = {}
    for r in rows:
        by_tok.setdefault((r["sent_idx"], r["pos"]), []).append(r["off"])
    lengths = {0: 5, 1: 5, 2: 3}
    for (si, pos), offs in by_tok.items():
        wants = [[o for o in range(-m, m + 1) if o != 0 and 0 <= pos + o < lengths[si]] for m in (1, 2)]
        assert sorted(offs) in wants


def test_pairs_are_reproducible_and_seeded(small_sents):
    a = sorted(tuple(r) for r in PA.skipgram_pairs(small_sents, 5, 1).collect())
    b = sorted(tuple(r) for r in PA.skipgram_pairs(small_sents, 5, 1).collect())
    assert a == b


def test_repeat_passes(spark):
    sents = TX.sentences(docs(spark, ["a b", "c d"]))
    one = PA.skipgram_pairs(sents, 1, 3, passes=1).count()
    three = PA.skipgram_pairs(sents, 1, 3, passes=3)
    assert one == 2 * 2
    assert three.count() == 3 * one
    assert sorted(r["pass"] for r in three.select("pass").distinct().collect()) == [0, 1, 2]


def test_lookup_label_golden(spark, small_sents):
    counts = VO.word_counts(TX.tokens(small_sents))
    vocab = VO.vocabulary(counts, 5, 1e-4)
    pairs = spark.createDataFrame([(0, 0, 0, 0, 1, "bla", "ist"), (0, 0, 0, 0, 2, "bla", "testtext")],
                                  "pass int, doc_id long, sent_idx int, pos int, off int, target string, context string")
    got = [(r["target"], r["label"]) for r in PA.lookup_label(pairs, vocab, 5).collect()]
    assert got == [("bla", 1)]


def test_subsample_keep_rate(spark):
    # one very frequent word among rare ones: keep rate ~ sqrt(t/f) for pairs with it
    def letters(i):
        out = ""
        while True:
            out = chr(97 + i % 26) + out
            i //= 26
            if i == 0:
                return "q" + out

    text = " ".join(("the" if i % 2 == 0 else letters(i)) for i in range(4000)) + "."
    sents = TX.sentences(docs(spark, [text]))
    sents = sents.select("doc_id", "sent_idx", F.transform("words", lambda w: w).alias("words"))
    counts = VO.word_counts(TX.tokens(sents))
    t = 0.01
    dp = VO.drop_probability(counts, t)
    freq = VO.frequent_words(dp)
    assert {r["word"] for r in freq.collect()} == {"the"}
    pairs = PA.skipgram_pairs(sents, 1, 11)
    kept = PA.subsample(pairs, freq, 11)
    kinds = Counter()
    for r in pairs.groupBy((F.col("target") == "the").alias("t"), (F.col("context") == "the").alias("c")).count().collect():
        kinds[(r["t"], r["c"])] += r["count"]
    keep = Counter()
    for r in kept.groupBy((F.col("target") == "the").alias("t"), (F.col("context") == "the").alias("c")).count().collect():
        keep[(r["t"], r["c"])] += r["count"]
    rate = keep[(True, False)] / kinds[(True, False)]
    expected = (0.01 / 0.5) ** 0.5
    assert abs(rate - expected) < 0.05
    assert keep[(False, False)] == kinds[(False, False)]


def _tables(sents, threshold, vocabulary_size):
    counts = VO.word_counts(TX.tokens(sents))
    dp = VO.drop_probability(counts, threshold)
    return counts, dp, VO.vocabulary(counts, vocabulary_size, threshold), VO.frequent_words(dp)


@pytest.mark.parametrize("limit, chunk", [("67108864", 4096), ("0", 4096), ("67108864", 4)])
def test_coded_sentences_equal_pair_joins(spark, small_sents, limit, chunk):
    """The same rows as joins on pairs: dictionary broadcast, salted shuffle, sentences cut into chunks."""
    counts, dp, vocab, frequent = _tables(small_sents, 0.05, 6)
    pairs = PA.skipgram_pairs(small_sents, 3, 5, passes=4)
    kept = PA.subsample(pairs, frequent, 5, 0.05)
    want = PA.lookup_label(kept, vocab, 6).join(SA.word_buckets(counts.select("word"), 3, 1000), F.col("target") == F.col("word")).drop("word")
    spark.conf.set("gramvec.broadcast.maxBytes", limit)
    try:
        words = materialize(CO.dictionary(dp, vocab, 6, SA.word_buckets(counts.select("word"), 3, 1000)), "dictionary")
        made = CO.coded_pairs(CO.coded_sentences(CO.coded_tokens(small_sents, words, frequent), 3, chunk), 3, 5, 4)
        sub = CO.coded_subsample(made, 5).select(*PA.PAIR_KEY, F.col("tgt")["word"], F.col("ctx")["word"])
        got = CO.coded_samples(made, 5)
        assert sorted(map(tuple, sub.collect())) == sorted(map(tuple, kept.collect()))
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))
    finally:
        spark.conf.unset("gramvec.broadcast.maxBytes")


def test_no_join_and_no_shuffle_above_the_pairs(spark, small_sents):
    counts, dp, vocab, frequent = _tables(small_sents, 0.05, 6)
    words = materialize(CO.dictionary(dp, vocab, 6), "dictionary")
    tokens = materialize(CO.coded_tokens(small_sents, words, frequent), "coded-tokens")
    for passes in (1, 3):  # the one exchange is the range shuffle of tokens, which the grouping keeps
        samples = CO.coded_samples(CO.coded_pairs(CO.ordered_sentences(tokens, 3, passes), 3, 5), 5)
        plan = samples._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan and "Join" not in plan


def test_repeated_documents_keep_their_own_sentences(spark):
    twice = TX.sentences(docs(spark, ["one two three four. five six."]).union(docs(spark, ["one two three four. five six."])))
    counts, dp, vocab, frequent = _tables(twice, 0.05, 6)
    words = materialize(CO.dictionary(dp, vocab, 6), "dictionary")
    got = CO.coded_pairs(CO.coded_sentences(CO.coded_tokens(twice, words, frequent), 3), 3, 5)
    want = PA.skipgram_pairs(twice, 3, 5)
    got = got.select(*PA.PAIR_KEY, F.col("tgt")["word"], F.col("ctx")["word"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunks_of_a_long_sentence(spark):
    """A text without marks makes many rows, and each pair once, in stream order."""
    long = TX.sentences(docs(spark, [" ".join(f"w{i % 37}" + "xyz"[i % 3] for i in range(900)), "a b c"]))
    counts, dp, vocab, frequent = _tables(long, 0.05, 60)
    words = materialize(CO.dictionary(dp, vocab, 60), "dictionary")
    tokens = materialize(CO.coded_tokens(long, words, frequent), "coded-tokens")
    for chunk in (6, 100, 450, 899, 900, 901):
        coded = CO.ordered_sentences(tokens, 5, 1, chunk)
        assert coded.count() == -(-900 // chunk) + 1
        got = CO.coded_pairs(coded, 5, 5).select(*PA.PAIR_KEY, F.col("tgt")["word"], F.col("ctx")["word"])
        want = sorted(map(tuple, PA.skipgram_pairs(long, 5, 5).collect()))
        assert sorted(map(tuple, got.collect())) == want
        assert list(map(tuple, got.collect())) == want

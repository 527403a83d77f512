"""Text made once, pairs looked up in broadcasts, buckets hashed where words stand."""

import re

import pytest
from pyspark.sql import functions as F

from gramvec.functions import text as T
from gramvec.operators import coded as CO
from gramvec.operators import pairs as PA
from gramvec.operators import samples as SA
from gramvec.operators import text as TX
from gramvec.operators import vocab as VO
from gramvec.operators.ordinals import materialize
from gramvec.params import Params
from gramvec.plans.prepare import Pipeline
from tests.conftest import SMALL_CORPUS, UNPUNCTUATED, docs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_windows_are_made_once(spark):
    made = plan(PA.skipgram_pairs(TX.sentences(docs(spark, [SMALL_CORPUS])), 5, 42))
    assert made.count("md5(") == 1 and made.count("(n't)") == 1


def test_faster_stop_patterns_find_the_same(spark):
    texts = ["a.b. c.d.", " a. b. Dr. Prof. x", "Dr.Prof. Nr.\n", "𐐀.b. „p. ej. x", "x𐐀 𐐀. b.", "(Dr. Sr.) p.ej.q.", "a. b. c. d.", "«Abb. z.B. \"u. a.", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = [F.regexp_replace("t", T.INITIALS, f"$1$2{T.STOP_MARK}$3$4{T.STOP_MARK}").eqNullSafe(T.mark_stops("t"))]
    for code in T.ABBREVIATIONS:
        was = F.regexp_replace("t", T.abbreviation_pattern(code), f"$1$2{T.STOP_MARK}")
        same.append(was.eqNullSafe(F.regexp_replace("t", T._abbreviations(code), f"$1{T.STOP_MARK}")))
    assert all(all(r) for r in df.select(*same).collect())


def test_buckets_of_equals_word_buckets(spark):
    words = spark.createDataFrame([("",), ("i",), ("haus",), ("häuser",), ("𐐀b",), ("donaudampfschiff",)], "word string")
    for n, m in ((3, 1000), (6, 100_000)):
        want = {r["word"]: r["bucket_ids"] for r in SA.word_buckets(words, n, m).collect()}
        assert {r["word"]: r["b"] for r in words.select("word", SA.buckets_of("word", n, m).alias("b")).collect()} == want
        lists = spark.createDataFrame([(["haus", "i", "haus"],), ([],), (["", "häuser"],)], "w array<string>")
        got = lists.select("w", SA.buckets_of("w", n, m, nested=True).alias("b")).collect()
        assert all(r["b"] == [want[w] for w in r["w"]] for r in got)


@pytest.mark.parametrize("piece", [6, 64])
@pytest.mark.parametrize("passes", [1, 2])
def test_direct_pairs_equal_pair_joins_in_order(spark, piece, passes):
    sents = materialize(TX.sentences(docs(spark, [SMALL_CORPUS, UNPUNCTUATED, SMALL_CORPUS.upper()])), "sentences")
    counts = VO.word_counts(TX.tokens(sents))
    vocab, frequent = VO.vocabulary(counts, 6, 0.01), VO.frequent_words(VO.drop_probability(counts, 0.01))
    pairs = PA.skipgram_pairs(sents, 3, 5, passes)
    kept = PA.subsample(pairs, frequent, 5, 0.01)
    made = CO.direct_pairs(sents, materialize(CO.known_words(vocab, frequent), "known-words"), 3, 5, passes, True, piece)
    assert sorted(map(tuple, made.select(*PA.PAIR_KEY, "tgt.word", "ctx.word").collect())) == sorted(map(tuple, pairs.collect()))
    got = CO.coded_subsample(made, 5).select(*PA.PAIR_KEY, "tgt.word", "ctx.word").collect()
    assert 0 < len(got) < pairs.count() and sorted(map(tuple, got)) == sorted(map(tuple, kept.collect()))
    samples = [tuple(r) for r in CO.coded_samples(made, 5).collect()]
    assert samples == sorted(map(tuple, PA.lookup_label(kept, vocab, 6).collect()))


def test_pairs_and_samples_are_not_shuffled(spark):
    pl = Pipeline(docs(spark, [SMALL_CORPUS, UNPUNCTUATED]), Params(batch_size=16, vocabulary_size=30, num_buckets=500, rejection_threshold=0.01))
    for df in (pl.samples, pl.hashed):
        assert not re.search(r"Exchange (hash|range)partitioning", plan(df)) and "SortMergeJoin" not in plan(df)
    # batches shuffle words, never their buckets
    assert "bucket_ids" not in plan(pl.batches)


def test_batch_numbers_alone_hash_nothing(spark):
    pl = Pipeline(docs(spark, [SMALL_CORPUS, UNPUNCTUATED]), Params(batch_size=16, vocabulary_size=30, num_buckets=500, rejection_threshold=0.01))
    assert "ArrowEval" not in plan(pl.batches.select("batch_id"))


def test_buckets_as_text_are_those_of_the_arrays(spark):
    words = spark.createDataFrame([(w,) for w in ["a", "", "äöü", "日本語", "x" * 70, "𝒳y", "harbour", "harbour"]], "word string")
    both = words.select(SA.buckets_of("word", 3, 1000).alias("b"), SA.buckets_of("word", 3, 1000, text=True).alias("t")).collect()
    assert len(both) == 8 and all(r["t"] == ",".join(map(str, r["b"])) for r in both)
    p = Params(batch_size=4, vocabulary_size=30, num_buckets=500, rejection_threshold=1.0)
    pl = Pipeline(docs(spark, [UNPUNCTUATED], "en"), p)
    plan = pl.hashed_as(text=True)
    want = sorted((r["pos"], r["off"], ",".join(map(str, r["bucket_ids"]))) for r in pl.hashed.collect())
    assert sorted((r["pos"], r["off"], r["bucket_ids"]) for r in plan.collect()) == want and want

"""Counts, drop probabilities and the vocabulary (small corpus goldens)."""

import math

import pytest

from gramvec.operators import text as TX
from gramvec.operators import vocab as VO
from tests.conftest import SMALL_CORPUS, docs


@pytest.fixture()
def small_counts(spark):
    return VO.word_counts(TX.tokens(TX.sentences(docs(spark, [SMALL_CORPUS]))))


def test_word_counts_golden(small_counts):
    counts = {r["word"]: r["cnt"] for r in small_counts.collect()}
    assert counts["bla"] == 3
    assert len(counts) == 10


def test_vocabulary_golden(small_counts):
    v = {r["word"]: r["word_id"] for r in VO.vocabulary(small_counts, 5, 1e-4).collect()}
    assert len(v) == 5
    assert v["bla"] == 0
    assert v["ist"] == 1  # tie broken by first occurrence (count 2: ist only)
    assert sorted(v.values()) == [0, 1, 2, 3, 4]


def test_vocabulary_ties_by_first_occurrence(small_counts):
    v = VO.vocabulary(small_counts, 10, 1e-4).orderBy("word_id").collect()
    # count 1 words in corpus order after bla(3), ist(2)
    assert [r["word"] for r in v] == ["bla", "ist", "dies", "eine", "test", "datei", "der", "text", "hier", "testtext"]


def test_drop_probability_formula(small_counts):
    total = 13
    for r in VO.drop_probability(small_counts, 0.01).collect():
        assert r["drop_p"] == pytest.approx(1 - math.sqrt(0.01 / (r["cnt"] / total)))


def test_empty_word_counts(spark):
    c = {r["word"]: r["cnt"] for r in VO.word_counts(TX.tokens(TX.sentences(docs(spark, ["Hallo. 123. Welt."])))).collect()}
    assert c == {"hallo": 1, "": 1, "welt": 1}
    c2 = {r["word"] for r in VO.word_counts(TX.tokens(TX.sentences(docs(spark, ["Hallo. 123. Welt."])), False)).collect()}
    assert c2 == {"hallo", "welt"}


def test_vocabulary_partition_invariant(spark):
    from gramvec.sources.corpus import read_documents
    from tests.conftest import SF

    def vocab(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        wc = VO.word_counts(TX.tokens(TX.sentences(read_documents(spark, SF))))
        return sorted(tuple(r) for r in VO.vocabulary(wc, 500, 1e-4).collect())

    try:
        assert vocab(1) == vocab(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

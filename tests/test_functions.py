"""Goldens for the scalar building blocks."""

from pyspark.sql import functions as F

from gramvec.functions import char_ngrams, fnv1a_bucket, hash_uniform
from gramvec.operators.text import clean_sentences, sentences
from tests.conftest import docs


# Inputs and results of these goldens must match.
def test_char_ngrams_golden(spark):
    df = spark.createDataFrame([("diesisteintest",)], "w string")
    got = df.select(char_ngrams("w", 3).alias("g")).first()["g"]
    assert got == ["*di", "die", "ies", "esi", "sis", "ist", "ste", "tei", "ein", "int", "nte", "tes", "est",
                   "st*", "*diesisteintest*"]


def test_char_ngrams_short_word_repeats(spark):
    df = spark.createDataFrame([("i",), ("",)], "w string")
    got = [r["g"] for r in df.select(char_ngrams("w", 3).alias("g")).collect()]
    assert got == [["*i*", "*i*"], ["**"]]


def test_fnv_bucket_goldens(spark):
    gold = {"bla": 116222, "*di": 28674, "*diesisteintest*": 80014, "*é*": 125798,
            "straße": 169378, "**": 174887, "日本*": 103914, "*i*": 187841}
    df = spark.createDataFrame([(w,) for w in gold], "w string")
    got = {r["w"]: r["b"] for r in df.select("w", fnv1a_bucket("w", 199999, 1).alias("b")).collect()}
    assert got == gold


def test_fnv_matches_plain_python(spark):
    def fnv(b: bytes) -> int:
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % 2**64
        return h

    words = ["", "a", "hello", "ünïcödé", "𝔘𝔫𝔦", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["b"] for r in df.select("w", fnv1a_bucket("w", 1000, 1).alias("b")).collect()}
    assert got == {w: fnv(w.encode()) % 1000 + 1 for w in words}


def test_hash_uniform_golden(spark):
    u = spark.range(1).select(hash_uniform(F.lit(42), F.lit("w"), F.lit(7), F.lit(0), F.lit(3)).alias("u")).first()["u"]
    assert u == 0.8496266610179932


# Inputs and results of these goldens must match.
def test_clean_sentences_goldens(spark):
    df = docs(spark, ["Ich bin der este Satz! Und ich bin, der zweite.",
                      "I'm the first sentence. Are you the second one?"])
    got = {}
    for r in clean_sentences(sentences(df)).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_idx"], r["sentence"]))
    assert [s for _, s in sorted(got[0])] == ["ich bin der este satz", "und ich bin der zweite"]
    assert [s for _, s in sorted(got[1])] == ["i m the first sentence", "are you the second one"]


def test_blank_and_letterless_sentences(spark):
    df = docs(spark, ["", "   \n ", "... !!! Hallo Welt. 123 ?", "no end mark"])
    rows = sorted((r["doc_id"], r["sent_idx"], r["sentence"]) for r in clean_sentences(sentences(df)).collect())
    assert rows == [(2, 0, ""), (2, 1, ""), (2, 2, "hallo welt"), (2, 3, ""), (3, 0, "no end mark")]


def test_abbreviations_and_initials_end_no_sentence(spark):
    df = docs(spark, ["Herr Dr. Meier kam z. B. heute. Er ging (Nr. 5) nicht.", "A. B. Weber sah d.h. nichts. Ja."])
    rows = clean_sentences(sentences(df)).orderBy("doc_id", "sent_idx").collect()
    assert [r["sentence"] for r in rows] == [
        "herr dr meier kam z b heute", "er ging nr nicht", "a b weber sah dh nichts", "ja"]
    english = docs(spark, ["Mr. Bell met Dr. Low at St. Mary. He left.", "Der Nr. Eins ist da."], "en")
    rows = clean_sentences(sentences(english)).orderBy("doc_id", "sent_idx").collect()
    assert [r["sentence"] for r in rows] == ["mr bell met dr low at st mary", "he left", "der nr", "eins ist da"]


def test_every_unicode_space_parts_words(spark):
    spaces = "\u0085\u00a0\u1680\u2000\u2005\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    df = docs(spark, ["x".join(["und", *[f"{s}so" for s in spaces]]).replace("x", ""), "eins.\u00a0zwei"])
    rows = clean_sentences(sentences(df)).orderBy("doc_id", "sent_idx").collect()
    assert [r["sentence"] for r in rows] == ["und" + " so" * len(spaces), "eins", "zwei"]

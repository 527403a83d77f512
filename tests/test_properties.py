"""Property tests: Spark expressions equal plain-Python definitions on random text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from gramvec.functions import char_ngrams, fnv1a_bucket

texts = st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=20, max_size=60)


def _fnv(b: bytes) -> int:
    h = 0xCBF29CE484222325
    for x in b:
        h = ((h ^ x) * 0x100000001B3) % 2**64
    return h


def _ngrams(w: str, n: int) -> list[str]:
    m = "*" + w + "*"
    return [m[i:i + n] for i in range(len(m) - n + 1)] + [m]


@settings(max_examples=3, deadline=None)
@given(texts, st.integers(min_value=2, max_value=2**31 - 1))
def test_fnv_bucket_property(spark, words, modulus):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r["i"]: r["b"] for r in df.select("i", fnv1a_bucket("w", modulus, 1).alias("b")).collect()}
    assert got == {i: _fnv(w.encode("utf-8")) % modulus + 1 for i, w in enumerate(words)}


@settings(max_examples=3, deadline=None)
@given(texts, st.integers(min_value=3, max_value=6))
def test_char_ngrams_property(spark, words, n):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r["i"]: r["g"] for r in df.select("i", char_ngrams("w", n).alias("g")).collect()}
    assert got == {i: _ngrams(w, n) for i, w in enumerate(words)}

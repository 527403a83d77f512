"""op11 (subword quality), op12 (Merkle manifest) and op13 (phrase fingerprints)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramvec.llm import merkle_butterfly as M
from gramvec.llm import phrase_fingerprints as P
from gramvec.llm import subword_quality as Q
from helpers import SCHEMA, corpus, empty

LABELS = "doc_id long, quality int, toxic int"


# ------------------------------------------------------------------------ op11
def quality_corpus(spark, n=400):
    rng = np.random.default_rng(1)
    syllables = ["ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "vu", "we"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(20, 60))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" if i % 8 else w + "&&&" for w in words]
        rows.append((i, " ".join(words), "en", "a", None))
        if i % 10:
            labels.append((i, int(not bad), 0))
    labels += [(3, None, 0), (None, 1, 0), (9999, 0, 0), (5, 0, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), {i: i % 4 != 0 for i in range(n)}


def test_quality_is_learned(spark):
    docs, labels, good = quality_corpus(spark)
    found = Q.quality_scores(docs, labels).collect()
    assert len(found) == 400
    assert {r["doc_id"] for r in found if r["held_out"]} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == good[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels, _ = quality_corpus(spark, 120)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    one = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in Q.quality_scores(moved, turned).collect()}


def test_quality_of_odd_rows(spark):
    docs = corpus(spark)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    found = Q.quality_scores(docs, some).collect()
    assert len(found) == docs.count()
    by = defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["score"])
    assert by[103] == by[104], "null and empty texts alike"
    assert len(by[7]) == 1
    none = Q.quality_scores(docs, some.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    only = Q.quality_scores(docs, some.withColumn("quality", F.lit(1))).collect()
    assert {r["predicted"] for r in only} == {1} and min(r["score"] for r in only) > 0.99
    assert Q.quality_scores(empty(spark), some).count() == 0


def test_features_of_long_texts_are_all_counted():
    word = "lorem ipsum dolor "
    text = word * 20_000
    at, counts = Q.bag(text)
    assert len("".join(Q.parts(text))) == len(text)
    # words, pairs and n-grams of each length, less those across cuts
    whole = 60_000 + 59_999 + sum(len(text) - n + 1 for n in Q.GRAMS)
    assert whole - 12 * len(list(Q.parts(text))) <= counts.sum() <= whole
    long_word = "x" * (3 * Q.PART + 5)
    assert sum(len(f) for f in Q.features(long_word)) > 3 * len(long_word) - 50


def test_training_follows_the_gradient():
    """One step from the start moves the logit of the right class up."""
    bags = [Q.bag("good words here"), Q.bag("BAD!! WORDS!!")]
    before = Q.train(bags, np.array([1, 0]), steps=2)
    after = Q.train(bags, np.array([1, 0]), steps=400)
    assert after.score("good words here") > max(0.9, before.score("good words here"))
    assert after.score("BAD!! WORDS!!") < 0.1


# ------------------------------------------------------------------------ op12
def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(r, text=None):
    enter = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(enter(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"] if text is None else text)))


def climb(nodes, fanout):
    """Root, and per node the (left, right) siblings of its path."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            first = at // fanout * fanout
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        place = [at // fanout for at in place]
    return nodes[0], paths


def brute_manifest(rows, fanout):
    trees = defaultdict(list)
    for r in rows:
        trees["" if r["lang"] is None else "=" + r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
    names = sorted(trees, key=str.encode)
    made = {t: climb([x[2] for x in sorted(trees[t])], fanout) for t in names}
    root, upper = climb([made[t][0] for t in names], fanout)
    out = []
    for i, t in enumerate(names):
        for (known, doc_id, leaf), path in zip(sorted(trees[t]), made[t][1]):
            out.append((doc_id if known else None, leaf, made[t][0], root, tuple(path + upper[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,levels,sizes", [(8, 4, None), (2, 1, (23, 1, 2)), (3, 1, (100, 28, 9, 10, 1)), (2, 2, (37,)), (3, 2, (82, 4, 1, 1, 1, 1, 1, 1, 1, 2))])
def test_manifest_equals_brute_force(spark, fanout, levels, sizes):
    if sizes is None:
        docs = corpus(spark)
    else:
        rows = [(1_000_000_007 * (i + 1) % 9973, f"text {i}", f"l{k}" if k else None, None, i) for k, n in enumerate(sizes) for i in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
    found = M.manifest(docs, fanout, levels).collect()
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["proof"])) for r in found]
    assert sorted(got, key=str) == brute_manifest(docs.collect(), fanout)


def test_tampered_rows_fail_and_others_hold(spark):
    docs = corpus(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = M.verified_manifest(docs, tampered, {"text": M.lowered(F.col("text"))}).collect()
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found:
        text = texts[r["doc_id"]]
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        changed = hit and text is not None and re.search("[A-Z]", text) is not None
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    assert any(not r["verified"] for r in found)


def test_manifest_of_few_rows(spark):
    assert M.verified_manifest(empty(spark), F.lit(False), {}).count() == 0
    one = spark.createDataFrame([(2**60 + 1, "a", None, None, None)], SCHEMA)
    r = M.verified_manifest(one, F.lit(True), {"text": M.lowered(F.col("text"))}).first()
    assert r["doc_id"] == 2**60 + 1 and r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("") and r["verified"]
    big = spark.createDataFrame([(2**60 + 1, "a", "x", None, None), (None, "b", "x", None, None)], SCHEMA)
    assert {r["doc_id"] for r in M.manifest(big).collect()} == {2**60 + 1, None}


# ------------------------------------------------------------------------ op13
def brute_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute_collocations(rows, least=10, covered=50, top=2000):
    f, n = brute_counts(rows)
    found = defaultdict(list)
    cands = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    around = Counter()
    for (lang, phrase), a in cands.items():
        w = phrase.split(" ")
        if len(w) == 3:
            for p in (" ".join(w[:2]), " ".join(w[1:])):
                around[lang, p] = max(around[lang, p], a)
    for (lang, phrase), a in cands.items():
        if (lang, phrase) in around and 100 * around[lang, phrase] >= covered * a:
            continue
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        found[lang].append((-s, -a, phrase.encode(), phrase, left, right))
    return sorted(
        (lang, i, x[3], -x[1], x[4], x[5], n[lang], -x[0]) for lang, xs in found.items() for i, x in enumerate(sorted(xs)[:top], 1)
    )


def phrase_corpus(spark):
    rng = np.random.default_rng(5)
    vocab = ["of", "the", "New", "york", "São", "Paulo", "a", "bb", "c c", "日本", "x" * 300]
    rows = []
    for i in range(300):
        words = [vocab[int(k)] for k in rng.integers(0, len(vocab), rng.integers(0, 40))]
        seps = [[" ", "\t", "  ", ". ", ", ", "\n", " ?!"][int(k)] for k in rng.choice(7, len(words), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])]
        rows.append((i if i % 50 else None, "".join(w + s for w, s in zip(words, seps)), [None, "en", "de", "und"][i % 4], "a", None))
    rows += [(900, None, "en", None, None), (901, "", "en", None, None), (902, " \t\n.,", None, None, None), (903, "one " * 500, "en", "a", None)]
    rows += [(904, "king of spain " * 400, "es", "a", None)] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block", [64, 700, P.BLOCK])
def test_collocations_equal_brute_force(spark, block):
    docs = phrase_corpus(spark).repartition(3)
    found = P.collocations(docs, block=block).collect()
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)
    assert got == brute_collocations([(r["lang"], r["text"]) for r in docs.collect()])


def test_top_rows_are_whole(spark):
    docs = phrase_corpus(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    found = P.collocations(docs, least=2, covered=101, top=7).collect()
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)
    assert got == brute_collocations(rows, 2, 101, 7)


def test_collisions_are_told_apart_by_text():
    class Same(P.Words):
        """All words of a block share two hashes, all runs of a length one fingerprint."""

        def __init__(self, data, own):
            super().__init__(data, own)
            self.hash = self.hash % np.uint64(2)

        def keys(self, n, lang, bits):
            key, at = super().keys(n, lang, bits)
            return np.full(len(at), n, np.uint64), at

    data = b"aa bb aa cc. bb aa bb dd\naa\tbb"
    words = Same(data, len(data))
    assert len(set(words.ids().tolist())) == 4
    e = P.Entries(words, "en", 5, 3, [{"bucket": 0, "bits": bytes([0b11100000])}])
    texts = e.texts(slice(0, len(e.size))).decode().split("\n")[:-1]
    f, _ = brute_counts([("en", data.decode())])
    assert dict(zip(texts, e.counts.tolist())) == {k[1]: v for k, v in f.items()} and len(texts) == len(f)
    for n in (1, 2, 3):
        for at in range(len(words.first)):
            if e.of[n][at] >= 0:
                assert texts[e.of[n][at]] == words.text(at, n).decode()


def test_collisions_between_blocks_are_settled_by_text(spark):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    count = lambda *n: pack(np.array(n, np.uint32).tobytes())
    rows = [(4, "en", 7, pack(b"a b\nc\n"), count(3, 4)), (2, "en", 7, pack(b"a b\n"), count(8)), (9, "de", 7, pack(b"c\n"), count(5)), (10, "en", 7, pack(b"d\n"), count(1))]
    df = spark.createDataFrame(rows, "id long, lang string, bucket long, texts binary, counts binary")
    got = {r["id"]: np.frombuffer(P.plain(r["totals"]), np.int64).tolist() for r in P.settled(df).collect()}
    assert got == {2: [2 * 11 + 1], 4: [2 * 11, 2 * 4 + 1], 9: [2 * 5 + 1], 10: [2 * 1 + 1]}


def test_long_texts_are_cut_between_words():
    for text in (b"w1 w2 w3 w4 w5 " * 50, b"abc. def gh, " * 30, b"y" * 500 + b" z " + b"q" * 400, b"  \t " * 100 + b"end"):
        parts = list(P.cut(text, 64))
        assert b"".join(p[:own] for p, own in parts) == text
        whole = Counter(b" ".join(x) for piece in re.split(rb"[.,;:!?\n-\r]", text) for w in [piece.split()] for x in zip(w, w[1:], w[2:]))
        again = Counter()
        for p, own in parts:
            words = P.Words(p, own)
            _, at = words.keys(3, "en", 5)
            again.update(words.text(i, 3) for i in at[at < words.own])
        assert again == whole


def test_phrases_of_odd_rows(spark):
    docs = corpus(spark)
    found = P.collocations(docs).collect()
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)
    assert got == brute_collocations([(r["lang"], r["text"]) for r in docs.collect()])
    assert P.collocations(empty(spark)).count() == 0


def test_scores_are_exact_beyond_64_bits():
    a, l, r = 123_456_789_012, 987_654_321_098, 123_456_789_013
    assert P.best_cut(a, [(l, r)]) == (1_000_000 * a * a // (l * r), l, r)
    assert P.best_cut(10, [(20, 20), (40, 10), (10, 40)]) == (250_000, 20, 20)

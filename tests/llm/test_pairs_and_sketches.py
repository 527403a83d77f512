"""op1 and op2 against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from helpers import SCHEMA, corpus, empty

from gramvec.llm import scaled_sketch as S
from gramvec.llm import simhash_pivots as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint_is_that_of_the_definition():
    for text in ["", None, "a", "A b", "The THE the ÄÖ x", "a b c d e f g " * 40, "x\x0by\x0cz w"]:
        assert P.fingerprint(text) == plain_fingerprint(text)


def test_components_on_odd_rows(spark):
    docs = corpus(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    root = plain_components(fps)
    least = {}
    for r, c in zip(rows, root):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, root))
    got = Counter(tuple(r) for r in P.near_duplicates(docs).collect())
    assert got == want
    kept = P.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))
    assert P.near_duplicates(empty(spark)).count() == 0


def test_links_lose_nothing_in_large_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres:
        for _ in range(250):
            f = int(c)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps += [int(x) for x in rng.integers(0, 1 << 63, 300)]
    fps = sorted(set(fps))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    named = P.named_classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    root = plain_components(fps)
    by = {r["fp"]: r["root"] for r in named}
    groups, want = {}, {}
    for (i, f), c in zip(rows, root):
        groups.setdefault(by[f], set()).add(i)
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    flips = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (2000, 2))], np.uint64)
    y = x ^ flips
    apart = np.abs(P.distances(x, P.SPREAD_REFERENCES) - P.distances(y, P.SPREAD_REFERENCES)).max(1)
    assert apart.max() <= 2
    assert (P.meeting_keys(x) == P.meeting_keys(y)).any(1).all()


def plain_sketch(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sketch_of(text):
    """Distinct shingles, scale and kept hashes, as unsigned numbers."""
    w = WORD.findall((text or "").lower())
    word = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
    found = set()
    for i in range(max(1, len(w) - 4)) if w else ():
        h = 42
        for x in word[i : i + 5]:
            h = xxhash.xxh64(x.to_bytes(8, "little"), seed=h).intdigest()
        found.add(h)
    scale = 1 if len(found) < S.SMALL else S.SCALE
    kept = {h for h in found if h < 2**64 // scale} or set(sorted(found)[:1])
    return len(found), scale, kept


def plain_likeness(a, b):
    to = max(a[1], b[1])
    one, other = ({h for h in x[2] if h < 2**64 // to} or set(sorted(x[2])[:1]) for x in (a, b))
    return len(one & other) / len(one | other) if one | other else 1.0


def test_edits_and_next_documents(spark):
    docs = corpus(spark)
    rng = np.random.default_rng(3)
    more = [(2000 + i, " ".join(f"w{x}" for x in rng.integers(0, 40, n)), "en", "a", None) for i, n in enumerate([1, 2, 4, 5, 6, 9, 20, 60, 68, 70, 150, 400])]
    more += [(3000, "alpha", "en", "a", 5), (3001, "Alpha", "en", "a", 5), (3002, "red", "en", "a", 3), (3003, "blue", "en", "a", 4)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r["text"] or "" for r in rows]
    want = Counter()
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own = sketch_of(t)
        near = plain_likeness(own, sketch_of(edited)), plain_likeness(own, sketch_of(after))
        want[rows[i]["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), *near] += 1
    found = S.edit_likeness(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found) == want
    same = {r["doc_id"]: r["fingerprint"] for r in found}
    assert same[5] == same[100] == same[101] != same[102]
    assert same[3000] == same[3001] and len({same[3001], same[3002], same[3003]}) == 3
    near = {r["doc_id"]: r["near_next"] for r in found}
    assert near[3001] == 1.0 and near[3003] == near[3002] == 0.0
    assert S.edit_likeness(empty(spark)).count() == 0
    one = S.edit_likeness(spark.createDataFrame([(1, "a b c d e f", None, None, None)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_likeness_estimates_similarity(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 3000)))]
        v = w[: int(len(w) * rng.random())] + [f"v{x}" for x in rng.integers(0, 5000, 50)]
        rows.append((" ".join(w), " ".join(v)))
    df = S.with_sketch(S.with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    from pyspark.sql import functions as F

    for r in df.select("a", "b", S.likeness(F.col("x"), F.col("y")).alias("near"), S.containment(F.col("y"), F.col("x")).alias("inside")).collect():
        a, b = plain_sketch(r["a"]), plain_sketch(r["b"])
        assert abs(r["near"] - len(a & b) / len(a | b)) < 0.12
        assert abs(r["inside"] - len(a & b) / len(b)) < 0.2


def test_sketches_merge_and_contain(spark):
    parts = [" ".join(f"w{i}" for i in range(0, 4000)), " ".join(f"w{i}" for i in range(0, 400)), " ".join(f"w{i}" for i in range(3000, 9000))]
    df = spark.createDataFrame([(1, p) for p in parts] + [(2, parts[1])], "k int, text string")
    sketched = S.with_sketch(df, "text", "sketch")
    from pyspark.sql import functions as F

    merged = S.merged(sketched, "k")
    pair = merged.where("k = 2").select(F.col("sketch").alias("a")).crossJoin(merged.where("k = 1").select(F.col("sketch").alias("b")))
    row = pair.select(S.containment(F.col("a"), F.col("b")).alias("ab"), S.containment(F.col("b"), F.col("a")).alias("ba"), F.col("b")["n"].alias("n")).first()
    assert row["ab"] == 1.0 and 0.01 < row["ba"] < 0.12 and 7500 < row["n"] < 10500
    fine = sketched.select(F.size(F.col("sketch")["hashes"]).alias("n"), F.size(S.coarser(F.col("sketch"), 16)["hashes"]).alias("m")).first()
    assert 0.15 < fine["m"] / fine["n"] < 0.35

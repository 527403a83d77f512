"""op3, op5, op7 and op10."""

import re
import zlib
from collections import Counter

import pytest
import xxhash
from helpers import SCHEMA, corpus, empty

from gramvec.llm import html_region as H
from gramvec.llm import language_codes as L
from gramvec.llm import risk_rules as R
from gramvec.llm import secret_index as X

# ---------------------------------------------------------------- op3
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="sidebar"><p>Popular things to read here</p></div>
%s
<div class="ad">Buy this now</div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p>One  two\n three<p>Four&nbsp;five<br>six</p></article>", "A & B\nOne two three\nFour five six"),
        ("<main><p>a b c d</p><div class='ad'>no</div><p>e f g</p></main>", "a b c d\ne f g"),
        ("<div id='content'><h2>Title of it</h2><p>Some <b>bold</b> words follow here.</p><ul><li>item one is</li></ul></div>",
         "Title of it\nSome bold words follow here.\nitem one is"),
        ("<article><p>x y z</p></article><section class='comments'><article class='comment'><p>great great great great post</p></article></section>", "x y z"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>Body<script>if (a<b) 'x'</script> text.</p></article>", "Head\nBody text."),
    ],
)
def test_main_text(body, text):
    assert H.main_text(PAGE % body, {}) == text


@pytest.mark.parametrize(
    "body, text",
    [
        ("<main><h1>Title</h1><p>lead</p><article><p>a body of many words is here</p></article></main>", "Title\nlead\na body of many words is here"),
        ("<main><article><p>one two three four</p></article><p>x</p><article><p>five six seven eight nine</p></article></main>",
         "one two three four\nx\nfive six seven eight nine"),
        ("<article><p>one two three four five six</p></article><article><p>seven eight nine ten eleven twelve thirteen</p></article>",
         "one two three four five six\nseven eight nine ten eleven twelve thirteen"),
        ("<article><h2>Head</h2><p>one two three four five six seven</p></article><p>and some more words after it</p>",
         "Head\none two three four five six seven\nand some more words after it"),
    ],
)
def test_region_is_only_widened(body, text):
    assert H.main_text(PAGE % body, {}) == text


LONG = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "part, kept",
    [
        ("<h2 id='related-work'>Some text</h2>", True),
        ("<h2 id='social'>Some text</h2>", True),
        ("<h2 id='social-impact'>Some text</h2>", True),
        (f"<section id='legal-basis'><p>Some text {LONG}</p></section>", True),
        (f"<section id='legal'><p>Some text {LONG}</p></section>", True),
        ("<div class='survey-results'><p>Some text</p></div>", True),
        ("<p class='teaser'>Some text</p>", True),
        ("<p class='related'><a href='/x'>Some text</a></p>", False),
        ("<div class='newsletter-box'><p>Some text</p></div>", False),
        (f"<div class='related'><a href='/x'>Some text {LONG}</a></div>", False),
        (f"<div class='comments-wrapper'><p>Some text {LONG}</p></div>", False),
        (f"<section id='post-comments'><p>Some text {LONG}</p></section>", False),
        ("<div class='nav-wrapper'><p>Some text</p></div>", False),
    ],
)
def test_names_inside_an_article(part, kept):
    found = H.main_text(PAGE % f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>", {})
    assert ("Some text" in found) == kept and found.count(LONG) >= 2


def test_names_outside_an_article():
    for name in ("site-footer", "sidebar-wrapper", "cookieNotice", "teaser"):
        page = f"<div class='{name}'><p>Some text {LONG}</p></div>"
        assert H.main_text(PAGE % f"<p>{LONG}</p>{page}<p>{LONG}</p>", {}) == f"{LONG}\n{LONG}"
    page = f"<div class='sidebar-wrapper'><main><p>{LONG}</p></main></div>"
    assert H.main_text(PAGE % page, {}) == LONG


def test_long_menus_do_not_hide_the_article():
    menu = "<a href='/x'>link here</a> " * 2000
    page = f"<div class='widget'>{menu}<article><p>the article has a body of words</p></article></div>"
    assert H.main_text(page, {}) == "the article has a body of words"
    aside = f"<article><p>{LONG}</p><div class='related'>{menu}<p>{LONG}</p></div><p>{LONG}</p></article>"
    assert H.main_text(PAGE % aside, {}) == f"{LONG}\n{LONG}"


def test_names_have_learned_weights():
    """A name that stands around the articles of labelled pages doesn't speak against its element any more."""
    page = f"<html><body><div class='panel'><p>menu words</p></div><div class='banner'><article><p>{LONG}</p></article></div></body></html>"
    counts = Counter()
    for _ in range(50):
        counts.update(H.region_counts(H.Page(page)))
    weights = H.fit_weights(counts)
    bare = f"<html><body><div class='banner'><p>{LONG}</p></div></body></html>"
    assert weights["under banner"] > 0 > H.prior("under banner")
    assert H.main_text(bare, weights) == LONG and H.main_text(bare, {}) == ""


def test_pages_without_names_or_articles():
    """On the given pages the scan finds the article with its tags renamed and with all names removed."""
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist() if x]
    counts = Counter()
    for x in pages[:1000]:
        counts.update(H.region_counts(H.Page(x)))
    weights = H.fit_weights(counts)
    assert len(pages) > 2000
    for x in pages:
        text = H.main_text(x, weights)
        renamed = re.sub(r"<(/?)article", r"<\1div", x)
        assert H.main_text(renamed, weights) == text
        assert H.main_text(re.sub(r'\s(?:class|id|role)="[^"]*"', "", renamed), weights) == text


def test_broken_and_empty_pages():
    assert H.main_text(None, {}) == H.main_text("", {}) == H.main_text("<p></p>", {}) == ""
    assert H.main_text(" just \n text &lt;x&gt; ", {}) == "just text <x>"
    assert H.main_text("<article><p>cut off <!-- never closed", {}) == "cut off"
    assert H.main_text('<article><p title="x>y">word <b>b</p>', {}) == "word b"
    assert H.main_text("<article><p>a < b and c > d</p>", {}) == "a < b and c > d"
    assert len(H.main_text("<article>" + "<p>word here</p>" * 20_000, {}).split("\n")) == 20_000
    assert H.main_text("<div " + "a='" * 5000, {}) == ""


def test_best_region_against_all_regions():
    import random

    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, -0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        best = max((sum(s[i : j + 1]) for i in range(len(s)) for j in range(i, len(s))), default=0)
        found = H.best_region(s)
        assert (found is None and best <= 0) or abs(sum(s[found[0] : found[1] + 1]) - best) < 1e-9


def test_pages_table(spark):
    rows = [(1, "u", PAGE % "<article><p>a b c d e</p></article>", "t"), (1, "u", PAGE % "<article><p>a b c d e</p></article>", "t"), (2, None, None, "t"), (None, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter(tuple(r) for r in H.extract(pages).collect())
    assert got == Counter({(1, "u", "a b c d e", 9): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert H.extract(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- op5
SECRETS = [
    "password=abc",
    "my TOKEN : 'abcdef' and token=secret:abcdef",
    "token = token:abcdefg",
    "Api-Key api_key=abcdef apikey=\"ABC/123+x=\"",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 12,
    "0123456789abcdef01234567 0123456789abcdef0123456 " + "a" * 60,
    "é🙂 password=0123456789abcdef0123456789 🙂",
    "ghp_" + "a1B2" * 9 + " xoxb-123456789012 sk_live_" + "x" * 24,
    "-----BEGIN RSA PRIVATE KEY----- AIza" + "k" * 35,
    "",
    None,
    "passwords are tokens of secrets",
]


def plain_spans(text):
    out = []
    for n, rule in enumerate(X.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), n, m.end()))
    return ",".join(f"{X.RULES[n].kind}:{a}:{b}" for a, n, b in sorted(out))


def test_spans_equal_plain_search(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(SECRETS)] + [(None, SECRETS[1], None, None, None), (0, SECRETS[4], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS spans", "2 AS rules", "3 AS kind")
    from pyspark.sql import functions as F

    got = Counter(tuple(r) for r in X.secret_spans(docs).select("doc_id", X.listed(F.col("spans"))).collect())
    assert got == Counter((r[0], plain_spans(r[1])) for r in rows)
    assert X.secret_spans(empty(spark)).count() == 0


def test_queries_hold_in_every_match():
    for rule in X.RULES:
        for text in filter(None, SECRETS):
            for m in re.finditer(rule.pattern, text):
                low = text.lower()
                assert all(any(all(g in low for g in s) for s in part) for part in X.trigram_query(rule.pattern)), (rule, m)
    assert X.trigram_query(X.RULES[2].pattern) == []
    assert X.trigram_query("ab.?cd") == [] and X.trigram_query("x+abcd") == [[frozenset({"abc", "bcd"})]]


def test_redaction(spark):
    docs = corpus(spark).withColumn("kind_no", __import__("pyspark.sql.functions").sql.functions.lit(1))
    out = X.redact(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    rows = [(1, "a password=0123456789abcdef0123456789 z", "en", "s", 99), (2, "AKIA" + "B" * 16, None, None, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in X.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("a [SECRET] z", 12), 2: ("[SECRET]", 8)}


# ---------------------------------------------------------------- op7
def test_languages(spark):
    import random

    rng = random.Random(4)
    stems = {"aa": ["ka", "to", "mi", "ne"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["ción", "que", "los", "ar"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(20)), lang, None, None))
    odd = [(1000, None, "aa", None, None), (1001, "", "aa", None, None), (1002, "123 ... 🙂", "bb", None, None), (None, "kato mine", None, None, None), rows[3], rows[3]]
    docs = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS bucket")
    found = L.identify(docs).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert {by[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and by[None]["lang_pred"] == "aa"
    held = [r for r in rows if by[r[0]]["held_out"]]
    assert len(held) > 20 and sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    import zlib

    assert all(by[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    none = L.identify(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert L.identify(empty(spark)).count() == 0


def test_parts_of_a_long_text_count_every_gram(monkeypatch):
    import numpy as np

    text = "Äbc dé🙂fg hij " * 50
    whole = np.bincount(np.concatenate(list(L.grams(text))), minlength=L.BUCKETS)
    monkeypatch.setattr(L, "PART", 37)
    parts = np.bincount(np.concatenate(list(L.grams(text))), minlength=L.BUCKETS)
    assert (whole == parts).all()


def plain_grams(text):
    """The hash of every n-gram of the padded lower-case text, one by one."""
    code = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {text.lower()} "]
    out = Counter()
    for n in L.GRAMS:
        for i in range(len(code) - n + 1):
            h = 0
            for k, c in enumerate(code[i : i + n], 1):
                h = (h * 0x9E3779B97F4A7C15 + c + k) % 2**64
            h = h * 0xFF51AFD7ED558CCD % 2**64
            out[((h ^ h >> 32) * 0xC4CEB9FE1A85EC53 % 2**64) >> 49] += 1
    return out


def set_aside(doc_id):
    h = xxhash.xxh64(doc_id.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % 10 == 0


def test_languages_against_a_plain_model(spark):
    """Counts, reliabilities and predictions, also of a language whose documents are all set aside."""
    import random

    import numpy as np

    rng = random.Random(6)
    stems = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ción", "que", "los"], "dd": ["wyz", "xij", "qov"]}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows, i = [], 0
    while len(rows) < 130:
        i += 1
        lang = rng.choice(list(stems))
        if lang != "dd" or (set_aside(i) and not held(i)):
            rows.append((i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(12)), lang, None, None))
    rows += [(9000 + k, "wyz xij qov " * 3, "dd", None, None) for k in range(200) if set_aside(9000 + k) and not held(9000 + k)]
    names = sorted(stems)
    counts = np.zeros((2, 4, L.BUCKETS))
    for r in rows:
        if not held(r[0]):
            for b, n in plain_grams(r[1]).items():
                counts[int(set_aside(r[0])), names.index(r[2]), b] += n
    code = L.codewords(4)

    def weights(c):
        share = (c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * L.BUCKETS)
        return np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)

    def margins(w, text):
        found = plain_grams(text)
        return sum(n * w[b] for b, n in found.items()) / sum(found.values())

    first, whole = weights(counts[0]), weights(counts.sum(0))
    tested = [r for r in rows if not held(r[0]) and set_aside(r[0]) and r[2] != "dd"]
    right = np.mean([np.sign(margins(first, r[1])) == code[names.index(r[2])] for r in tested], 0)
    reliability = np.maximum(0.05, 2 * right - 1)
    found = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        loss = np.logaddexp(0.0, -L.SHARP * code * margins(whole, r[1])) @ reliability
        odds = np.exp(loss.min() - loss)
        assert found[r[0]]["lang_pred"] == names[int(loss.argmin())]
        assert abs(found[r[0]]["score"] - 1 / odds.sum()) < 1e-3
    assert {found[r[0]]["lang_pred"] for r in rows if r[2] == "dd"} == {"dd"}


def test_codewords_are_apart():
    for n in (2, 4, 9, 30):
        code = L.codewords(n)
        assert len({tuple(r) for r in code}) == n and (abs(code.sum(0)) < n).all()


# ---------------------------------------------------------------- op10
def plain_counts(text):
    w = re.findall(R.WORD, text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(R.WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    import random

    rng = random.Random(8)
    texts = [None, "", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x|y <#> \n\n \nq\nq", "\x0b\x0c  é"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) + "\n" for _ in range(60)]
    assert [R.counts_of(t)[:5] for t in texts] == [plain_counts(t) for t in texts]


def test_binomial_bound():
    from math import comb

    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (200, 20, 0.2)]:
        assert abs(R.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert R.holds(0, 90, 0.05, 0.0125) and not R.holds(0, 80, 0.05, 0.0125) and not R.holds(0, 0, 0.05, 0.5)


def test_verdicts(spark):
    import random

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + "###" if bad else x for x in w), "en" if i % 10 else None, None, None))
        labels.append((i, int(not bad)))
    odd = [(5000, None, "en", None, None), (5001, "few words", "en", None, None), (None, rows[1][1], "en", None, None), rows[1], rows[1]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    lab = spark.createDataFrame(labels + [(1, 1), (2, 0), (2, 1), (None, 1), (9, None)], "doc_id long, quality int")
    found = R.quality_verdicts(docs, lab).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert not by[5000]["kept"] and by[5000]["base_failed"] and not by[5001]["kept"] and by[None]["kept"]
    en = [r for r in rows if r[2] == "en"]
    assert all(by[r[0]]["kept"] == bool(r[0] % 4) for r in en)
    cut = R.certified_cutoffs(spark.createDataFrame(found), lab)
    assert cut["none"]["cutoffs"] is None and cut["lang en"]["rejected"] == 0
    kept = R.keep_good(docs.selectExpr("*", "1 AS n_words", "2 AS stratum"), lab)
    assert kept.count() == sum(r["kept"] for r in found) and "n_words" in kept.columns
    assert R.quality_verdicts(empty(spark), lab).count() == 0
    assert R.quality_verdicts(docs, lab.limit(0)).where("kept <> (NOT base_failed)").count() == 0

"""op4, op6, op8, op9 and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, corpus, empty

from gramvec.llm import huffman_ids as U
from gramvec.llm import mixing as M
from gramvec.llm import packing as K
from gramvec.llm import warc_bundles as B
from gramvec.llm.tokens import WordEncoder, encoder
from gramvec.session import scratch_path


def plain_ids(text):
    return encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- tokens
def test_word_encoder_equals_the_tokenizer():
    import random

    rng = random.Random(1)
    chars = "aZ É'sST tdlmre12²¼_-.!\n\t\r\x0b  İıſΣσςÁëŉ日本🙂　×÷ªº\x00\x1c\x85ǅǰ" + "́"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", None, "<|endoftext|> a", "x<|startoftext|>", "IT'S it's 'S''s", "word " * 5000]
    ids, at = encoder().encode(texts)
    assert all(ids[a:b].tolist() == plain_ids(t)[:-1] for t, a, b in zip(texts, at[:-1], at[1:]))


def test_other_tokenizers_are_encoded_directly():
    import public_tokenizers

    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.by_word
    ids, at = enc.encode(["a  b", "", "c\nd"])
    assert ids.tolist() == [i for t in ["a  b", "", "c\nd"] for i in enc._direct(t)]


# ---------------------------------------------------------------- op9
@pytest.mark.parametrize("n, symbols", [(0, 5), (1, 1), (5000, 3), (20_000, 700)])
def test_huffman_code(n, symbols):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % symbols).astype(np.uint32)
    counts = np.bincount(ids, minlength=1)
    lengths = U.code_lengths(counts, 10)
    used = lengths[counts > 0].astype(int)
    assert lengths.max(initial=0) <= 10 and (lengths[counts == 0] == 0).all()
    if len(used) > 1:
        assert (2.0**-used).sum() == 1.0
        wide = U.code_lengths(counts, 16)
        assert (counts * wide).sum() <= (counts * lengths.astype(int)).sum()
        p = counts[counts > 0] / counts.sum()
        assert (counts * wide).sum() / counts.sum() <= -(p * np.log2(p)).sum() + 1


def test_length_limit_against_all_codes():
    from itertools import product

    counts = np.array([1, 1, 2, 4, 9, 20])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in product(range(1, 5), repeat=6) if sum(2.0**-x for x in ls) <= 1)
    assert (counts * U.code_lengths(counts, 4)).sum() == best


@pytest.mark.parametrize("encoded", [100, 1 << 18])
def test_file_round_trip_and_blocks(tmp_path, monkeypatch, encoded):
    monkeypatch.setattr(U, "ENCODED", encoded)
    rng = np.random.default_rng(3)
    docs = [(i if i % 5 else None, (rng.zipf(1.3, rng.integers(1, 900)) % 3000).astype(np.uint32)) for i in range(60)]
    flat = np.concatenate([x for _, x in docs])
    lengths = U.code_lengths(np.bincount(flat), 12)
    out = U.IdFile(str(tmp_path), "x", lengths, 12, 128)
    for doc_id, ids in docs:
        out.add(doc_id, ids)
    reader = U.IdReader(str(tmp_path), out.close())
    assert [(d, np.concatenate(p).tolist()) for d, p in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    for a, b in [(0, 1), (3, 9), (len(reader.checkpoints) - 1, len(reader.checkpoints)), (0, len(reader.checkpoints))]:
        assert (reader.blocks(a, b) == flat[a * 128 : b * 128]).all()


def test_id_files_of_odd_rows(spark):
    docs = corpus(spark)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    want, start = Counter(), 0
    ids = {}
    for r in rows:
        one = plain_ids(r["text"])
        ids.setdefault(r["doc_id"], []).append(one)
    got = U.huffman_round_trip(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    for r in got:
        assert r["start"] == start and any((r["n_tokens"], r["ids_crc32"]) == (len(x), crc(x)) for x in ids[r["doc_id"]])
        start += r["n_tokens"]
    assert start == sum(len(x) for v in ids.values() for x in v)
    assert U.huffman_round_trip(empty(spark)).count() == 0


# ---------------------------------------------------------------- op4
def test_pieces_cover_all_ids_without_padding(spark):
    docs = corpus(spark)
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r["doc_id"]].append(plain_ids(r["text"]))
    rows = K.pack(docs, with_ids=True).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(x[r["start"] : r["start"] + r["length"]] == r["ids"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        assert crc(r["ids"]) == r["ids_crc32"]
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert K.pack(empty(spark)).count() == 0
    large = spark.createDataFrame([((1 << 62) + 1, "a b", None, None, None), (None, "c", None, None, None)], SCHEMA)
    assert {r["doc_id"] for r in K.pack(large).collect()} == {(1 << 62) + 1, None}


def test_packing_stage_holds_all_ids(spark):
    import corpus_pipeline as C

    docs = corpus(spark, extra=False).where("doc_id < 200 AND doc_id != 7")
    want = {r["doc_id"]: plain_ids(r["text"]) for r in docs.select("doc_id", "text").collect()}
    rows = C.packing(spark, docs, "").collect()
    assert any(r["length"] == K.SEQ_LEN and r["doc_tokens"] > K.SEQ_LEN for r in rows)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(got[r["doc_id"]]) == r["start"] and crc(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]] += r["ids"]
    assert got == want
    assert Counter(tuple(r) for r in K.pack(docs).collect()) == Counter(tuple(r)[:-1] for r in rows)


def test_long_and_equal_documents_meet_in_no_group(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_BYTES", 20_000)
    text = "the cat sat on the mat " * 40_000
    rows = [(1, text, None, None, None)] + [(None, "same words again", None, None, None)] * 3000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = K.pack(docs).collect()
    groups, n = len({r["sequence_id"] >> 32 for r in found}), len(plain_ids(text))
    by = Counter(r["sequence_id"] >> 32 for r in found if r["doc_id"] is None)
    assert groups > 30 and max(by.values()) < 0.15 * sum(by.values())
    parts = [r for r in found if r["doc_id"] == 1]
    assert len({r["sequence_id"] >> 32 for r in parts}) > 0.4 * len(parts) and sum(r["length"] for r in parts) == n


def test_assignment_is_balanced():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 4096, 900))[::-1]
    capacity = K.capacities(int(lengths.sum()), 4096)
    cost = np.zeros(len(capacity))
    room = capacity.copy()
    for _, _, n, seq, _ in K.assign(lengths, capacity):
        cost[seq] += K.LINEAR * n + K.QUADRATIC * n * n
        room[seq] -= n
    full = cost[capacity == 4096]
    assert (room == 0).all() and full.max() / full.mean() < 1.15


# ---------------------------------------------------------------- op6
def test_targets():
    assert M.targets([100, 100, 100], [1, 1, 1]) == [150.0] * 3
    found = M.targets([10, 1000, 1000], [3, 1, 2])
    assert found[0] == 20.0 and abs(sum(found) - 3015) < 1e-9 and abs(found[2] - 2995 * 2 / 3) < 1e-9
    assert M.targets([], []) == [] and M.targets([0, 5], [1, 1]) == [0.0, 7.5]


def test_tree_splits_exactly():
    quotas = np.array([700, 3, 0, 41, 1000])
    parts = [M.leaf_quotas(quotas, 7, s) for s in range(7)]
    assert (sum(parts) == quotas).all() and all((p >= 0).all() for p in parts)
    sums = [int(p.sum()) for p in parts]
    assert max(sums) - min(sums) <= 3
    assert (M.leaf_quotas(quotas, 7, 3) == parts[3]).all() and (M.leaf_quotas(quotas, 1, 0) == quotas).all()


def test_mix_of_odd_rows(spark):
    import re

    docs = corpus(spark)
    rows = docs.select("doc_id", "source", "text").collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    of = defaultdict(int)
    for r, n in zip(rows, size):
        of[r["source"]] += n
    names = sorted(of, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, M.targets([of[s] for s in names], [M.WEIGHTS[i % 3] for i in range(len(names))])))
    found = M.mix_digest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in found) == Counter(
        (r["doc_id"], n, of[r["source"]], want[r["source"]]) for r, n in zip(rows, size)
    )
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - t) <= 1 for (t, _), n in taken.items())
    again = M.mix_digest(docs).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert M.mix_digest(empty(spark)).count() == 0


def test_mixed_documents_are_whole_but_one_per_source(spark):
    docs = corpus(spark)
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    texts = {r["text"] for r in docs.collect()}
    cut = [r for r in out.collect() if r["text"] not in texts]
    assert len(cut) <= 5 and all(any(t and t.startswith(r["text"]) for t in texts) for r in cut)
    mixed, _ = M.mix(docs)
    rows = mixed.collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


@pytest.mark.parametrize("files, broadcast", [(10_000, 500_000), (2, 0)])
def test_mixed_documents_stand_in_their_shards(spark, monkeypatch, files, broadcast):
    monkeypatch.setattr(M, "BLOCK_DOCS", 2)
    monkeypatch.setattr(M, "BROADCAST_BLOCKS", broadcast)
    docs = corpus(spark).where("doc_id IS NULL OR doc_id != 7").repartition(3)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    want = defaultdict(list)
    for r in sorted(M.mix(docs, shard_words=4000)[0].collect(), key=lambda r: (r["shard"], r["position"])):
        want[r["shard"]].append((r["doc_id"], r["words"]))
    shards = max(want) + 1
    parts = min(shards, files)
    expected = [[x for s in range(shards) if s * parts // shards == p for x in want[s]] for p in range(parts)]
    found = M.mix_documents(docs, shard_words=4000, files=files).rdd.glom().collect()
    assert shards > 5 and [[(r["doc_id"], len((r["text"] or "").split())) for r in p] for p in found] == expected
    assert all(text[r["doc_id"]].startswith(r["text"]) for p in found for r in p if r["doc_id"] is not None)


def test_blocks_follow_the_number_of_documents(spark):
    """No cap on blocks, ids without number or not; blocks ascend with the key."""
    from pyspark.sql import functions as F

    rows = [(i if i % 3 else None, f"w{i} x y", "en", "a", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = M.sized(docs)
    plan = M.source_plan(kept).withColumn("shift", F.lit(20))  # as for 10^12 blocks
    blocks = M.with_block(M.with_plan(kept, plan)).select("doc_id", "key", "block").collect()
    assert [r["block"] for r in sorted(blocks, key=lambda r: r["key"])] == sorted(r["block"] for r in blocks)
    assert len({r["block"] for r in blocks if r["doc_id"] is not None}) == 2000
    assert len({r["block"] for r in blocks if r["doc_id"] is None}) > 990
    assert max(r["block"] for r in blocks) < 2**63


def test_prefix_sums(spark):
    from pyspark.sql import functions as F

    from gramvec.operators.ordinals import prefix_sums

    rows = [(k, i, (i * 7 + 3) % 11) for k in ("a", None, "c") for i in range(200 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(3)
    seen, want = Counter(), set()
    for k, i, v in rows:
        want.add((k, i, v, seen[k]))
        seen[k] += v
    assert {tuple(r) for r in prefix_sums(df, ["at"], "v", "before", by="k").collect()} == want
    whole = prefix_sums(df.where("k = 'a'"), ["at"], "v", "before")
    assert {tuple(r) for r in whole.collect()} == {w for w in want if w[0] == "a"}
    assert prefix_sums(df.where(F.lit(False)), ["at"], "v", "before").count() == 0


# ---------------------------------------------------------------- op8
def pages(spark):
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "u5", long), (3, "u3", long), (9, "u9", long), (1, "u1", "short"), (2, "u2", "short"), (4, None, None), (6, "u6", ""),
            (7, "http://x/\r\né", "x" * 300_000), (None, "n", long), (8, "u8", "y" * 100), (8, "u8", "y" * 100), (10, "u", "y" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS frame")


def test_archives(spark):
    df = pages(spark)
    first = {}
    for r in df.collect():
        data = (r["html"] or "").encode()
        if r["page_id"] is not None:
            first[data] = min(first.get(data, r["page_id"]), r["page_id"])
    want = Counter()
    for r in df.collect():
        data = (r["html"] or "").encode()
        refers = first.get(data) if len(data) >= 100 and r["page_id"] != first.get(data) else None
        want[r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert Counter(tuple(r) for r in B.warc_round_trip(df).collect()) == want
    assert B.warc_round_trip(df.limit(0)).count() == 0


def test_seeks_and_plain_reader(spark):
    import zstandard

    from gramvec.llm.files import open_file

    df = pages(spark)
    folder = scratch_path(spark, "warc-test")
    index = B.write_bundles(df, folder, frame_bytes=2000)
    wanted = index.where("page_id IN (7, 1, 9)")
    got = {r["page_id"]: bytes(r["payload"]) for r in B.fetch_records(wanted, folder).collect()}
    assert got == {7: b"x" * 300_000, 1: b"short", 9: b""}
    n = 0
    for name in [r["bundle"] for r in index.select("bundle").distinct().collect()]:
        data = open_file(folder, name).read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        n += sum(1 for _ in B.parse_records(plain))
    assert n == df.count()


# ---------------------------------------------------------------- pipeline
def pipeline_corpus():
    """Enough labelled documents that cutoffs are certified, near copies, secrets, and odd rows."""
    import random

    rng = random.Random(12)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") * rng.randint(1, 2) + str(rng.randint(0, 300))
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(30, 60))]
        bad = i % 5 == 0
        if i % 9 == 1:
            words[4] = "password=" + "Ab3" * rng.randint(3, 6)
        if i % 31 == 2:
            words[7:9] = ["AKIA" + "Q7" * 9, "0123456789abcdef" * 2]
        text = " ".join(w + "###" if bad else w for w in words)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        labels.append((i, int(not bad), 0))
    copies = [(1000 + k, rows[k][1] if k % 2 else rows[k][1].upper(), "en", "b", len(rows[k][1])) for k in (1, 2, 3, 4, 6)]
    odd = [(2000, None, None, None, None), (2001, "too short", "en", "a", 9), (2002, " ".join(word() for _ in range(9000)), "xx", "c", 1)]
    return rows + copies + odd, labels


def chain(rows, cutoffs):
    """Plain Python up to the mix: the texts that go into sequences, with how many words of each are taken."""
    import duckdb
    import pandas as pd
    import re

    from gramvec.llm import risk_rules as R
    from gramvec.llm import secret_index as X
    from test_pairs_and_sketches import plain_components, plain_fingerprint

    kept = []
    for r in rows:
        n = dict(zip(R.COUNTS, R.counts_of(r[1])))
        cut = cutoffs.get("none" if r[2] is None else f"lang {r[2]}", {}).get("cutoffs")
        over = cut and any(n[a] / max(n[b], 1) > cut[k] for k, (a, b) in R.RULES.items())
        if n["n_words"] >= 20 and 100 * n["n_repeat_words"] <= 30 * n["n_words"] and not over:
            kept.append(r)
    root = plain_components([plain_fingerprint(r[1]) for r in kept])
    first = {}
    for r, c in zip(kept, root):
        first[c] = min(first.get(c, r), r, key=lambda x: x[0])
    masked = []
    for r in sorted(first.values()):
        spans = []
        for rule in X.RULES:
            spans += [m.span() for m in re.finditer(rule.pattern, r[1]) if len(m[rule.group]) >= rule.least]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += r[1][at:a] + X.MASK
            at = max(at, b)
        masked.append((r[0], out + r[1][at:], r[2], r[3], r[4]))
    documents = pd.DataFrame(masked, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    found = duckdb.sql(M.oracle()).fetchall()
    return len(kept), masked, {r[0]: r[-1] for r in found}


def test_pipeline_against_plain_python(spark, tmp_path):
    import re

    import corpus_pipeline as C
    from gramvec.llm import risk_rules as R

    rows, labels = pipeline_corpus()
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    cutoffs = R.certified_cutoffs(R.with_counts(docs.select("doc_id", "lang", "text")), lab)
    assert cutoffs["lang en"]["cutoffs"] and not cutoffs.get("lang xx", {}).get("cutoffs")
    n_kept, masked, taken = chain(rows, cutoffs)
    assert 500 < n_kept < 600 and len(masked) == n_kept - 2 and any("[SECRET]" in r[1] for r in masked)
    # what is taken of each text: whole, and once per source a beginning
    word = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    want = defaultdict(Counter)
    for doc_id, text, *_ in masked:
        size = len(word.findall(text))
        whole, rest = divmod(taken[doc_id], size)
        want[doc_id][text] += whole
        if rest:
            want[doc_id]["".join(word.findall(text)[:rest])] += 1
    packed = C.run(spark, str(tmp_path)).collect()
    found = defaultdict(Counter)
    for r in packed:
        found[r["doc_id"]].update((i, x) for i, x in enumerate(r["ids"], r["start"]))
    expected = defaultdict(Counter)
    for doc_id, texts in want.items():
        for text, n in texts.items():
            for _ in range(n):
                expected[doc_id].update(enumerate(plain_ids(text)))
    assert {k: v for k, v in found.items()} == {k: v for k, v in expected.items() if v}
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = corpus(spark, extra=False)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert C.ORACLE_SQL is None
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_keep_columns_of_their_own_names(spark):
    """An input may have the names that the operators give to columns of their own."""
    from pyspark.sql import functions as F

    from gramvec.llm import risk_rules as R
    from gramvec.llm import secret_index as X
    from gramvec.llm import simhash_pivots as P

    names = ["_secret_spans", "_secret_doc", "_secret_rules", "_secret_hit", "_quality_n_words", "_QUALITY_n", "_near_row", "__near_row", "_mix", "_mix_row"]
    docs = corpus(spark, extra=False).select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (X.redact(docs), R.keep_good(docs, lab), P.keep_one(docs), M.mix_documents(docs)):
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(f"own {c}" for c in names)}


def test_operators_run_from_another_folder(tmp_path):
    """Tasks find the package although neither folder nor path leads to it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from gramvec.session import local_session
from gramvec.llm.huffman_ids import huffman_round_trip
from gramvec.llm.language_codes import identify
from gramvec.llm.simhash_pivots import near_duplicates
spark = local_session(2, 2, "1g")
docs = spark.createDataFrame([(1, "a b c d", "en"), (2, "a b c d", "en")], "doc_id long, text string, lang string")
assert [r["component_id"] for r in near_duplicates(docs).collect()] == [1, 1]
assert huffman_round_trip(docs).count() == 2 and identify(docs).count() == 2
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" or root not in v}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]

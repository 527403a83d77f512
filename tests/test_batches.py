"""Ordinals, batches, padding, shards and the parquet round trip."""

import pytest
from pyspark.sql import functions as F

from gramvec.functions.permute import permuted
from gramvec.operators import batches as BA
from gramvec.operators import samples as SA
from gramvec.operators.ordinals import global_ordinal
from gramvec.params import Params
from gramvec.plans.prepare import Pipeline, prepare
from gramvec.sources.batch_io import read_batches, write_batches
from gramvec.sources.corpus import read_documents
from tests.conftest import SF, SMALL_CORPUS, docs

P = Params(batch_size=10, vocabulary_size=300, embedding_size=4, num_buckets=1000)


@pytest.fixture(scope="module")
def pipe(spark):
    return Pipeline(read_documents(spark, SF), P)


def test_global_ordinal_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    out, total = global_ordinal(df, ["k"], "ord", num_partitions=7, with_total=True)
    rows = sorted((r["k"], r["ord"]) for r in out.collect())
    assert total == 5000
    assert [o for _, o in rows] == list(range(5000))


def test_ordinals_are_stream_order(pipe):
    rows = pipe.ordered.select("pass", "doc_id", "sent_idx", "pos", "off", "ord").collect()
    rows.sort(key=lambda r: r["ord"])
    keys = [(r["pass"], r["doc_id"], r["sent_idx"], r["pos"], r["off"]) for r in rows]
    assert keys == sorted(keys)
    assert [r["ord"] for r in rows] == list(range(len(rows)))


def test_batches_full_and_equal_width(pipe):
    b = pipe.padded_batches.collect()
    n = pipe.total_samples // P.batch_size
    assert len(b) == n and n > 0
    assert sorted(r["batch_id"] for r in b) == list(range(n))
    for r in b:
        assert len(r["labels"]) == P.batch_size == len(r["inputs"])
        assert {len(x) for x in r["inputs"]} == {r["width"]}
        assert all(1 <= v < P.num_buckets for x in r["inputs"] for v in x if v != 0)
        assert all(0 <= lab < P.vocabulary_size for lab in r["labels"])


def test_unpadded_batches_keep_lengths(pipe):
    for r in pipe.batches.limit(20).collect():
        assert max(len(x) for x in r["inputs"]) == r["width"]


def test_shards(spark):
    b = spark.range(0, 5000).select(F.col("id").alias("batch_id"))
    s = {r["batch_id"]: r["shard"] for r in BA.with_shards(b, 3).collect()}
    assert s[0] == 0 and s[999] == 0 and s[1000] == 1 and s[2999] == 2 and s[3000] == 0


def test_roundtrip(spark, pipe, tmpdir_path):
    path = tmpdir_path + "/b"
    n = write_batches(pipe.padded_batches, path, 2)
    back = {r["batch_id"]: (r["inputs"], r["labels"], r["width"]) for r in read_batches(spark, path, P.batch_size).collect()}
    orig = {r["batch_id"]: (r["inputs"], r["labels"], r["width"]) for r in pipe.padded_batches.collect()}
    assert n == len(orig) and back == orig


def test_too_little_data_raises(spark, tmpdir_path):
    with pytest.raises(Warning):
        prepare(docs(spark, [SMALL_CORPUS]), Params(batch_size=128), tmpdir_path)


def test_shuffle_is_permutation(pipe):
    n = BA.full_batches(pipe.total_samples, P.batch_size)
    s = BA.shuffle_order(pipe.batches, n, 42, 0).collect()
    assert sorted(r["shuffle_rank"] for r in s) == list(range(n))
    assert [r["batch_id"] for r in sorted(s, key=lambda r: r["shuffle_rank"])] != sorted(r["batch_id"] for r in s)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 10_007])
def test_permutation_has_every_place_once(spark, n):
    ids = spark.range(n)
    one, other = (ids.select("id", permuted(F.col("id"), n, seed, "t").alias("rank")).toPandas() for seed in (1, 2))
    assert sorted(one["rank"]) == list(range(n)) == sorted(other["rank"])
    if n > 90:
        assert (one["rank"] == other["rank"]).mean() < 0.1
        assert abs(one["rank"].corr(one["id"])) < 0.2
        # halves mix: numbers of the first half land in the second as often as not
        assert 0.35 < (one["rank"][: n // 2] >= n // 2).mean() < 0.65


def test_sample_ordinals_over_passes(spark):
    p = P.replace(passes=3, rejection_threshold=1.0)
    pipe = Pipeline(docs(spark, [SMALL_CORPUS] * 5), p)
    rows = sorted(pipe.ordered.select("ord", "pass", "doc_id", "sent_idx", "pos", "off").collect())
    assert [r["ord"] for r in rows] == list(range(pipe.total_samples))
    keys = [tuple(r)[1:] for r in rows]
    assert keys == sorted(keys) and {k[0] for k in keys} == {0, 1, 2}
    want = pipe.samples.select("pass", "doc_id", "sent_idx", "pos", "off").collect()
    assert sorted(map(tuple, want)) == keys


def test_batches_of_chunks_are_those_of_their_samples(spark, monkeypatch):
    """Whole batches and those that lie across chunks and partitions, small and empty ones among them."""
    monkeypatch.setattr(BA, "CHUNK_SAMPLES", 1)
    words = ["ab", "äöü", "x", "a" * 40, "日本"]
    rows = [(words[i * i % 5], i % 7) for i in range(1003)]
    samples = spark.createDataFrame([(p, i, *r) for i, r in enumerate(rows) for p in [i // 400]], "p int, i long, target string, label int")
    samples = samples.repartitionByRange(5, "p").sortWithinPartitions("p", "i")  # few of the partitions have rows
    chunks, total = BA.sample_chunks(samples, 3)
    assert total == 1003 and max(r["n"] for r in chunks.collect()) <= 24
    want = {r["word"]: r["bucket_ids"] for r in SA.word_buckets(spark.createDataFrame([(w,) for w in words], "word string"), 3, 500).collect()}
    for padded in (False, True):
        got = {r["batch_id"]: r for r in BA.batches(chunks, total, 3, 3, 500, padded).collect()}
        assert sorted(got) == list(range(334))
        for k, r in got.items():
            some = [want[w] for w, _ in rows[3 * k : 3 * k + 3]]
            width = max(map(len, some))
            assert r["labels"] == [x for _, x in rows[3 * k : 3 * k + 3]] and r["width"] == width
            assert r["inputs"] == [x + [0] * (width - len(x)) * padded for x in some]


def test_no_sample_is_shuffled_to_its_batch(spark, monkeypatch):
    pipe = Pipeline(read_documents(spark, SF), P)
    plan = pipe.padded_batches._jdf.queryExecution().optimizedPlan().toString()
    whole, rest = plan.split("MapInArrow", 2)[1:]
    assert "Aggregate" not in whole and "Aggregate [batch_id" in rest
    ends = [r["n"] for r in pipe._chunks[0].collect()]
    assert sum(ends) == pipe.total_samples and len(ends) * 20 < sum(ends)


def test_stored_batches_are_plain_numbers(spark, pipe, tmpdir_path):
    import glob

    import pyarrow.parquet as pq

    write_batches(pipe.padded_batches, tmpdir_path + "/b", 2)
    files = glob.glob(tmpdir_path + "/b/shard=*/*.parquet")
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        for c in map(group.column, range(group.num_columns)):
            assert c.compression == "ZSTD" and not any("DICTIONARY" in e for e in c.encodings)
    assert files

"""Skew handling and partition invariance."""

from pyspark.sql import functions as F

from gramvec.operators.joins import salted_join
from gramvec.params import Params
from gramvec.plans.prepare import Pipeline
from tests.conftest import UNPUNCTUATED, docs


def test_salted_join_equals_plain_join_with_hot_key(spark):
    # one key holds 90% of the rows of the big side
    big = spark.range(0, 20000).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).otherwise(F.lit("hot")).alias("key"),
    )
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 10) for i in range(97)], "k string, v int")
    hot = spark.createDataFrame([("hot", 16)], "key string, n_salts int")
    got = salted_join(big, small, "key", "k", hot, ["rid"]).select("rid", "key", "v")
    want = big.join(small, big.key == small.k).select("rid", "key", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the hot key is spread over its salts
    salts = big.join(F.broadcast(hot), big.key == hot.key).select(F.pmod(F.xxhash64("rid"), F.lit(16)).alias("s"))
    assert salts.distinct().count() == 16


def test_batches_partition_invariant(spark):
    p = Params(batch_size=16, vocabulary_size=30, num_buckets=500, passes=40, rejection_threshold=1.0)

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        b = Pipeline(docs(spark, [UNPUNCTUATED, UNPUNCTUATED.upper()], "en"), p).padded_batches
        return sorted((r["batch_id"], tuple(map(tuple, r["inputs"])), tuple(r["labels"])) for r in b.collect())

    try:
        assert run(1) == run(6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_large_tables_are_neither_broadcast_nor_skewed(spark):
    from gramvec.operators.joins import bounded_join

    big = spark.range(0, 60000, 1, 4).select(F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("context"), "id")
    side = spark.createDataFrame([("the", 0), *((f"w{i}", i + 1) for i in range(1000))], "context string, label int")
    old = spark.conf.get("gramvec.broadcast.maxBytes", None)
    joined = bounded_join(big, side, "context", 1_000_000, 96)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # only the table of hot keys, 256 rows at most, is broadcast
    assert "SortMergeJoin [context" in plan and plan.count("BroadcastHashJoin") == 2
    assert joined.columns == ["context", "id", "label"]
    assert joined.where("(context = 'the') <> (label = 0)").count() == 0 and joined.count() == 60000
    left = bounded_join(big, side.where("label = 0"), "context", 1_000_000, 96, "left")
    assert left.count() == 60000 and left.where("label is null").count() == 30000
    assert old is None


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from gramvec.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        checkpoint_root(Session())

"""Join helpers: broadcast only behind a proven size bound, salting for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest broadcast we allow (bytes, from a parameter-proven row bound).
DEFAULT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def broadcast_limit(spark) -> int:
    try:
        return int(spark.conf.get("gramvec.broadcast.maxBytes", str(DEFAULT_BROADCAST_MAX_BYTES)))
    except Exception:  # pragma: no cover
        return DEFAULT_BROADCAST_MAX_BYTES


def fits(spark, max_rows: int, row_bytes: int) -> bool:
    """Whether a table of this bound (known from parameters, not an estimate of the data) may be broadcast."""
    return int(max_rows) * int(row_bytes) <= broadcast_limit(spark)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    big_key: str,
    small_key: str,
    hot: DataFrame,
    row_key_cols: list[str],
    how: str = "inner",
    merge: bool = False,
) -> DataFrame:
    """Equi-join ``big.big_key = small.small_key`` where some keys are hot.

    ``hot(key, n_salts)`` lists the hot keys with their number of salts; it
    must have a proven size bound (it is broadcast). Rows of ``big`` with a
    hot key spread over ``n_salts`` sub-keys by a hash of their row key;
    the matching ``small`` rows are replicated ``n_salts`` times. Every
    other key keeps salt 0. No key group then exceeds its share.
    """
    hb = F.broadcast(hot.select(F.col("key").alias("_hk"), F.col("n_salts").alias("_ns")))
    b = big.join(hb, F.col(big_key) == F.col("_hk"), "left").withColumn(
        "_salt",
        F.when(F.col("_ns").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in row_key_cols]), F.col("_ns")).cast("int")
        ),
    ).drop("_hk", "_ns")
    s = small.join(hb, F.col(small_key) == F.col("_hk"), "left").select(
        *[F.col(c) for c in small.columns],
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)).cast("int") - 1)).alias("_salt2"),
    )
    if merge:
        s = s.hint("merge")
    out = b.join(s, (F.col(big_key) == F.col(small_key)) & (F.col("_salt") == F.col("_salt2")), how)
    return out.drop("_salt", "_salt2")


def hot_keys(counts: DataFrame, key: str, count: str, salt_rows: int = 20_000) -> DataFrame:
    """``(key, n_salts)`` of the keys that hold over 1/256 of all rows, so 256 rows at most.

    ``counts`` has one row per ``key`` with its row ``count``. A hot key gets
    one salt per ``salt_rows`` rows, 1024 at most.
    """
    total = counts.agg(F.sum(count).alias("_total")).scalar()
    return counts.where((F.col(count) * 256 > total) & (F.col(count) > salt_rows)).select(
        F.col(key).alias("key"), F.least(F.ceil(F.col(count) / salt_rows), F.lit(1024)).cast("int").alias("n_salts")
    )


def bounded_join(
    big: DataFrame, small: DataFrame, key: str, max_rows: int, row_bytes: int, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """``big`` join ``small`` on their common column ``key``, unique in ``small``.

    ``small`` is broadcast if its bound fits; otherwise the join is a shuffle
    whose hot keys are salted: those of ``hot(key, n_salts)``, a table of
    bounded size, or the ones that ``big`` itself has very often.
    """
    if fits(big.sparkSession, max_rows, row_bytes):
        return big.join(F.broadcast(small), key, how)
    if hot is None:
        hot = hot_keys(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n")
    side = small.withColumnRenamed(key, "_side_key")
    others = [c for c in big.columns if c != key] or [key]
    return salted_join(big, side, key, "_side_key", hot, others, how, merge=True).drop("_side_key")

"""Distributed dense row numbers in a total order.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead: range-partition on the order key, sort inside partitions, number the
rows of each partition, and add the row count of all earlier partitions. Only
one number per partition (bounded by the partition count) is brought to the
driver. The order key must be unique, which makes the numbering deterministic
on any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramvec.session import scratch_path

_LOW33 = (1 << 33) - 1


#: How large tables of lists are written: repeats of whole lists are found in plain numbers, not in packed dictionary codes.
PLAIN = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage); ``plain``: as ``PLAIN`` says."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(PLAIN if plain else {"compression": "zstd"})).parquet(path)
    return df.sparkSession.read.parquet(path)


_written = materialize  # where a parameter has that name


def _order_cols(cols) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cols]


def global_ordinal(
    df: DataFrame,
    order_by,
    name: str = "ord",
    num_partitions: int | None = None,
    with_total: bool = False,
    materialize: bool = True,
    stage_input: bool = False,
):
    """Add ``name`` = 0-based position of each row in ``order_by`` (a unique key).

    The sorted, tagged rows are written once to the shared checkpoint folder
    (``materialize``) so the upstream plan runs once and the lineage is cut;
    the per-partition counts are then read from that table.
    ``stage_input`` writes the input first: range partitioning runs its
    input once to sample the bounds and again to shuffle, so an expensive
    upstream plan is better read back from a file.
    Returns the DataFrame, or ``(DataFrame, total_rows)`` if ``with_total``.
    """
    spark = df.sparkSession
    if stage_input:
        path = scratch_path(spark, "ordinal-input")
        df.write.option("compression", "zstd").parquet(path)
        df = spark.read.parquet(path)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order_cols(order_by)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out, total = ordinal_in_place(ordered, name, materialize)
    return (out, total) if with_total else out


def ordinal_in_place(ordered: DataFrame, name: str = "ord", materialize: bool = True) -> tuple[DataFrame, int]:
    """``(ordered with its row number, rows)`` of rows that are in order across partitions and inside each.

    Nothing is shuffled or sorted: a row's number is the rows of the
    partitions before its own plus its place in the partition. The rows are
    written once (``materialize``) as they stand.
    """
    spark = ordered.sparkSession
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    if materialize:
        path = scratch_path(spark, "ordinal")
        tagged.write.option("compression", "zstd").parquet(path)
        tagged = spark.read.parquet(path)
    counts = tagged.groupBy("_pid").count().collect()
    offsets, running = [], 0
    for row in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(row["_pid"]), running))
        running += int(row["count"])
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    out = (
        tagged.join(F.broadcast(off_df), "_pid")
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)))
        .drop("_pid", "_mid", "_off")
    )
    return out, running


def prefix_sums(rows: DataFrame, order: list[str], value: str, name: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``name``: sum of ``value`` over the rows that come before in ``order``.

    With ``by`` only rows of equal ``by`` count (null equals null). Rows are
    dealt to ranges of (``by``, ``order``) and written once; a window holds one
    range of one key, and another the totals of a key's ranges, of which there
    are as many as partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if by else []
    ranged = rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = _written(ranged, "prefix-ranges")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    earlier = F.sum("_total").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_total")
    totals = totals.select(*[F.col(k).alias("_by") for k in keys], F.col("_range").alias("_in"), earlier.alias("_earlier"))
    inside = F.sum(value).over(W.partitionBy(*keys, "_range").orderBy(*order)) - F.col(value)
    same = F.col("_range") == F.col("_in")
    if by:
        same = F.col(by).eqNullSafe(F.col("_by")) & same
    joined = ranged.withColumn("_inside", inside).join(totals, same)
    return joined.withColumn(name, F.col("_earlier") + F.col("_inside")).select(*rows.columns, name)

"""The loss report over the training log that ``fit`` is writing.

``fit`` notes each round whose model and log are complete as a small file in
``rounds_done``; this query streams those files. A micro-batch reads the logs
of its rounds alone and writes sums per block of steps under its own number,
so a micro-batch that runs again replaces what it wrote. A round that is still
under way, or whose attempt was lost, has no file and is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramvec.params import LOSS_REPORT_EVERY
from gramvec.session import make_folder, path_exists
from gramvec.sources.model_io import DONE_SCHEMA, done_dir, log_dir

PARTS_SCHEMA = "block long, first_step long, last_step long, n_steps long, loss_sum double"


def start_training_monitor(
    spark: SparkSession,
    model_dir: str,
    report_dir: str,
    checkpoint: str,
    every: int = LOSS_REPORT_EVERY,
    available_now: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Start following ``model_dir``; ``available_now`` processes the rounds that are complete and stops."""

    def write(batch: DataFrame, number: int) -> None:
        rounds = sorted(r["round"] for r in batch.select("round").distinct().collect())  # a number for each round
        if not rounds:
            return
        log = batch.sparkSession.read.schema("step long, loss double").parquet(*[log_dir(model_dir, r) for r in rounds])
        parts = log.groupBy(F.floor(F.col("step") / int(every)).cast("long").alias("block")).agg(
            F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n_steps"), F.sum("loss").alias("loss_sum")
        )
        parts.write.mode("overwrite").parquet(f"{report_dir.rstrip('/')}/batch={number}")

    query = spark.readStream.schema(DONE_SCHEMA).json(make_folder(spark, done_dir(model_dir))).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime=interval)
    return query.start()


def training_report(spark: SparkSession, report_dir: str) -> DataFrame:
    """``(block, first_step, last_step, n_steps, mean_loss)`` of all rounds seen so far."""
    if not path_exists(spark, report_dir):
        return spark.createDataFrame([], "block long, first_step long, last_step long, n_steps long, mean_loss double")
    parts = spark.read.schema(PARTS_SCHEMA).parquet(report_dir)
    return parts.groupBy("block").agg(
        F.min("first_step").alias("first_step"),
        F.max("last_step").alias("last_step"),
        F.sum("n_steps").alias("n_steps"),
        (F.sum("loss_sum") / F.sum("n_steps")).alias("mean_loss"),
    )

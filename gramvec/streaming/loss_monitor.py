"""The periodic loss report as a streaming query (A7 over a live log).

Training appends ``training_log`` parquet files round by round; this query
reads them as a file stream and keeps the mean loss per block of steps,
like the original's hook that prints every 2000 steps, but exact (Q9).
Its state is one row per block; ``foreachBatch`` overwrites the report
table with the complete result of each micro-batch (idempotent on retry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramvec.params import LOSS_REPORT_EVERY

LOG_SCHEMA = "step long, loss double, learnrate double"


def report_stream(spark: SparkSession, log_dir: str, every: int = LOSS_REPORT_EVERY) -> DataFrame:
    stream = spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(log_dir)
    return stream.groupBy(F.floor(F.col("step") / int(every)).cast("long").alias("block")).agg(
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
        F.count(F.lit(1)).alias("n_steps"),
        F.avg("loss").alias("mean_loss"),
    )


def start_loss_monitor(
    spark: SparkSession, log_dir: str, report_path: str, checkpoint: str, every: int = LOSS_REPORT_EVERY,
    available_now: bool = False, interval: str = "30 seconds",
) -> StreamingQuery:
    """Start the monitor; ``available_now`` processes what exists and stops."""

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(report_path)

    w = report_stream(spark, log_dir, every).writeStream.outputMode("complete").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()

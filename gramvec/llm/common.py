"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramvec.session import scratch_path, ship_package

#: A word: a run of characters other than the ASCII space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators as a Python ``str.translate``-free byte set.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, for tasks that need this package: it is sent to the executors before their function is made."""
    ship_package(df.sparkSession)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (NULL text: empty array)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def fresh(df: DataFrame, prefix: str) -> str:
    """``prefix``, longer by underscores where a column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix

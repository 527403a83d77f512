"""Session helpers: a tuned local session for tests and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session configured the way the jobs expect (AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gramvec")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set (a file system that all executors share).
    Only a session whose master is ``local`` gets a fresh temporary folder
    where nothing is set; any other session without one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gramvec-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application.

    Tasks import it by name; without this they find it only where it is
    installed or on their path. Operators call it, most of them through
    ``scratch_path``; tasks that name the package are made after it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gramvec-ship-"), "gramvec.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gramvec", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path for a written intermediate table in the shared folder; also sends the package to the executors."""
    ship_package(spark)
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_ARROW_BYTES, _ARROW_DEFAULT, _ARROW_SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small_arrow_batches(spark: SparkSession) -> None:
    """Let Arrow batches be small, where no one has set their size: a row may be a batch of samples or a chunk of them,
    and a task's workers hold several Arrow batches at a time."""
    if spark.conf.get(_ARROW_BYTES, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_BYTES, _ARROW_SMALL)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def list_dir(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return [str(s.getPath().getName()) for s in fs.listStatus(jpath)]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it, through the Hadoop file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def require_path(spark: SparkSession, path: str, what: str) -> str:
    """``path`` if it exists on its file system; else an error that names ``what``."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no {what} at {path}")
    return path


def make_folder(spark: SparkSession, path: str) -> str:
    """``path`` as a folder, made if it isn't there."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)
    return path

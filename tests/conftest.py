import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

# A small corpus whose word counts and sentences must match (its goldens are in the tests).
SMALL_CORPUS = """dies ist eine test datei.
der text hier ist testtext.
bla bla bla.
"""

UNPUNCTUATED = """seven boats left the old harbour before the first light and the wind that had
 been quiet for two days turned slowly to the north so the one captain who knew the
  shallow water asked the others to follow him past the two towers and the long wall
  of stones where the king of the islands once kept his ships and where nobody from
  the kingdom had dared to land since the night the tower burned and one of the seven
  boats was lost with two of its men and all the water and bread they had on board"""

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("gramvec-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    # tests run locally: a checkpoint folder is set only because none is configured
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gramvec-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="gramvec-test-")


def docs(spark, texts, lang="de"):
    return spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[*]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusflow-test-"))
    yield spark


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(autouse=True)
def files_at_rest(request):
    """A test that counts shuffle files begins when those of earlier tests are no longer being deleted."""
    if "shuffle_files" in request.node.name:
        import gc
        import time
        jvm = request.getfixturevalue("spark")._jvm
        gc.collect()
        jvm.System.gc()
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        counts = [-1]
        while len(counts) < 60 and (len(counts) < 5 or len(set(counts[-4:])) > 1):
            time.sleep(0.5)
            counts.append(files.getAllFiles().size())
    yield

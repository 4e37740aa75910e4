import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYTHONPATH", ROOT)
    s = (
        SparkSession.builder.master("local[*]")
        .appName("replysift-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        # a static setting: only the context's folder can be set at run time
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="replysift-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="replysift-test-")


def listing(spark, responses, items=None, ids=None, extra=None):
    """Small listing with the usual headers (strings only)."""
    from pyspark.sql import types as T

    n = len(responses)
    ids = ids or [str(i) for i in range(n)]
    items = items or ["Item A"] * n
    cols = ["Query ID", "CRF Item", "Site Response"]
    rows = [[ids[i], items[i], responses[i]] for i in range(n)]
    if extra:
        for name, values in extra.items():
            cols.append(name)
            for i in range(n):
                rows[i].append(values[i])
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
    return spark.createDataFrame(rows, schema)

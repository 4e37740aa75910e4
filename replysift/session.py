"""Session settings for local runs, tests and the benchmark.

On a cluster the session comes from the environment; only what a job needs
is set here, and ``spark.checkpoint.dir`` is never overridden when present.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "replysift", event_log_dir: str | None = None) -> SparkSession:
    """``event_log_dir`` writes Spark's event log there (stage and task times
    without the web UI; read it with ``tools/stage_times.py``)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores
    builder = SparkSession.builder
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REPLYSIFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files (export positions) go once their DataFrame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED_ATTR = "_replysift_shipped"


def ship_package(spark: SparkSession) -> None:
    """Make ``replysift`` importable in Python workers: zip the package on the driver
    and ``addPyFile`` it once per context. Spark copies the file to every executor
    itself, so no shared folder and no particular file system is involved.
    Deployments that already ship it (``--py-files``) are unaffected."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: ship as an artifact instead
        sc = None
    holder = sc if sc is not None else spark
    if getattr(holder, _SHIPPED_ATTR, False):
        return
    import tempfile
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="replysift-pkg-"), "replysift.zip")
    with zipfile.ZipFile(target, "w") as z:
        for root, _dirs, names in os.walk(pkg_dir):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(target)
    else:
        spark.addArtifacts(target, pyfile=True)
    setattr(holder, _SHIPPED_ATTR, True)

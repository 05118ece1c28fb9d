"""Session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only fall back to a folder of our own when it is
unset (tests on one machine).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the engine defaults.

    ``master`` is only applied when a new session is created (local runs and
    tests); on a cluster the submitting environment decides it.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "12g"))
    for k, v in _DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: ``spark.checkpoint.dir`` when the cluster sets
    it, otherwise a fresh local folder (single-machine tests only)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable in Python workers (pandas UDFs pickle
    functions by module reference).  The package is zipped once and handed to
    ``SparkContext.addPyFile``, which distributes it to every executor."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship with spark.addArtifacts instead
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="ledgerlens-pkg-")
    archive = shutil.make_archive(os.path.join(base, "ledgerlens"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="ledgerlens")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: lineage is cut, later scans are columnar with pushed filters, and a
    lost executor re-reads files instead of recomputing upstream joins."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

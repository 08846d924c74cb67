"""Session settings the library is written for.

A cluster supplies its own session; :func:`local_session` is for tests and the
benchmark. Nothing here is needed for correctness except the UTC time zone.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "scorebook") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("SCOREBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # Call-site capture for every column expression costs more than small queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's own where it names one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    # One process: every task sees the driver's own disk.
    local = tempfile.mkdtemp(prefix="scorebook-checkpoint-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of jobs that run its classes, once per application."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="scorebook-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/scorebook_package", "zip", root, "scorebook"))
    _SHIPPED.add(app)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark stores it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders directly below a folder; empty if it does not exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    return [s.getPath().toString() for s in store.listStatus(place) if s.isDirectory()]

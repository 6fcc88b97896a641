"""Session settings that hold from a laptop to a large cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and splits skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int | None = None, **settings: str) -> SparkSession:
    """A session on this machine; on a cluster the submit command's settings rule."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus))
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _temporary(prefix: str) -> str:
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or in local mode a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or _temporary("checkpoints-"))
    return sc.getCheckpointDir()


_shipped: weakref.WeakSet = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that Python functions find
    it there whatever their working folder and path are."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(_temporary("code-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc)

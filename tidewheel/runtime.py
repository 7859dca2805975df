"""What runs beside the plans: shipping this code to executors, and the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where neither that setting nor the context names one, and driver and executors are one process (tests), a folder is made for it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-checkpoint-"))
        named = sc.getCheckpointDir()
    return named


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that they needn't have it installed.

    Where the session has no setting of its own, Arrow batches are made smaller: whole texts are rows here.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, "2048")
    if getattr(sc, "_tidewheel_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="tidewheel-"), "tidewheel_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    sc._tidewheel_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

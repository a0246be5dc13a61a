"""Session helpers: settings for local use, and shipping the package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A local session as tests and ``bench.py`` use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wavemill")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # kept frames go with the last frame that reads them
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def kept(rows: DataFrame) -> DataFrame:
    """The frame computed once and kept in the folder of ``spark.checkpoint.dir``,
    which all executors share (in the warehouse, where that is unset)."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        conf = rows.sparkSession.conf
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return rows.checkpoint()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, for functions that run in Python.

    Does nothing on later calls for the same application.
    """
    context = spark.sparkContext
    if getattr(context, "_wavemill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "wavemill_code.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.join("wavemill", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._wavemill_shipped = True

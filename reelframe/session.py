"""What the Python workers need from the session: this package; and tables kept in the folder that all machines share. Batches are left as the session has them: Spark bounds their bytes."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as room:
        shutil.copytree(home, f"{room}/tree/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", f"{room}/tree"))
    _shipped.add(context.applicationId)


def kept(df: DataFrame) -> DataFrame:
    """The same rows by a checkpoint below ``spark.checkpoint.dir``, so that what follows starts from them; removed once no table is made from them. Where that is unset, a local folder serves on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared"))
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)

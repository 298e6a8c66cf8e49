"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows go to Python in batches of at most so many bytes, unless the session names another bound.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a session, and bound what they get at once."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if getattr(sc, "_tarn_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tarn-"), "tarn_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tarn", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._tarn_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the checkpoint folder; only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    scratch(df.sparkSession, "")
    return df.checkpoint(eager=True)

"""Tables that cut lineage, kept where driver and executors both see them.

The folder is the one that ``spark.checkpoint.dir`` names; a private folder is
used only where that setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        os.makedirs(own)
        _OWN.append(f"file://{own}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    here, so a lost executor costs a reread and nothing upstream runs twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_only(df: DataFrame, name: str) -> DataFrame:
    """``save``, after which the shuffle files of what led there go: Spark drops them only when the driver collects garbage."""
    saved = save(df, name)
    for _ in range(2):  # what the first finds unused the second frees
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(1)
    return saved

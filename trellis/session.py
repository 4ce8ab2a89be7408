"""Lineage cuts for iterative operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (local sessions)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trellis-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows starts from the files, on any executor.

    A written table, not ``checkpoint()``, because a checkpointed plan keeps its size estimate; in a loop of joins the estimates
    multiply until planning, not work, takes the time."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/trellis-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

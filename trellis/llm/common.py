"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_BITS = 24
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application, and keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="trellis-ship-")) / "trellis_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset in a local
    session, as in tests, a temporary folder of this process takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trellis-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs no
    more than the tasks that read the table. The shuffle files that made it are given up at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/trellis-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner follows the driver's garbage collector
    out = spark.read.schema(df.schema).parquet(path)
    out._trellis_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._trellis_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parted(docs: DataFrame, ids: DataFrame, by: str = "doc_id", of: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose ``by`` is surely not among the ids in column ``of``, nulls among them; the rest): only the rest needs a join, and
    texts that have nothing to meet are not shuffled.

    The test is a bitmap of ``1 << MEMBER_BITS`` hashed places, as at most 2 ** 18 rows of 64 bits, whatever the number of ids: that
    bounds what is broadcast. It only spares rows a shuffle; the join behind it decides. It runs in the JVM, so that a stage with a Python
    kernel needs no second set of workers."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << MEMBER_BITS))
    at = ids.select(place(F.col(of)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("member_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("member_bits"))
    words = F.broadcast(materialise(words, "membership"))
    spot = place(docs[by])
    bit = F.call_function("shiftright", words["member_bits"], (spot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    here = docs[by].isNotNull() & (F.shiftright(spot, 6) == words["member_word"]) & bit
    return docs.join(words, here, "left_anti"), docs.join(words, here, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns that clash or are extra are left to the caller."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

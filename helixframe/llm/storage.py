"""Tables between jobs, in the folder that driver and executors share; they cut the lineage and outlive lost executors.

A table is deleted when no DataFrame reads it any more: every plan over it holds the same file index, and release()
looks whether the driver's garbage collector has found that index unreachable. Tables that live to the end of the
application stay, as checkpoints do.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of written tables with a weak reference to the file index of their plans, by application.
_written: dict[str, list[tuple[str, object]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder is set. A cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and return the table, so that later jobs neither compute them again nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _written.setdefault(spark.sparkContext.applicationId, []).append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced, and delete the tables that none reads."""
    context = spark.sparkContext
    for _ in range(2):  # listeners may hold a finished plan for a moment
        gc.collect()
        context._jvm.System.gc()
        time.sleep(0.2)
    left = []
    for path, index in _written.pop(context.applicationId, []):
        if index.get() is None:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        else:
            left.append((path, index))
    _written[context.applicationId] = left

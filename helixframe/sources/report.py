"""What a session and its tables look like: short views for people, as DataFrames."""

from __future__ import annotations

import platform

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_report(spark: SparkSession) -> DataFrame:
    """(item, value): versions and the settings that plans depend on."""
    rows = [("python", platform.python_version()), ("pyspark", pyspark.__version__), ("spark", spark.version), ("numpy", np.__version__), ("pandas", pd.__version__), ("pyarrow", pa.__version__), ("master", spark.sparkContext.master), ("parallelism", str(spark.sparkContext.defaultParallelism))]
    rows += [(key, str(spark.conf.get(key, None))) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.checkpoint.dir")]
    return spark.createDataFrame(rows, "item string, value string")


def shown(seqs: DataFrame, width: int = 40) -> DataFrame:
    """(seq_id, name, width, view): each sequence's length and its two ends with dots between, as far as `width` characters go."""
    half = (width - 3) // 2
    ends = F.concat(F.substring("seq", 1, half), F.lit("..."), F.substring(F.col("seq"), -half, half))
    return seqs.select("seq_id", "name", F.length("seq").cast("long").alias("width"), F.when(F.length("seq") > width, ends).otherwise(F.col("seq")).alias("view"))

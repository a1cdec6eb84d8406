"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep

EDGE = "u long, v long"


def spanning_stars(edges: DataFrame) -> DataFrame:
    """Per partition, edges from every node to the smallest node it is linked with there; the links between nodes stay as they are."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent[x]) != x:
                parent[x] = parent[p]
                x = p
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = np.array([(x, root(x)) for x in parent if parent[x] != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])

    return edges.select("u", "v").mapInArrow(join, EDGE)


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: neighbours are hung on the smallest node around."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't its component's smallest; edges: (u, v). Every round is written to the shared folder."""
    now = keep(spanning_stars(edges.where("u <> v")), "components")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, now = state, keep(star(now), "components")

"""Sharding by histogram sort, under the law `bytes`: shards of near-equal sizes, each a range of one sort key.

Plan: a compact table (id, size, checksum, key; no texts) is written once. Candidate key boundaries are counted
exactly over all partitions and refined until every splitter meets its target within the tolerance; a last count
gives the rows below every boundary, so that slots need no global sort. Then the rows are exchanged once.
The driver holds boundaries and their sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep, release

SHARDS = 40
#: What a row weighs besides its text.
ROW_BYTES = 16
#: A splitter stands when the bytes below it miss the target by no more than this part of a shard.
TOLERANCE = 0.002
#: Candidate boundaries tried at once in the gap of one splitter.
PROBES = 24
#: Rows that one task sorts and numbers.
RANGE_ROWS = 100_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sort_key() -> Column:
    """Equal texts stand together: the high 40 bits are of the text's hash. The low 24 bits, of the id's and the row number's hash, part a group that outgrows a shard or a task, also one of repeated rows."""
    high = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 24), 24)
    return high.bitwiseOR(F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1)))


def sums_below(rows: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each of the sorted boundaries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(bounds, np.asarray(batch.column("key")), "right")
            np.add.at(size, at, np.asarray(batch.column("size")))
            number += np.bincount(at, minlength=len(number))
        there = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (there, size[there], number[there])], ["at", "size", "number"])

    parts = rows.select("key", "size").mapInArrow(count, "at long, size long, number long")
    size, number = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in parts.groupBy("at").agg(F.sum("size").alias("size"), F.sum("number").alias("number")).collect():
        size[r["at"]], number[r["at"]] = r["size"], r["number"]
    return np.cumsum(size)[:-1], np.cumsum(number)[:-1]


def splitters(rows: DataFrame, total: int, shards: int = SHARDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Keys that part the rows into `shards` ranges of near-equal bytes: row x belongs to range i if exactly i splitters are <= its key.

    Every round keeps, for each splitter, the gap between the nearest boundaries below and above its target and
    probes that gap anew; a gap of one key can't be parted further.
    """
    targets = [total * i // shards for i in range(1, shards)]
    low, high = [LOW] * len(targets), [HIGH] * len(targets)
    below, above = [0] * len(targets), [total] * len(targets)
    best: list[tuple[int, int]] = [(abs(t), LOW) for t in targets]
    slack = tolerance * total / shards
    while True:
        probes: set[int] = set()
        for i, t in enumerate(targets):
            gap = high[i] - low[i]
            if best[i][0] > slack and gap > 1:
                # Keys are spread evenly, so the target lies near the straight line; half of the probes gather there.
                guess = low[i] + int(gap * (t - below[i]) / max(1, above[i] - below[i]))
                near = max(1, gap // 2048)
                probes.update(low[i] + gap * j // (PROBES // 2 + 1) for j in range(1, PROBES // 2 + 1))
                probes.update(min(max(guess + near * j, low[i] + 1), high[i] - 1) for j in range(-(PROBES // 4), PROBES // 4 + 1))
        if not probes:
            return np.array(sorted(key for _, key in best), np.int64)
        bounds = np.array(sorted(probes), np.int64)
        size, _ = sums_below(rows, bounds)
        keys, sizes = bounds.tolist(), size.tolist()
        for i, t in enumerate(targets):
            at = int(np.searchsorted(size, t))
            for j in (at - 1, at):
                if 0 <= j < len(keys):
                    best[i] = min(best[i], (abs(sizes[j] - t), keys[j]))
            if at > 0 and keys[at - 1] > low[i]:
                low[i], below[i] = keys[at - 1], sizes[at - 1]
            if at < len(keys) and keys[at] < high[i]:
                high[i], above[i] = keys[at], sizes[at]


def fine_edges(rows: DataFrame, cuts: np.ndarray, number: int, most: int = RANGE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(edges, rows below each): the cuts and as many boundaries between them that no range has more than twice `most` rows, unless they share a key."""
    ranges = -(-number // most)
    edges = np.unique(np.concatenate([cuts, np.array([LOW + ((1 << 64) * j) // ranges for j in range(1, ranges)], np.int64)]))
    while True:
        _, before = sums_below(rows, edges)
        counts = np.diff([0, *before.tolist(), number])
        bounds = [LOW, *edges.tolist(), HIGH + 1]
        more: set[int] = set()
        for i in np.flatnonzero(counts > 2 * most).tolist():
            gap, pieces = bounds[i + 1] - bounds[i], max(PROBES, -(-int(counts[i]) // most))
            more.update(bounds[i] + gap * j // pieces for j in range(1, pieces))
        more.difference_update(bounds)
        if not more:
            return edges, before
        edges = np.array(sorted({*edges.tolist(), *more}), np.int64)


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Deal all documents into `shards` shards of near-equal bytes; slots number each shard's rows from 0 in key order.

    size counts a null text as empty. Equal texts get neighbouring keys, so a group stays in one shard unless a
    splitter must cut it. A null doc_id is a value like another; repeated rows each get a slot. An empty table gives
    no rows. Columns other than doc_id and text aren't read.
    """
    release(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = keep(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key().alias("key")), "shards")
    total, number = rows.agg(F.sum("size"), F.count("*")).first()
    cuts = splitters(rows, total or 0, shards, tolerance)
    # Finer ranges for the one exchange; a shard's splitters are among their boundaries.
    edges, before = fine_edges(rows, cuts, number, range_rows)
    before = np.concatenate([[0], before])
    shard = np.searchsorted(cuts, np.concatenate([[LOW], edges]), "right")
    first = before[np.searchsorted(shard, shard, "left")] if len(shard) else before
    offsets = before - first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, np.asarray(batch.column("key")), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(shard[at], pa.int32()), pa.array(offsets[at], pa.int64())], [*batch.schema.names, "part", "shard", "offset"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, part long, shard int, offset long")
    order = Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

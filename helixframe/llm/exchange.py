"""Exchange of 64-bit keys in packed blocks: a few rows per task in place of one row per key.

A key's part is the place of its high bits in 0..parts-1; its low 56 bits travel, 7 bytes each, with the rows'
owners as (id, tag, count) runs; a tag is 0 to 3. A task that gets a part sees all equal keys together. Parts are as many as the number
of keys asks for, so a part's memory stays bounded at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .words import U64, mix, tidy

#: Keys in a part on average; a task needs about 100 bytes for each.
PART_KEYS = 1_250_000
#: Keys a task gathers before it passes them on.
FLUSH_KEYS = 500_000
SCHEMA = "part int, keys binary, ids binary, counts binary"
LOW = U64((1 << 56) - 1)


def parts_for(keys: int) -> int:
    return max(1, -(-keys // PART_KEYS))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the values that occur: work grows with the rows at hand, however many parts there are."""
    if len(sorted_values):
        starts = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
        yield from zip(sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)], strict=True)


class Packer:
    """Gathers (key, id) rows and gives them out as one row per part."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.ids, self.tags, self.held = parts, [], [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, tags: np.ndarray | int = 0) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.tags.append(np.broadcast_to(np.asarray(tags, np.int8), keys.shape))
        self.held += len(keys)
        if self.held >= FLUSH_KEYS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, U64)
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        tags = np.concatenate(self.tags) if self.tags else np.empty(0, np.int8)
        self.keys, self.ids, self.tags, self.held = [], [], [], 0
        part = part_of(keys, self.parts)
        order = np.argsort(part, kind="stable")
        keys, ids, tags = keys[order], ids[order], tags[order]
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        for p, start, end in runs(part[order]):
            low = keys[start:end].view(np.uint8).reshape(-1, 8)[:, :7]
            own, tag = ids[start:end], tags[start:end]
            first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (tag[1:] != tag[:-1])]))
            rows.append((p, low.tobytes(), own[first].tobytes(), (np.diff(np.append(first, len(own))) * 4 + tag[first]).astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["part", "keys", "ids", "counts"])


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (low bits of key, id, tag) rows of a part."""
    keys, ids, tags = [], [], []
    for k, i, c in zip(*(table.column(x) for x in ("keys", "ids", "counts")), strict=True):
        low = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, 7)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :7] = low
        keys.append(wide.view(U64)[:, 0])
        count = np.frombuffer(c.as_buffer(), np.int32)
        ids.append(np.repeat(np.frombuffer(i.as_buffer(), np.int64), count >> 2))
        tags.append(np.repeat((count & 3).astype(np.int8), count >> 2))
    return np.concatenate(keys), np.concatenate(ids), np.concatenate(tags)


#: Bits of an id filter for each id, and most bits, which are broadcast as at most FILTER_MOST / 64 rows of two numbers (8 MB). Beyond it more ids pass than asked for.
FILTER_EACH, FILTER_MOST = 16, 1 << 25


def id_filter(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A bit field of a bounded size in rows of 64 bits, for let_through(). It spares rows an exchange; the join that follows decides."""
    number = ids.count()
    bits = max(64, min(FILTER_MOST, 1 << (FILTER_EACH * number).bit_length()))
    at = f"xxhash64(cast({column} as bigint)) & {bits - 1}L"
    marks = ids.selectExpr(f"shiftright({at}, 6) AS _word", f"shiftleft(1L, cast({at} & 63 as int)) AS _mark")
    return keep(marks.groupBy("_word").agg(F.bit_or("_mark").alias("_marks")), "filter"), bits


def let_through(rows: DataFrame, there: tuple[DataFrame, int], inside: bool = True) -> DataFrame:
    """Rows whose doc_id is in an id filter (all that it was made of, and a few others), or the rest."""
    marks, bits = there
    at = f"xxhash64(cast(doc_id as bigint)) & {bits - 1}L"
    hit = (F.expr(f"shiftright({at}, 6)") == marks["_word"]) & (F.expr(f"shiftleft(1L, cast({at} & 63 as int))").bitwiseAND(marks["_marks"]) != 0)
    return rows.join(F.broadcast(marks), hit, "left_semi" if inside else "left_anti")


def shared_runs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, id) of the keys that two or more ids hold, every id once a run and in ascending order."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    differs = np.maximum.reduceat(ids, begin) != np.minimum.reduceat(ids, begin) if len(begin) else np.empty(0, bool)
    some = differs[run]
    run, ids = run[some], ids[some]
    order = np.lexsort((ids, run))
    run, ids = run[order], ids[order]
    once = np.concatenate([[True], (run[1:] != run[:-1]) | (ids[1:] != ids[:-1])]) if len(run) else np.empty(0, bool)
    return run[once], ids[once]


PAIRS = "bucket int, pairs binary"


def pack_pairs(pairs: np.ndarray, buckets: int) -> pa.Table:
    """Pairs (2, n) as one row for each bucket of their hashes."""
    pairs = pairs.astype(np.int64)
    bucket = (mix(pairs[0].view(U64) * U64(3) + mix(pairs[1].view(U64))) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    both = np.ascontiguousarray(pairs[:, order].T)
    rows = [(b, both[start:end].tobytes()) for b, start, end in runs(bucket[order])]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "pairs": pa.array([r[1] for r in rows], pa.binary())})


def distinct_pairs(packed: DataFrame, first: str, second: str) -> DataFrame:
    """The distinct pairs of packed rows. Parts repeat each other's pairs, so they are merged as arrays before they become rows."""

    @tidy
    def merge(table: pa.Table) -> pa.Table:
        both = np.concatenate([np.frombuffer(p.as_buffer(), np.int64).reshape(-1, 2) for p in table.column("pairs")])
        both = both[np.lexsort((both[:, 0], both[:, 1]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        return pa.table({first: pa.array(both[new, 0]), second: pa.array(both[new, 1])})

    return packed.groupBy("bucket").applyInArrow(merge, f"{first} long, {second} long")

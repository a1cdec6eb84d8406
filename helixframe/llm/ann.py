"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds.

Plan: vectors are gathered into blocks of bounded size and quantised there, once; every block of queries meets every
block of candidates once, in a task of its own. The int8 product of a tile gives each cosine up to a proven error; pairs whose upper
bound reaches the k-th largest lower bound of their query are computed again in double precision, and heaps of k
are merged. The result is exact: recall is 1. A stated query set meets all rows, so the work is
queries x vectors, and what is shuffled is each query block once per candidate block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import array_of

K = 5
#: Rows in a block; a tile of QUERY_ROWS x BLOCK_ROWS products takes 16 MB, and about 100 MB with its bounds.
QUERY_ROWS = 1024
BLOCK_ROWS = 4096
#: Pairs computed again at once.
EXACT_PAIRS = 1 << 15
#: Heaps that a task holds before it passes them on; the final merge keeps k again on either side of its exchange.
HEAPS = 1 << 15


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v, dim) of vectors that take part: no null, no null or non-finite component, not all zero. Floats stay floats, all else becomes double."""
    narrow = vectors.schema[column].dataType.simpleString() == "array<float>"
    v = F.col(column).cast("array<float>" if narrow else "array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v"))


#: A block: its ids, vectors as bytes of floats (4) or doubles (8), and their int8 codes, scales and misses.
PACKED = "ids binary, vectors binary, size int, codes binary, scales binary, misses binary"


def blocks(rows: DataFrame, number: int) -> DataFrame:
    """One row per block and dimension, as PACKED."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        flat = np.asarray(array_of(table.column("v")).flatten())
        dim = table.column("dim")[0].as_py()
        v = np.ascontiguousarray(flat.reshape(-1, dim)[order])
        held = (table.column("id").to_numpy()[order], v, *quantised(v.astype(np.float64)))
        ids, vectors, codes, scales, misses = (pa.array([x.tobytes()], pa.binary()) for x in held)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), "ids": ids, "vectors": vectors, "size": pa.array([v.itemsize], pa.int32()), "codes": codes, "scales": scales, "misses": misses})

    return rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(number)).cast("int")).groupBy("dim", "block").applyInArrow(pack, f"dim int, block int, {PACKED}")


@dataclass
class Block:
    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    scales: np.ndarray
    misses: np.ndarray

    @staticmethod
    def of(ids: pa.Scalar, vectors: pa.Scalar, size: pa.Scalar, codes: pa.Scalar, scales: pa.Scalar, misses: pa.Scalar) -> Block:
        i = np.frombuffer(ids.as_buffer(), np.int64)
        v = np.frombuffer(vectors.as_buffer(), np.float32 if size.as_py() == 4 else np.float64).reshape(len(i), -1).astype(np.float64)
        return Block(i, v, np.frombuffer(codes.as_buffer(), np.int8).reshape(len(i), -1), np.frombuffer(scales.as_buffer()), np.frombuffer(misses.as_buffer()))

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.vectors[rows], self.codes[rows], self.scales[rows], self.misses[rows])


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale and the length of what they miss, of the vectors brought to length 1."""
    top = np.abs(v).max(axis=1, keepdims=True)
    unit = v / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    miss = np.sqrt(((unit - codes * scale) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale[:, 0], miss


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles: sums over 512 components stay below 2^23, so that float32 hardware adds them without rounding."""
    out = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], 512):
        out += (a[:, at : at + 512].astype(np.float32) @ b[:, at : at + 512].T.astype(np.float32)).astype(np.int32)
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal values wherever they stand."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def tile_nearest(queries: Block, found: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tile's k nearest candidates of every query: (query row, candidate id, cosine)."""
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest besides the query itself.
    _, group = np.unique(found.vectors, axis=0, return_inverse=True)
    order = np.lexsort((found.ids, group))
    turn = np.arange(len(order)) - np.searchsorted(group[order], group[order], "left")
    found = found.take(np.sort(order[turn <= k]))
    query_ids, ids, vectors = queries.ids, found.ids, found.vectors
    about = products(queries.codes, found.codes) * (queries.scales[:, None] * found.scales[None, :])
    qm, cm = queries.misses, found.misses
    error = qm[:, None] + (1 + qm[:, None]) * cm[None, :] + 1e-9
    own = query_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, about - error)
    if lower.shape[1] > k:
        least = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k]
    else:
        least = np.full(len(lower), -np.inf)
    q, c = np.nonzero(~own & (about + error >= least[:, None]))
    score = np.concatenate([cosine(queries.vectors[q[i : i + EXACT_PAIRS]], vectors[c[i : i + EXACT_PAIRS]]) for i in range(0, len(q), EXACT_PAIRS)] or [np.empty(0)])
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[first], ids[c[first]], score[first]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k nearest vectors by cosine, nearest first, ties to the smaller id; all of them if fewer.

    A query isn't its own candidate (by id, so no row with that id is). Vectors of another dimension aren't
    candidates. Vectors null, zero or holding null or non-finite components, and rows without an id, take no
    part. Repeated rows count once; an id that holds several vectors asks and is found by each. An empty table gives no rows.
    """
    number, asked = vectors.count(), queries.count()
    n, m = max(1, -(-number // block_rows)), max(1, -(-asked // query_rows))
    rows = blocks(usable(vectors, id_column, column).dropDuplicates(["id", "v"]), n)
    kept = [c.split()[0] for c in PACKED.split(", ")]
    ask = blocks(usable(queries, id_column, column).dropDuplicates(["id", "v"]), m).select("dim", F.col("block").alias("query_block"), *(F.col(c).alias(f"query_{c}") for c in kept))
    tiles = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("shuffle_hash").join(rows, ["dim", "block"]) if n > 1 else ask.join(rows, "dim")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}

        def told() -> pa.RecordBatch:
            rows = [(query, -i, score) for (query, _), heap in heaps.items() for score, i in heap]
            heaps.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for tile in range(batch.num_rows):
                asked, met = (Block.of(*(batch.column(f"{side}{c}")[tile] for c in kept)) for side in ("query_", ""))
                query_ids = asked.ids
                q, found, score = tile_nearest(asked, met, k)
                for row, i, x in zip(q.tolist(), (-found).tolist(), score.tolist(), strict=True):
                    heap = heaps.setdefault((int(query_ids[row]), row), [])
                    if len(heap) < k:
                        heapq.heappush(heap, (x, i))
                    elif (x, i) > heap[0]:
                        heapq.heapreplace(heap, (x, i))
                if len(heaps) > HEAPS:
                    yield told()
        yield told()

    found = tiles.select(*(f"query_{c}" for c in kept), *kept).mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

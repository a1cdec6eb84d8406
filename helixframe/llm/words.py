"""Words of whole texts as numpy arrays, and a compact exchange of 64-bit keys between partitions."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a Python worker; it bounds the size of the temporary arrays.
CHUNK_BYTES = 3 << 20
#: Size of a group after which a worker tidies up.
TRIM_BYTES = 4 << 20
U64 = np.uint64


def tidy(run: Callable) -> Callable:
    """A worker's function that gives free memory back to the system when a task, or a larger group, is done; idle workers would hold it."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give_back:
            give_back(0)

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    @functools.wraps(run)
    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > TRIM_BYTES:
            trim()
        return out

    return task if inspect.isgeneratorfunction(run) else group


def array_of(column) -> pa.Array:
    """One array of a column that may be chunked."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of characters other than space and tab to carriage return: (code of each word, offsets by text, words by code)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.values.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary
    blank = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False)) if len(words) else []
    if len(blank):
        keep = codes != blank[0]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends, words


def hash_words(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for every k consecutive words of one sequence."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, 0x9E3779B97F4A7C15, U64)
    for j in range(k):
        out ^= hashes[j : j + n]
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return out


def gram_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts laid end to end: the places where k words of one text stand, and the text of each."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(text)) - np.repeat(first, counts) + np.repeat(offsets[:-1], counts), text


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one span after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)

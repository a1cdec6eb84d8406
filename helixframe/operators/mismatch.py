"""Counts of the mismatch kernel by Arrow passes: windows are counted within rows, brought together by sequence, and expanded there.

A k-mer is a number in base |A|, its first letter the highest digit. What is exchanged is a list of (code, n) for each
sequence, never a neighbourhood: a sequence's features are made where it ends up, and none is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.alphabets import LOWER, UPPER
from ..functions.kernels import MismatchSpec
from ..sources.shipping import ship

#: Bytes of text looked at at once, and states expanded at once; neither changes a result.
PIECE = 1 << 20
STATES = 1 << 18


def tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many there are of each, or the sums of their n (positive)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    low = keys.min()
    if keys.max() - low < 4 * len(keys):
        sums = np.bincount(keys - low, n)
        at = np.flatnonzero(sums)
        return at + low, sums[at].astype(np.int64)
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(n[order], starts)


def numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each row the place of its id among the distinct ones, a null being one as well; and those."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def window_counts(text: pa.Array, turn: np.ndarray, spec: MismatchSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(turn x |A|^k + code, n) of the valid windows, piece by piece of the texts; a row's pieces may repeat a key."""
    letters, k = spec.letters.letters, spec.k
    digits = np.full(256, 255, np.uint8)
    digits[list(letters.encode())] = np.arange(len(letters))
    if not spec.ignore_lower:
        digits[list(LOWER.encode())] = digits[list(UPPER.encode())]
    text = text.fill_null("").cast(pa.large_binary())
    _, ends, data = text.buffers()
    if data is None or not len(text):
        return
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8)
    for start in range(ends[0], ends[-1] - k + 1, PIECE):
        # Bytes of other characters are no letters, so windows of bytes are windows of characters.
        digit = digits[data[start : min(start + PIECE + k - 1, ends[-1])]]
        width = len(digit) - k + 1
        code, valid = np.zeros(width, np.int64), np.ones(width, bool)
        for j in range(k):
            d = digit[j : j + width]
            code = code * len(letters) + d
            valid &= d != 255
        inner = ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, start + width + k - 1, "left")] - start
        for j in range(1, k):
            over = inner - j
            valid[over[(over >= 0) & (over < width)]] = False
        owner = np.repeat(turn, np.diff(np.clip(ends, start, start + width)))
        yield tally(owner[valid] * len(letters) ** k + code[valid])


def expanded(at: np.ndarray, n: np.ndarray, spec: MismatchSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(turn x |A|^k + code, n) of features, each once, from (turn x |A|^k + code) x (m + 1) of windows, in order.

    Letter by letter, like a walk of the windows down the tree of features: a state is a window whose first letters are
    exchanged for the feature's, and the number of mismatches so far; equal states are added up. States that differ in
    the sequence or the letters done never meet again, so a large set is cut there, and memory is bounded.
    """
    size, k, errors = len(spec.letters.letters), spec.k, spec.m + 1
    stack = [(0, at, n)]
    while stack:
        i, at, n = stack.pop()
        if i == k:
            yield at, n
            continue
        apart = size ** (k - i) * errors
        if len(at) * size > STATES and at[0] // apart != at[-1] // apart:
            own = at[len(at) // 2] // apart * apart
            cut = np.searchsorted(at, own) or np.searchsorted(at, own + apart)
            stack += [(i, at[cut:], n[cut:]), (i, at[:cut], n[:cut])]
            continue
        weight = size ** (k - 1 - i)
        open_ = at % errors < spec.m
        more, digit = at[open_], at[open_] // (errors * weight) % size
        keys = [at, *(more + ((digit + shift) % size - digit) * (weight * errors) + 1 for shift in range(1, size))]
        keys = np.concatenate(keys)
        stack.append((i + 1, *tally(keys // errors if i == k - 1 else keys, np.concatenate([n, *[n[open_]] * (size - 1)]))))


def spelled(code: np.ndarray, spec: MismatchSpec) -> pa.Array:
    """Codes as k-mers."""
    letters, k = np.frombuffer(spec.letters.letters.encode(), np.uint8), spec.k
    text = np.empty((len(code), k), np.uint8)
    for j in range(k):
        text[:, j] = letters[code // len(letters) ** (k - 1 - j) % len(letters)]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(0, len(code) * k + 1, k, dtype=np.int32)), pa.py_buffer(text))


def counting(spec: MismatchSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seq_id, seq) to (seq_id, codes, ns), one or several rows a sequence."""
    universe = len(spec.letters.letters) ** spec.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, ids = numbered(batch.column(0))
            for at, n in window_counts(batch.column(1), turn, spec):
                if len(at):
                    own = at // universe
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    ends = pa.array(np.r_[starts, len(at)].astype(np.int32))
                    codes, ns = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at % universe, n))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[starts])), codes, ns], ["seq_id", "codes", "ns"])

    return run


def expanding(spec: MismatchSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(seq_id, codes, ns) in order of seq_id to (seq_id, feature, n); the last sequence of a batch waits for its other rows."""
    universe, errors = len(spec.letters.letters) ** spec.k, spec.m + 1

    def rows(ids: pa.Array, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for keys, sums in expanded(at, n, spec) if len(at) else ():
            for j in range(0, len(keys), STATES):
                part = keys[j : j + STATES]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(part // universe)), spelled(part % universe, spec), pa.array(sums[j : j + STATES])], ["seq_id", "feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            turn, found = numbered(batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)]))
            own = np.repeat(turn[-len(batch) :], batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            codes, ns = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            # What waited has the first turn, 0, as it had before.
            at, n = tally(np.r_[at, (own * universe + codes) * errors], np.r_[n, ns])
            last = turn[-1]
            cut = np.searchsorted(at, last * universe * errors)
            yield from rows(found, at[:cut], n[:cut])
            ids, at, n = found[last : last + 1], at[cut:] - last * universe * errors, n[cut:]
        if ids is not None:
            yield from rows(ids, at, n)

    return run


def mismatch_counts(seqs: DataFrame, spec: MismatchSpec) -> DataFrame:
    """(seq_id, feature, n): for every k-mer the windows at a Hamming distance of at most m, over all rows of a sequence."""
    ship(seqs.sparkSession)
    rows, key = seqs.select("seq_id", "seq"), StructField("seq_id", seqs.schema["seq_id"].dataType)
    lists = [StructField(c, ArrayType(IntegerType())) for c in ("codes", "ns")]
    packed = rows.mapInArrow(counting(spec), StructType([key, *lists]))
    return packed.repartition("seq_id").sortWithinPartitions("seq_id").mapInArrow(expanding(spec), StructType([key, StructField("feature", StringType()), StructField("n", LongType())]))

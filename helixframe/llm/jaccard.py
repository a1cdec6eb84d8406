"""Jaccard join of documents on word shingles by universe partition and pigeonhole, and its connected groups.

Two sets with a similarity of at least t differ in at most (1 - t) / (1 + t) of their sizes' sum, H elements. The
universe of shingles is hashed into segments, more of them than H for each band of sizes. If a set gives its
segments allowances that sum to H + 1, then in some segment the two differ by less than its allowance: allowance 1
asks for an equal subset there, 2 for one that is equal or differs by one element. Smaller sets index their
subsets (and, in some segments, their one-deletion neighbourhoods); larger ones probe where that is cheapest.

Plan: (1) one pass gives every document's set size, set hash and a parity sketch. Equal sets are one node, named by
the set's hash, so copies meet as one wherever they stand. (2) A second pass sends the nodes' signatures in packed
blocks (about 0.7 a shingle, 8 bytes each); small buckets give all their pairs. (3) The sketches give an exact bound
that drops nearly all false candidates; the sets of the others are made from their texts, dealt into groups around
one node, each set once a group, and compared whole. (4) Components are found. Larger buckets meet in blocks of
bounded size: each node first gives only its nearest plausible partner in another component, as long as that links
many, then all plausible pairs between components are left to compare. No link between different sets is lost, and a
group of near copies doesn't bring the square of its size.

Shingles and sets are told apart by 64-bit hashes. Two different sets share a node's name with a chance of n * n /
2^65 for n sets; one wrong shingle match moves an intersection by one, and needs two equal hashes within one pair
(about 1e-13 for two sets of a thousand).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .components import components
from .exchange import Packer, distinct_pairs, id_filter, let_through, pack_pairs, parts_for, unpack
from .storage import keep, release
from .words import U64, array_of, chunks, gram_starts, grams, hash_words, mix, spans, split_words, tidy

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 75
#: Segments for each element of a band's smallest set, and some more for small sets.
SEGMENT_SHARE, SEGMENT_MORE = 0.45, 3
#: Up to this size every segment has a one-deletion neighbourhood, beyond it this part of them.
SMALL, DELETION_SHARE = 64, 0.04
#: Expected false candidates of a subset of one element; every further element halves them.
COLLISION_COST = 8.0
#: Keys over which a band's documents are spread for the rare document whose segments can't give H + 1.
SPREAD = 64
#: Nodes in a bucket up to which all its pairs are compared at once.
BUCKET = 4
#: Nodes in a block of a larger bucket, of which pairs between components are made.
BLOCK = 1000
#: Another round of nearest partners follows one that found links for at least this part of all nodes.
NEAREST_SHARE = 0.01
#: Members of larger buckets in a group that compares their sketches.
GROUP_MEMBERS = 20_000
#: Elements of the sets that one group compares with its hub, on average.
GROUP_ELEMENTS = 500_000
#: Bits of a parity sketch: least, for each element, and most. Beyond it the sketch only lets more pairs through.
SKETCH_LEAST, SKETCH_EACH, SKETCH_MOST = 64, 2, 1 << 17
INDEX, PROBE = 1, 2
FACTS = "doc_id long, n_shingles long, node long, sketch binary"


def bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Smallest set size of every band. A set's partners that aren't smaller are in its band or the next."""
    out = [1]
    while out[-1] <= largest:
        out.append(-(-out[-1] * 100 // percent))
        out[-1] = max(out[-1], out[-2] + 1)
    return np.array(out, np.int64)


def differ_most(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Largest symmetric difference of two similar sets, by the sum of their sizes."""
    return (100 - percent) * sizes // (100 + percent)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets). A text of fewer than k words has one shingle, of all its words."""
    codes, ends, words = split_words(pc.ascii_lower(texts))
    hashes = hash_words(words)[codes]
    counts = np.diff(ends)
    starts, text = gram_starts(ends, k)
    values = grams(hashes, k)[starts]
    short = [np.flatnonzero(counts == n) for n in range(1, k)]
    if any(map(len, short)):
        values = np.concatenate([values, *(mix(grams(hashes, n)[ends[rows]] + U64(n)) for n, rows in enumerate(short, 1) if len(rows))])
        text = np.concatenate([text, *(rows for rows in short if len(rows))])
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of runs that may be empty."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sketches(hashes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Of each set the parity of its elements, by their hashes' low bits. Two sketches differ in at most as many bits as the sets in elements; halves laid over each other give the sketch of half the bits."""
    sizes = np.diff(ends)
    bits = np.minimum(SKETCH_MOST, 1 << np.ceil(np.log2(np.maximum(SKETCH_EACH * sizes, SKETCH_LEAST))).astype(np.int64))
    out = [b""] * len(sizes)
    for m in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == m)
        step = max(1, (1 << 23) // m)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            place = np.repeat(np.arange(len(some)), sizes[some]) * m + (hashes[spans(ends[some], sizes[some])] & U64(m - 1)).astype(np.int64)
            odd = np.packbits((np.bincount(place, minlength=len(some) * m) & 1).astype(np.uint8).reshape(len(some), m), axis=1, bitorder="little")
            for row, sketch in zip(some.tolist(), odd, strict=True):
                out[row] = sketch.tobytes()
    return out


def halved(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought to `width` words."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def by_width(column: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their sketches as a matrix) for every width."""
    lengths = np.fromiter(map(len, column), np.int64, len(column))
    return [(rows, np.frombuffer(b"".join(column[i] for i in rows.tolist()), U64).reshape(len(rows), -1)) for n in np.unique(lengths).tolist() for rows in [np.flatnonzero(lengths == n)]]


def near_enough(x: list[bytes], y: list[bytes], most: np.ndarray) -> np.ndarray:
    """Row by row, whether two sketches differ in no more than `most` bits."""
    out = np.zeros(len(x), bool)
    place = np.empty(len(x), np.int64)
    widths = by_width(y)
    which = np.empty(len(x), np.int64)
    for w, (rows, _) in enumerate(widths):
        place[rows], which[rows] = np.arange(len(rows)), w
    for rows, a in by_width(x):
        for w, (_, b) in enumerate(widths):
            mine = np.flatnonzero(which[rows] == w)
            if len(mine):
                width = min(a.shape[1], b.shape[1])
                differ = halved(a[mine], width) ^ halved(b[place[rows[mine]]], width)
                out[rows[mine]] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most[rows[mine]]
    return out


def facts(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) of every row; node: the set's hash."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, ends = shingle_sets(array_of(part.column("text")), k)
                mixed = mix(values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(nodes(mixed, ends)), pa.array(sketches(mixed, ends), pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FACTS)


def nodes(mixed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set, of its mixed elements."""
    return mix(sums(mixed, ends) ^ mix(np.diff(ends).astype(U64))).view(np.int64)


class Segmentation:
    """Runs of one segment each, of sets that are cut into `number` segments: hashes in order stand by segment already."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, band: np.ndarray, number: np.ndarray):
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.mixed = mix(values)
        segment = (((values >> U64(32)) * number.astype(U64)[self.doc]) >> U64(32)).astype(np.int64)
        new = np.ones(len(values), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.run_doc, self.segment = self.doc[self.first], segment[self.first]
        self.size = np.diff(np.append(self.first, len(values)))
        self.sum = np.add.reduceat(self.mixed, self.first) if len(values) else np.empty(0, U64)
        self.salt = mix((band[self.run_doc] * (1 << 32) + self.segment).astype(U64) + U64(0x2545F4914F6CDD1D))

    def whole(self, runs: np.ndarray) -> np.ndarray:
        return mix(self.sum[runs] + self.salt[runs])

    def without_one(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the runs with each element left out in turn, and the documents; as they'd be for whole runs."""
        some = np.zeros(len(self.first), bool)
        some[runs] = True
        at = np.flatnonzero(some[self.run])
        run = self.run[at]
        return mix(self.sum[run] - self.mixed[at] + self.salt[run]), self.doc[at]

    def allot(self, need: np.ndarray, deletions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cheapest allowances that sum to `need` for each document: runs with 1 or more, runs with 2, documents left short.

        An allowance costs the signatures it sends and the false candidates expected of subsets that small.
        """
        rare = COLLISION_COST * 0.5 ** np.minimum(self.size, 40)
        second = np.flatnonzero((self.size > 1) & (self.segment < deletions[self.run_doc]))
        cost = np.concatenate([1 + rare, 1 + self.size[second] + 2 * rare[second]])
        run = np.concatenate([np.arange(len(self.size)), second])
        twice = np.arange(len(run)) >= len(self.size)
        doc = self.run_doc[run]
        order = np.lexsort((self.segment[run], cost, doc))
        counts = np.bincount(doc, minlength=len(need))
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order)) - (np.cumsum(counts) - counts)[doc[order]]
        chosen = turn < need[doc]
        return run[chosen & ~twice], run[chosen & twice], np.flatnonzero(counts < need)


DELETED = U64(0x632BE59BD9B4E019)


def signatures(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ids, tags) of sets that aren't empty: to be found in their band, and to find there and in the band below."""
    sizes = np.diff(offsets)
    low = bands(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(low, sizes, "right") - 1
    number = np.ceil(SEGMENT_SHARE * low).astype(np.int64) + SEGMENT_MORE
    deletions = np.where(low <= SMALL, number, np.ceil(DELETION_SHARE * number).astype(np.int64))
    tag = lambda keys, value: np.full(len(keys), value, np.int8)
    everyone = lambda band, at: mix((band * SPREAD + at).astype(U64) ^ U64(0xA0761D6478BD642F))

    def probes(cut: Segmentation, need: np.ndarray, band: np.ndarray, who: np.ndarray, skip_first: bool):
        once, twice, short = cut.allot(need, deletions[band])
        if not skip_first:
            yield cut.whole(once), who[cut.run_doc[once]], tag(once, PROBE)
        if len(twice):
            yield mix(cut.whole(twice) ^ DELETED), who[cut.run_doc[twice]], tag(twice, PROBE)
            keys, doc = cut.without_one(twice)
            yield keys, who[doc], tag(keys, PROBE)
        if len(short):
            keys = everyone(np.repeat(band[short], SPREAD), np.tile(np.arange(SPREAD), len(short)))
            yield keys, np.repeat(who[short], SPREAD), tag(keys, PROBE)

    cut = Segmentation(values, sizes, own, number[own])
    need = differ_most(2 * sizes, percent) + 1
    tags = np.full(len(cut.first), INDEX, np.int8)
    tags[cut.allot(need, deletions[own])[0]] |= PROBE
    yield cut.whole(np.arange(len(cut.first))), ids[cut.run_doc], tags
    near = np.flatnonzero((cut.size > 1) & (cut.segment < deletions[own][cut.run_doc]))
    keys, doc = cut.without_one(near)
    yield mix(keys ^ DELETED), ids[doc], tag(keys, INDEX)
    yield everyone(own, (mix(ids.view(U64)) % U64(SPREAD)).astype(np.int64)), ids, tag(ids, INDEX)
    yield from probes(cut, need, own, ids, True)

    below = np.flatnonzero((own > 0) & (sizes * percent <= (low[own] - 1) * 100))
    if len(below):
        some = np.repeat(np.isin(np.arange(len(sizes)), below), sizes)
        band = own[below] - 1
        cut = Segmentation(values[some], sizes[below], band, number[band])
        yield from probes(cut, differ_most(low[own[below]] - 1 + sizes[below], percent) + 1, band, ids[below], False)


def distinct(pairs: np.ndarray) -> np.ndarray:
    """Distinct columns of (2, n) pairs."""
    pairs = pairs[:, np.lexsort((pairs[0], pairs[1]))]
    once = np.ones(pairs.shape[1], bool)
    once[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, once]


def may_meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether of two tags one asks where the other is to be found."""
    return ((x & PROBE > 0) & (y & INDEX > 0)) | ((x & INDEX > 0) & (y & PROBE > 0))


def bucket_pairs(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: all pairs (2, n) of small buckets, and the larger buckets' members (key, id) and tags."""
    order = np.lexsort((ids, keys))
    keys, ids, tags = keys[order], ids[order], tags[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    first = np.flatnonzero(new)
    tags = np.bitwise_or.reduceat(tags, first) if len(first) else tags
    keys, ids = keys[first], ids[first]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    pairs: list[np.ndarray] = [np.empty((2, 0), np.int64)]
    for n in np.unique(size[(size > 1) & (size <= BUCKET)]).tolist():
        at = begin[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                meet = may_meet(tags[at + i], tags[at + j])
                pairs.append(np.stack([ids[at[meet] + i], ids[at[meet] + j]]))
    held = np.repeat(size > BUCKET, size)
    if held.any():
        # A bucket nobody probes has no pairs.
        run = np.repeat(np.arange(len(begin)), size)
        probed, found = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        np.logical_or.at(probed, run, tags & PROBE > 0)
        np.logical_or.at(found, run, tags & INDEX > 0)
        held &= (probed & found)[run]
    return distinct(np.concatenate(pairs, axis=1)), np.stack([keys[held].view(np.int64), ids[held]]), tags[held]


def candidates(docs: DataFrame, shingles: int, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(bucket, pairs, key, id, tag): rows of packed pairs to compare, and larger buckets' members, whose key isn't null."""
    parts = parts_for(shingles * 7 // 10)

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(parts), set()
        for batch in batches:
            for part in chunks(batch):
                values, ends = shingle_sets(array_of(part.column("text")), k)
                sizes, ids = np.diff(ends), nodes(mix(values), ends)
                take = np.zeros(len(ids), bool)
                for row, (node, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):  # equal sets of a task are sent once
                    if n and node not in seen:
                        seen.add(node)
                        take[row] = True
                ids, values, sizes = ids[take], values[np.repeat(take, sizes)], sizes[take]
                for rows in signatures(ids, values, np.concatenate([[0], np.cumsum(sizes)]), percent):
                    yield from packer.add(*rows)
        yield packer.flush()

    @tidy
    def find(table: pa.Table) -> pa.Table:
        pairs, members, tags = bucket_pairs(*unpack(table))
        packed = pack_pairs(pairs, parts)
        n, m = packed.num_rows, members.shape[1]
        columns = {"key": (pa.array(members[0]), pa.int64()), "id": (pa.array(members[1]), pa.int64()), "tag": (pa.array(tags, pa.int32()), pa.int32())}
        out = {c: pa.chunked_array([*packed.column(c).chunks, pa.nulls(m, packed.schema.field(c).type)]) for c in packed.schema.names}
        return pa.table(out | {c: pa.chunked_array([pa.nulls(n, t), x]) for c, (x, t) in columns.items()})

    packed = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(emit, exchange.SCHEMA)
    return packed.groupBy("part").applyInArrow(find, f"{exchange.PAIRS}, key long, id long, tag int")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, n): the pairs whose sizes and sketches don't rule the similarity out; n is the size of b's set."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            good = pa.array(near_enough(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), differ_most(total, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b", "n_b")], ["a", "b", "n"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}")
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, n long").distinct()


def crossing_pairs(placed: DataFrame, classes: DataFrame, nearest: bool, percent: int = PERCENT) -> DataFrame:
    """(a, b, n): pairs of one bucket's nodes in different components that sizes and sketches don't rule out; nearest: of these only each node's pair with the nearest sketch.

    placed: (bucket, node, tag, component, members). A bucket is cut into blocks; each two blocks meet in a group of
    their own, so that no task holds more than two blocks of a bucket. Buckets of one block share groups.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    groups = max(1, placed.count() // GROUP_MEMBERS)
    sided = placed.join(classes.select("node", "n", "sketch"), "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    kept = ["bucket", "node", "tag", "component", "n", "sketch", "block"]
    sided = sided.select(*kept, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), (blocks == 1).alias("alone"))
    sided = sided.select(*kept, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "alone")
    group = F.when(F.col("alone"), F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.xxhash64("bucket", "low", "high"))

    @tidy
    def meet(table: pa.Table) -> pa.Table:
        bucket, node, component, n, tag, block, low, high = (table.column(c).to_numpy() for c in ("bucket", "node", "component", "n", "tag", "block", "low", "high"))
        widths = by_width(table.column("sketch").to_pylist())
        which, place = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        for w, (rows, _) in enumerate(widths):
            which[rows], place[rows] = w, np.arange(len(rows))
        order = np.lexsort((node, high, low, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(bucket[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        out = []
        for rows in np.split(order, np.flatnonzero(new)[1:]):
            if (component[rows] == component[rows[0]]).all():
                continue
            left, right = rows[block[rows] == low[rows]], rows[block[rows] == high[rows]]
            found = []
            for v in np.unique(which[left]).tolist():
                for w in np.unique(which[right]).tolist():
                    x, y = left[which[left] == v], right[which[right] == w]
                    width = min(widths[v][1].shape[1], widths[w][1].shape[1])
                    a, b = halved(widths[v][1][place[x]], width), halved(widths[w][1][place[y]], width)
                    step = max(1, (1 << 20) // b.size)
                    for at in range(0, len(x), step):
                        some = x[at : at + step, None]
                        good = (component[some] != component[y]) & may_meet(tag[some], tag[y]) & (np.minimum(n[some], n[y]) * 100 >= percent * np.maximum(n[some], n[y]))
                        if low[rows[0]] == high[rows[0]]:
                            good &= node[some] < node[y]
                        if good.any():
                            differ, total = np.bitwise_count(a[at : at + step, None] ^ b).sum(axis=2, dtype=np.int64), n[some] + n[y]
                            i, j = np.nonzero(good & (differ <= differ_most(total, percent)))
                            found.append(np.stack([some[i, 0], y[j], differ[i, j] * 1_000_000 // total[i, j]]))
            if not found:
                continue
            pairs = np.concatenate(found, axis=1)
            if nearest:
                row, pair = np.concatenate([pairs[0], pairs[1]]), np.tile(np.arange(pairs.shape[1]), 2)
                by = np.lexsort((pair, pairs[2][pair], row))
                once = np.ones(len(by), bool)
                once[1:] = row[by][1:] != row[by][:-1]
                pairs = pairs[:, np.unique(pair[by[once]])]
            out.append(pairs[:2])
        i, j = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        a, b = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        return pa.table({"a": node[a], "b": node[b], "n": n[b]})

    return sided.withColumn("group", group).drop("alone").groupBy("group").applyInArrow(meet, "a long, b long, n long").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, elements): the shingle sets of the documents with the wanted ids, and of a few others; texts aren't exchanged."""
    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in chunks(batch):
                values, ends = shingle_sets(array_of(part.column("text")), k)
                names, raw = nodes(mix(values), ends), memoryview(values).cast("B")
                new = {x: i for i, x in enumerate(names.tolist()) if x not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([bytes(raw[8 * ends[i] : 8 * ends[i + 1]]) for i in new.values()], pa.binary())], ["node", "elements"])

    texts = let_through(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), id_filter(wanted, "doc")).select("text")
    return texts.mapInArrow(sets, "node long, elements binary").groupBy("node").agg(F.first("elements").alias("elements"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(u, v): the pairs (a, b, n) whose whole sets are similar enough.

    Pairs of one a are dealt into groups of about GROUP_ELEMENTS elements; a group gets the set of a and those of its b once.
    """

    @tidy
    def check(table: pa.Table) -> pa.Table:
        hub, node = table.column("a")[0].as_py(), table.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("elements")]
        own = next((sets[i] for i in np.flatnonzero(node == hub).tolist()), None)
        out = []
        for i in np.flatnonzero(node != hub).tolist() if own is not None else ():
            both = np.concatenate([own, sets[i]])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if shared and 100 * shared >= percent * (len(both) - shared):
                out.append(int(node[i]))
        return pa.table({"u": pa.array([hub] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})

    groups = F.ceil(F.col("elements") / GROUP_ELEMENTS)
    dealt = keep(pairs.join(pairs.groupBy("a").agg(F.sum("n").alias("elements")), "a").select("a", F.pmod(F.xxhash64("b"), groups).alias("turn"), "b"), "dealt")
    seats = dealt.select("a", "turn", F.col("b").alias("node")).unionByName(dealt.select("a", "turn", F.col("a").alias("node")).distinct())
    wanted = seats.select("node").distinct().join(classes.select("node", "doc"), "node")
    return seats.join(whole_sets(docs, wanted, k), "node").groupBy("a", "turn").applyInArrow(check, "u long, v long")


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest id reachable by links.

    A text without words has an empty set and no links. Rows that share an id are one document whose links are those
    of any of its texts; a row without an id takes no part and has no component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    release(spark)
    rows = keep(facts(docs, k), "facts")
    used = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = keep(used.groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    shingles = used.agg(F.sum("n_shingles")).first()[0] or 0
    met = keep(candidates(docs, shingles, k, percent), "candidates")
    release(spark)
    several = used.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("x")).where("v < x")
    links = used.join(several, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    first = distinct_pairs(met.where("key IS NULL").select("bucket", "pairs"), "a", "b")
    tried = keep(plausible(first, classes, percent), "plausible")
    members = met.where("key IS NOT NULL").select(F.col("key").alias("bucket"), F.col("id").alias("node"), "tag")
    groups = components(keep(links.unionByName(verified(tried, docs, classes, k, percent)), "links"))
    tried = tried.select("a", "b")
    release(spark)
    number, again, nearest = classes.count(), not members.isEmpty(), True
    while again:
        placed = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x <> y").select("bucket", "members")
        placed = keep(placed.join(mixed, "bucket"), "mixed")
        more = keep(crossing_pairs(placed, classes, nearest, percent).join(tried, ["a", "b"], "left_anti"), "crossing")
        found = 0
        if not more.isEmpty():
            links = keep(verified(more, docs, classes, k, percent), "links")
            groups = components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
            tried, found = tried.unionByName(more.select("a", "b")), links.count()
        again, nearest = nearest, nearest and found >= NEAREST_SHARE * number
        del placed, mixed, more
        release(spark)
    # A component's id is its smallest document's; only documents that have a smaller one are named.
    rooted = classes.select("node", "doc").join(groups, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component")), "root").select("node", "component")
    later = used.select("doc_id", "node").join(named, "node").where("component < doc_id").select(F.col("doc_id").alias("id"), "component").distinct()
    return rows.join(later, rows["doc_id"] == later["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents less those linked, also over others, with one of a smaller id. Rows without an id, and rows that share the id that stays, all stay."""
    later = keep(near_groups(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct(), "later")
    release(docs.sparkSession)
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)

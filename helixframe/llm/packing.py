"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Plan: one Arrow pass tokenises and cuts (no shuffle of texts or ids); the pieces, 48 bytes each, are dealt by a
hash into blocks of about `block_pieces`, and every block is packed on its own. A block holds thousands of
sequences, so that what its last sequences waste is far below a thousandth, and its memory is bounded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import array_of, chunks, spans, split_words, tidy

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
BLOCK_PIECES = 16_384
#: Steps of each of the two searches in a block after which its best packing so far stands.
NODE_LIMIT = 4_000
#: Words a worker remembers with their ids.
CACHE_WORDS = 600_000
#: Letters or digits, then marks: the vocabulary's splitting rule always parts the two.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ0-9]+)(?P<tail>[.,!?;:*#$%&]*)$"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of texts from the ids of their words: this vocabulary never joins over white space, so equal words share one look-up."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name)).encode_batch
        self.known: dict[str, bytes] = {}

    def look_up(self, words: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, e in zip(part, self.encode(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, np.uint32).tobytes()
        return [known[w] for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        codes, ends, words = split_words(texts)
        parts = pc.extract_regex(words, PLAIN)
        core = pc.ascii_lower(pc.coalesce(pc.struct_field(parts, "core"), ""))
        tail = pc.coalesce(pc.struct_field(parts, "tail"), "")
        core = pc.if_else(pc.equal(core, ""), words, core)
        a, b = core.dictionary_encode(), tail.dictionary_encode()
        heads, marks = self.look_up(a.dictionary.to_pylist()), self.look_up(b.dictionary.to_pylist())
        ids = [heads[i] + marks[j] for i, j in zip(a.indices.to_pylist(), b.indices.to_pylist(), strict=True)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        each = lengths[codes]
        bounds = np.concatenate([[0], np.cumsum(each)])[ends]
        return table[spans((np.cumsum(lengths) - lengths)[codes], each)], bounds


@lru_cache(2)
def tokenizer(name: str) -> WordTokenizer:
    return WordTokenizer(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (and the closing id 0) into pieces of at most `capacity`; with_ids adds them as `input_ids`."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name)
        for batch in batches:
            for part in chunks(batch):
                ids, bounds = encode(array_of(part.column("text")))
                lengths = np.diff(bounds) + 1
                count = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                size = np.minimum(lengths[row] - piece * capacity, capacity)
                end = np.uint32(END).tobytes()
                data, raw = [], memoryview(ids).cast("B")
                for at, n, last in zip((bounds[row] + piece * capacity).tolist(), size.tolist(), (piece == count[row] - 1).tolist(), strict=True):
                    data.append(bytes(raw[4 * at : 4 * (at + n - 1)]) + end if last else raw[4 * at : 4 * (at + n)])
                out = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(size, pa.int64()), pa.array(map(zlib.crc32, data), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = np.frombuffer(b"".join(data), np.uint32).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", input_ids array<int>" if with_ids else ""))


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: the plain volume, or for some threshold t the large items' bins and what of the middle ones can't join them."""
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle_high = number[capacity - t] - number[capacity // 2]
    middle_low = volume[capacity // 2] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    room = middle_high * capacity - (volume[capacity - t] - volume[capacity // 2])
    return int(np.max(large + middle_high + np.maximum(0, -(-(middle_low - room) // capacity))))


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every item goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    for size in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[size])):
            step = int(open_rooms[size:].argmax()) + size if size <= capacity else size
            if step <= capacity and open_rooms[step]:
                at = rooms[step].pop()
                open_rooms[step] = bool(rooms[step])
            else:
                at, step = len(bins), capacity
                bins.append([])
            bins[at].append(size)
            if step - size:
                rooms[step - size].append(at)
                open_rooms[step - size] = True
    return bins


def fillings(counts: np.ndarray, room: int, most: int) -> list[tuple[int, ...]]:
    """A few good fillings of a room, fullest first, for the quick search: first items with the largest second one that fits, and what room remains is filled by the largest items that fit."""
    there = np.flatnonzero(counts[: room + 1])
    there = there[there > 0]
    if not len(there):
        return [()]
    down = np.zeros(room + 1, np.int64)
    down[there] = there
    down = np.maximum.accumulate(down)
    first = there[::-1]
    limit = np.minimum(room - first, np.where(counts[first] > 1, first, first - 1))
    second = down[limit]
    total = first + second
    order = np.argsort(-total, kind="stable")
    found: dict[tuple[int, ...], int] = {}
    floor = int(first[0])
    for i in order[: 4 * most].tolist():
        if total[i] < floor:
            break
        items, left = [int(first[i])], int(room - total[i])
        if second[i]:
            items.append(int(second[i]))
        used = {}
        for x in items:
            used[x] = used.get(x, 0) + 1
        while left > 0:
            x = int(down[min(left, items[-1])])
            while x and counts[x] - used.get(x, 0) <= 0:
                x = int(down[x - 1])
            if not x:
                break
            items.append(x)
            used[x] = used.get(x, 0) + 1
            left -= x
        found[tuple(items)] = left
        if len(found) >= most:
            break
    return sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))


def dominated(filling: list[tuple[int, int]], left: int, there: int, counts: list[int]) -> bool:
    """Whether an item that stays out could take the place of some of a filling's (or of the room left) and be larger, or as large as several: then another filling is as good.

    Sets of sizes are bits of numbers; there has the sizes that come at all.
    """
    sums, several = 1, 0
    for size, times in filling:
        if counts[size] == times:
            there &= ~(1 << size)
        for _ in range(times):
            several |= several << size | (sums & ~1) << size
            sums |= sums << size
    width, reach = 1, sums << 1
    while width < left:
        step = min(width, left - width)
        reach |= reach << step
        width += step
    return bool(there & (several | reach if left else several))


def completions(counts: np.ndarray, room: int, spare: int) -> Iterator[tuple[int, ...] | bool]:
    """All undominated fillings of a room that leave no more than spare of it, large items first; False for every step without one."""
    sizes = np.arange(room + 1)
    volume = np.cumsum(counts[: room + 1] * sizes).tolist()
    down = np.maximum.accumulate(np.where(counts[: room + 1] > 0, sizes, 0)).tolist()
    number = counts[: room + 1].tolist()
    there = sum(1 << x for x in range(1, room + 1) if number[x])

    def extend(filling: list[tuple[int, int]], left: int, below: int) -> Iterator[tuple[int, ...] | bool]:
        x = down[min(left, below)]
        if not x:
            good = left <= spare and not dominated(filling, left, there, number)
            yield tuple(size for size, times in filling for _ in range(times)) if good else False
        while x:
            if left - volume[x] > spare:
                yield False
                return
            for times in range(min(number[x], left // x), 0, -1):
                yield from extend([*filling, (x, times)], left - x * times, x - 1)
            x = down[x - 1]

    return extend([], room, room)


def search(counts: np.ndarray, bins: list[list[int]], bound: int, capacity: int, limit: int, branch: int | None) -> list[list[int]]:
    """The best packing found from the incumbent `bins` on, within `limit` steps. branch: how many fillings are tried at a node; None: all, and bins are equal as often as any packing may have it, so that a search which ends before its limit proves its result."""
    left, path, nodes = counts.copy(), [], 0
    volume = int(counts @ np.arange(capacity + 1))
    allowed = (len(bins) - 1) * capacity - volume
    waste, options, again, closed = 0, None, None, frozenset()
    top = capacity
    while nodes < limit:
        while top and not left[top]:
            top -= 1
        if not top and options is None:
            bins = [[s, *f] for s, f, m, *_ in path for _ in range(m)]
            allowed = (len(bins) - 1) * capacity - volume
            if len(bins) <= bound:
                break
            options = iter(())
        elif options is None:
            nodes += 1
            left[top] -= 1
            options = iter(fillings(left, capacity - top, branch)) if branch else completions(left.copy(), capacity - top, allowed - waste)
            left[top] += 1
            # Fillings closed around this size are done: how often they come is already chosen.
            closed = path[-1][5] | {path[-1][1]} if not branch and path and path[-1][0] == top else frozenset()
        step, most = again or (next(options, None), None)
        again = None
        if step is False:
            nodes += 1
            continue
        if step is not None:
            if most is None and step in closed:
                continue
            use = np.bincount([top, *step], minlength=capacity + 1)
            each = np.flatnonzero(use)
            times = most or int((left[each] // use[each]).min())
            each_lost = capacity - top - sum(step)
            if waste + times * each_lost > allowed:
                times = max(0, allowed - waste) // each_lost if each_lost and waste <= allowed else 0
            lost = times * each_lost
            if times > 0:
                left[each] -= use[each] * times
                path.append((top, step, times, options, lost, closed))
                waste, options = waste + lost, None
            continue
        if not path:
            break
        top, step, times, options, lost, closed = path.pop()
        nodes += 1
        waste -= lost
        for x in (top, *step):
            left[x] += times
        if not branch and times > 1:
            again = (step, times - 1)
    return bins


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT, branch: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. The incumbent is best-fit decreasing; bin completion searches for fewer bins.

    A node closes bins around the largest item left: equal bins are closed together. A branch is cut when the
    bins it must still open, by the waste so far and the volume left, reach the incumbent's number. A quick search
    tries a few good fillings at every node; if the bound isn't reached, a second one goes through all undominated ones.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    bins = best_fit(counts, capacity)
    bound = least_bins(counts, capacity)
    for few in (branch, None):
        if len(bins) > bound:
            bins = search(counts, bins, bound, capacity, node_limit, few)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    items = np.argsort(sizes, kind="stable")
    at = np.cumsum(counts) - counts
    flat = np.array([x for b in bins for x in b], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    begin = np.cumsum(flat) - flat
    starts = np.cumsum([0, *(len(b) for b in bins)])[:-1]
    place = begin - (begin[starts] if len(starts) else begin)[number] if len(flat) else flat
    order = np.argsort(flat, kind="stable")
    taken = items[at[flat[order]] + (np.arange(len(flat)) - (np.cumsum(np.bincount(flat, minlength=capacity + 1)) - np.bincount(flat, minlength=capacity + 1))[flat[order]])]
    where[taken], offset[taken] = number[order], place[order]
    return where, offset


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, block_pieces: int = BLOCK_PIECES, with_ids: bool = False, rows: int | None = None) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the search finds.

    A null text counts as empty: its one piece is the closing id. A null doc_id is kept; repeated rows are packed
    each. An empty table gives no rows. Columns other than doc_id and text aren't read.
    rows: the number of documents, if known; the number of blocks grows with it.
    """
    blocks = max(1, round((docs.count() if rows is None else rows) * 1.3 / block_pieces))
    pieces = token_pieces(docs, capacity, name, with_ids)
    columns = pieces.columns

    @tidy
    def run(table: pa.Table) -> pa.Table:
        where, offset = pack_sizes(table.column("length").to_numpy(), capacity)
        block = table.column("block")[0].as_py()
        return table.select(columns).append_column("sequence_id", pa.array(where + (block << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = PIECES + (", input_ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    # Dealt by the row's number, so that repeated rows spread as others do.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInArrow(run, schema)

"""Substring dedup: recurring passages are confirmed, compiled into sharded automata, and located in every document.

Plan: (1) the hashes of all 13-word windows are exchanged in packed blocks; a part tells which documents hold a
window first (its owners) and which hold it again. (2) Owners are dealt into shards; an owner that many documents
repeat is salted, its automaton built in several tasks. Only documents that own or repeat something are exchanged.
(3) A task confirms the passages of its owners that recur in its documents, compiles them into an Aho-Corasick
automaton over word numbers, and streams the documents through it; every located window is compared word by word.
(4) Only the spans found travel back to the documents, of which those that lose nothing stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .exchange import Packer, distinct_pairs, id_filter, let_through, pack_pairs, parts_for, shared_runs, unpack
from .storage import keep, release
from .words import array_of, chunks, gram_starts, grams, hash_words, split_words, tidy

WINDOW = 13
#: Documents routed to a task on average, and of one owner at most.
SHARD_DOCS = 400
#: Bytes of text for each word, low, so that parts come out rather small.
WORD_BYTES = 5
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeats(docs: DataFrame, window: int = WINDOW, text_bytes: int | None = None) -> DataFrame:
    """(owner, doc_id): the document repeats a window whose first document, by id, is the owner."""
    if text_bytes is None:
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(text_bytes // WORD_BYTES)

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            for part in chunks(batch):
                codes, ends, words = split_words(array_of(part.column("text")))
                hashes = grams(hash_words(words)[codes], window)
                starts, text = gram_starts(ends, window)
                yield from packer.add(hashes[starts], np.asarray(part.column("doc_id"))[text])
        yield packer.flush()

    @tidy
    def find(table: pa.Table) -> pa.Table:
        run, ids = shared_runs(*unpack(table)[:2])
        if not len(run):
            return pack_pairs(np.empty((2, 0), np.int64), parts)
        first = np.concatenate([[True], run[1:] != run[:-1]])
        owner = ids[first][np.cumsum(first) - 1]
        return pack_pairs(np.unique(np.stack([owner[~first], ids[~first]]), axis=1), parts)

    packed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, exchange.SCHEMA)
    return distinct_pairs(packed.groupBy("part").applyInArrow(find, exchange.PAIRS), "owner", "doc_id")


def routes(pairs: DataFrame) -> DataFrame:
    """(doc_id, places): the shards and salts a document goes to, as owner of passages, to be searched, or both."""
    owners = pairs.groupBy("owner").agg(F.count("*").alias("docs"))
    number = pairs.count()
    shards = max(1, number // SHARD_DOCS)
    owners = owners.select("owner", F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), F.ceil(F.col("docs") / SHARD_DOCS).cast("int").alias("salts"))
    searched = pairs.join(owners, "owner").select("doc_id", "shard", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0).cast("int").alias("salt"), F.lit(False).alias("owns"), F.lit(True).alias("search"))
    owning = owners.select(F.col("owner").alias("doc_id"), "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("owns"), F.lit(False).alias("search"))
    once = searched.unionByName(owning).groupBy("doc_id", "shard", "salt").agg(F.max("owns").alias("owns"), F.max("search").alias("search"))
    return once.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "salt", "owns", "search")).alias("places"))


def passages(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first word, word after) of the runs of windows that start one word after the other; places: in order."""
    apart = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], apart + 1])].tolist(), (places[np.concatenate([apart, [len(places) - 1]])] + window).tolist(), strict=True)) if len(places) else []


def locate(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """Spans (first word, word after) of one shard's searched documents that stand in a smaller document it owns.

    A passage is a run of an owner's windows that recur in a searched document. The automaton holds the passages'
    word blocks that start at every step-th word, step = window // 2 + 1: every window holds such a block whole. A
    located block names the windows around it, and those are confirmed against the owner's own words.
    """
    import ahocorasick

    step = window // 2 + 1
    ids = table.column("doc_id").to_numpy()
    owns, search = (np.asarray(array_of(table.column(c)).to_numpy(zero_copy_only=False), bool) for c in ("owns", "search"))
    codes, ends, words = split_words(array_of(table.column("text")))
    hashes = grams(hash_words(words)[codes], window)
    starts, text = gram_starts(ends, window)
    sought = np.unique(hashes[starts[search[text]]])
    owned = owns[text]
    place, key, who = starts[owned], hashes[starts[owned]], ids[text[owned]]
    at = np.minimum(np.searchsorted(sought, key), len(sought) - 1)
    again = sought[at] == key if len(sought) else np.zeros(len(key), bool)
    place, key, who = place[again], key[again], who[again]
    order = np.lexsort((who, key))
    sorted_place, key, who = place[order], key[order], who[order]
    once = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    sorted_place, key, who = sorted_place[once], key[once], who[once]  # of each window the smallest owner
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for begin, end in passages(np.sort(sorted_place), window):
        part = codes[begin:end].tolist()
        for block in range(0, len(part) - step + 1, step):
            automaton.add_word(tuple(part[block : block + step]), 1)
    out: list[tuple[int, int, bytes]] = []
    if len(automaton):
        automaton.make_automaton()
        keys = table.column("key").to_pylist()
        for row in np.flatnonzero(search).tolist():
            begin, end = int(ends[row]), int(ends[row + 1])
            if end - begin < window:
                continue
            last = np.fromiter((i for i, _ in automaton.iter(tuple(codes[begin:end].tolist()))), np.int64)
            if not len(last):
                continue
            near = np.unique((last[:, None] - (step - 1) - np.arange(window - step + 1)).ravel())
            near = near[(near >= 0) & (near <= end - begin - window)] + begin
            at = np.searchsorted(key, hashes[near])
            found = at < len(key)
            found[found] = key[at[found]] == hashes[near[found]]
            near, at = near[found], at[found]
            smaller = who[at] < ids[row]
            near, at = near[smaller], at[smaller]
            same = np.ones(len(near), bool)
            for j in range(window):
                same &= codes[near + j] == codes[sorted_place[at] + j]
            near = near[same] - begin
            if len(near):
                apart = np.flatnonzero(np.diff(near) > window)
                spans = np.stack([near[np.concatenate([[0], apart + 1])], near[np.concatenate([apart, [len(near) - 1]])] + window], axis=1)
                out.append((int(ids[row]), keys[row], spans.astype(np.int64).tobytes()))
    return pa.table({"doc_id": pa.array([r[0] for r in out], pa.int64()), "key": pa.array([r[1] for r in out], pa.int64()), "spans": pa.array([r[2] for r in out], pa.binary())})


def remove(text: str | None, spans: list[bytes]) -> tuple[list[bytes], int]:
    """(words left, number removed) of a text and the spans found in it; spans may overlap."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    for found in spans:
        both = np.frombuffer(found, np.int64).reshape(-1, 2)
        np.add.at(gone, both[:, 0], 1)
        np.add.at(gone, both[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
    return [words[i] for i in kept], len(words) - len(kept)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, spans) of the documents that lose words; key is the hash of the text, spans their first words and words after."""
    spark = docs.sparkSession
    release(spark)
    pairs = keep(repeats(docs, window), "repeats")
    release(spark)
    # Only documents that own or repeat something are exchanged.
    there = id_filter(pairs.select(F.explode(F.array("owner", "doc_id")).alias("id")).distinct(), "id")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    routed = let_through(texts, there).join(routes(pairs), "doc_id").select("doc_id", "key", "text", F.inline("places"))
    spans = routed.groupBy("shard", "salt").applyInArrow(tidy(lambda t: locate(t, window)), "doc_id long, key long, spans binary")
    out = keep(spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")), "spans")
    release(spark)
    return out


def with_spans(rows: DataFrame, spans: DataFrame, there: tuple[DataFrame, int]) -> DataFrame:
    """The rows that may lose words, with their _spans (null: none)."""
    some = let_through(rows, there).withColumn("_key", F.xxhash64("text"))
    found = spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_found"), F.col("spans").alias("_spans"))
    return some.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_found")), "left").select(*rows.columns, "_spans")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the words of windows that start in a document with a smaller doc_id.

    Windows are judged on the input. A text that loses words holds the others joined by one space; other texts stay
    as they are. A row without an id or text stays and serves as no one's earlier document; rows that share an id
    don't count against each other. Extra columns stay. An empty table gives no rows.
    """
    spans = repeated_spans(docs, window)
    there = id_filter(spans, "doc_id")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = [b" ".join(remove(text, spans)[0]).decode() if spans else text for text, spans in zip(batch.column(at).to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)][:-1]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return with_spans(docs, spans, there).mapInArrow(cut, docs.schema).unionByName(let_through(docs, there, False))


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: what dedup_substrings leaves, as one digest."""

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column("_spans").to_pylist() if "_spans" in batch.schema.names else [None] * batch.num_rows
            for text, found in zip(batch.column("text"), spans, strict=True):
                words, gone = remove(text.as_py(), found or [])
                out.append((len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, window)
    there = id_filter(spans, "doc_id")
    return with_spans(rows, spans, there).mapInArrow(digest, REPORT).unionByName(let_through(rows, there, False).mapInArrow(digest, REPORT))

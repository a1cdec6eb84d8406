"""Mixing sources to target weights in fixed-length blocks of words.

Plan: sizes per source (a map-side combined count), targets by water-filling over the table of sources; word ranges
of documents in their source's stream by a two-level running sum, so that a hot source never meets in one task. A
source's stream is packed into blocks; it gives as many slots as its target asks for, the last one cut so that the
words taken are the target's, to the word. A multinomial draw of each source's slots over the output shards says
which shard holds how many blocks of which source; slots are mapped through per-source permutations of the block
indices and joined with the blocks by (source, block). No text is shuffled for the counts, and the driver holds no
list of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep, release
from .words import tidy

WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words.
MOST = 3
#: Words in a block.
BLOCK = 64
#: Output shards, each with its own multinomial draw.
SHARDS = 64
SEED = 20240607
#: Up to so many sources their table is broadcast.
BROADCAST_SOURCES = 10_000
#: Rows of a source that one task adds up.
CHUNK_ROWS = 20_000
#: Slots that one row of the draw table stands for at most.
SLOT_RUN = 1 << 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of all words by weight; what exceeds `most` times a source's size is shared anew among the others by weight."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, float(sum(sizes))
    while free:
        unit = left / sum(share[i] for i in free)
        over = {i for i in free if share[i] * unit > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= over
    return out


def draw_counts(slots: int, shards: int, seed: int, source: int) -> np.ndarray:
    """Slots of one source in every output shard, drawn from a multinomial with equal chances. Over all sources, a shard's counts given its size follow the sources' shares."""
    return np.random.Generator(np.random.PCG64([seed, source])).multinomial(slots, np.full(shards, 1 / shards))


def permuted(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for every key, or its inverse: four Feistel rounds on the next even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64)) for r in range(4)]

    def mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)) & mask

    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ mixed(left, k), left) if back else (right, left ^ mixed(right, k))
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def slots_for(words: int, size: int, block: int, key: int) -> tuple[int, int]:
    """(slots, words of the last one) that take exactly `words` of a source of `size` words: whole passes over its blocks, then permuted blocks, the last one cut. A pass holds every block once."""
    if not size or not words:
        return 0, 0
    blocks = -(-size // block)
    missing = blocks * block - size  # of the last block
    passes, rest = divmod(words, size)
    if not rest:
        return passes * blocks, int(block_words(np.array([passes * blocks - 1]), size, block, key)[0])
    short = int(permuted(np.array([blocks - 1]), blocks, key, back=True)[0])
    number = -(-rest // block)
    if number > short:
        number = max(short + 1, -(-(rest + missing) // block))
    before = (number - 1) * block - (missing if short < number - 1 else 0)
    return passes * blocks + number, rest - before


def block_words(slots: np.ndarray, size: int, block: int, key: int) -> np.ndarray:
    """Words of the blocks that slots stand for."""
    blocks = -(-size // block)
    return np.minimum(block, size - permuted(slots % blocks, blocks, key) * block)


def word_ranges(rows: DataFrame, number: int) -> DataFrame:
    """Add `start`, the words before a row in its source's stream. Rows are dealt by a hash into chunks; chunk totals are added up apart."""
    pieces = max(1, -(-number // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(pieces)))
    totals = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "chunk", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "crc", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["source_no", "chunk"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("chunk", "inside", "ahead")


def with_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_no, source, source_size, target) of all sources by code point, null last; the rule is that of targets(), over a table of any length."""
    spark = rows.sparkSession
    ordered = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    ordered = keep(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    # Rows are numbered inside their partition of the sort; what stands before a partition is counted apart.
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["number"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("number")).collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, before long")
    numbered = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("source_no", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.select("source_no", "source", "source_size", share.cast("double").alias("share"))
    total, free = numbered.where("source_size > 0").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
    unit, over = total / free if free else 0.0, 0
    while True:
        above = (F.col("source_size") > 0) & (F.col("share") * unit > most * F.col("source_size"))
        number, given, taken = numbered.where(above).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
        if number == over:
            break
        over, unit = number, (total - most * given) / (free - taken)
    target = F.when(F.col("source_size") == 0, 0.0).when(above, most * F.col("source_size")).otherwise(F.col("share") * unit)
    return keep(numbered.select("source_no", "source", "source_size", target.cast("double").alias("target")), "targets")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with their word range, source and target; slots).

    docs may have a column `row` that tells repeated rows apart. A slot has the output shard, its place among the
    source's slots, source_no, block, the pass over the source's blocks, and the words of the block that it takes.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.col("row") if "row" in docs.columns else F.lit(0)
    rows = keep(docs.select("doc_id", "source", row.cast("long").alias("row"), F.crc32(text.cast("binary")).alias("crc"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")), "mix")
    sources = with_targets(rows, weights)
    few = sources.count() <= BROADCAST_SOURCES
    rows = rows.join(sources.hint("broadcast") if few else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = keep(word_ranges(rows, rows.count()), "mix-ranges")

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, size, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, last = slots_for(round(target), size, block, seed * 1_000_003 + source)
                counts = draw_counts(number, shards, seed, source)
                ends = np.cumsum(counts)
                runs = [(shard, at, min(SLOT_RUN, end - at)) for shard, (start, end) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)) for at in range(start, end, SLOT_RUN)]
                columns = [pa.array([r[i] for r in runs], pa.int64()) for i in range(3)] + [pa.array([x] * len(runs), pa.int64()) for x in (source, size, number, last)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "start", "number", "source_no", "size", "slots", "last"])

    @tidy
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, number, source, size, slots, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot, key, blocks = np.arange(start, start + number), seed * 1_000_003 + source, -(-size // block)
                taken = permuted(slot % blocks, blocks, key)
                words = np.where(slot == slots - 1, last, np.minimum(block, size - taken * block))
                columns = [pa.array(np.full(number, shard)), pa.array(slot), pa.array(np.full(number, source)), pa.array(taken), pa.array(slot // blocks), pa.array(words)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "source_no", "block", "turn", "words"])

    runs = sources.select("source_no", "source_size", "target").mapInArrow(deal, "shard long, start long, number long, source_no long, size long, slots long, last long")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    runs = runs.repartition(max(1, words // (block * SLOT_RUN * 4)), "source_no", "start")
    return rows, runs.mapInArrow(expand, "shard long, slot long, source_no long, block long, turn long, words long")


def taken_parts(rows: DataFrame, slots: DataFrame, block: int, *more: str) -> DataFrame:
    """Parts of documents that a slot takes: the keys of the row, first word inside the document, words, and columns of the slot.

    Spark takes what grows from the table of sources for as small as that, so joins with it name their kind and nothing is broadcast unchecked.
    """
    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("_words"))
    joined = parts.select("row", "source_no", "start", "size", "block").join(slots.withColumnRenamed("words", "_words").hint("merge"), ["source_no", "block"]).where(high > low)
    return joined.select("row", "source_no", "start", (low - F.col("start")).alias("first"), (high - low).alias("words"), *more)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Words the mix takes from every document, repeats counted, and the first and the number of output shards that hold some.

    A null text has no words; a null source is a source like another, the last. A repeated row has its own range. A
    document without words gives nothing. An empty table gives no rows. Other columns aren't read.
    """
    release(docs.sparkSession)
    rows, slots = plan_mix(docs.select("doc_id", "source", "text"), weights, block, shards, seed)
    # Of a block only the number of times and the shards matter here.
    often = slots.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"), F.collect_set("shard").alias("held"))
    parts = taken_parts(rows, often, block, "times", "held")
    given = parts.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"))
    # A range with words belongs to one row, so its source and start are that row's key.
    joined = rows.join(given.withColumnRenamed("start", "_start").hint("merge"), (rows["source_no"] == given["source_no"]) & (rows["start"] == F.col("_start")) & (rows["size"] > 0), "left").drop(given["source_no"])
    return joined.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.array_min("held").cast("int").alias("first_shard"), F.coalesce(F.size("held"), F.lit(0)).alias("n_shards"))


def numbered(docs: DataFrame) -> DataFrame:
    """The documents, written with a number for every row as `_row`."""
    return keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus by output shard: (shard, place, source, doc_id, text), for every block taken its parts by document, whose words are joined by one space.

    A shard's blocks stand in a pseudorandom order, given by `place`; the parts of one block share it.
    """
    release(docs.sparkSession)
    docs = numbered(docs.select("doc_id", "source", "text"))
    rows, slots = plan_mix(docs.withColumnRenamed("_row", "row"), weights, block, shards, seed)
    parts = taken_parts(rows, slots, block, "shard", "slot").withColumn("place", F.xxhash64("source_no", "slot", F.lit(seed)))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.col("first") + 1, F.col("words")), " ")
    return parts.hint("merge").join(docs, parts["row"] == docs["_row"]).select(F.col("shard").cast("int").alias("shard"), "place", "source", "doc_id", words.alias("text"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus, with the columns of `docs`: for every pass over a source that takes words of a document a row with those words.

    A text taken whole stays as it is; of one taken in part the words are joined by one space. n_chars, if there is
    such a column, follows the text. A repeated row has its own range. What isn't taken is gone.
    """
    release(docs.sparkSession)
    schema, docs = docs.schema, numbered(docs)
    rows, slots = plan_mix(docs.select("doc_id", "source", "text", F.col("_row").alias("row")), weights, block, shards, seed)
    parts = taken_parts(rows, slots, block, "turn").groupBy("row").agg(F.collect_list(F.struct("turn", "first", "words")).alias("_parts"))
    joined = docs.join(parts.hint("merge"), docs["_row"] == parts["row"]).select(*schema.names, "_parts")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = [], []
            for i, (text, given) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_parts").to_pylist(), strict=True)):
                words, turns = text.encode().split(), {}
                for turn, first, number in sorted((p["turn"], p["first"], p["words"]) for p in given):
                    turns.setdefault(turn, []).extend(words[first : first + number])
                for now in turns.values():
                    row.append(i)
                    texts.append(text if len(now) == len(words) else b" ".join(now).decode())
            out = batch.select([c for c in batch.schema.names if c != "_parts"]).take(pa.array(row, pa.int64()))
            columns = {"text": pa.array(texts, pa.string())}
            if "n_chars" in out.schema.names:
                columns["n_chars"] = pa.array(map(len, texts), pa.int64()).cast(out.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns.get(c, out.column(c)) for c in out.schema.names], out.schema.names)

    return joined.mapInArrow(cut, schema)

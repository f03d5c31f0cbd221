"""Best-fit packing by a grouping genetic algorithm.

A document's ids and an end id are cut into pieces of at most ``capacity`` tokens;
pieces that fill a sequence stand alone.  The other pieces are dealt by a hash to
shards of bounded size.  On every shard several islands evolve packings: a
crossover injects whole well-filled bins of one parent into another, removes the
bins that now hold duplicates and best-fits the displaced pieces; between epochs
every island hands its best packing to the next island.  The best packing of a
shard wins.  Bins that are not well filled are opened again and their pieces meet
those of other shards in the next round, so that the loss at the seams shrinks to
that of a single shard.

No shard, island or sequence grows with the input.  Null text is an empty document
(one piece, the end id alone); repeated rows are packed once each; an empty table
gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import LONG_ROWS, forget, whole_text, written
from loomgraph.llm.word_cache import JsonTokenizer, worker_once

ship_by_value(__name__)

CAPACITY = 4096
END_ID = 1
#: Pieces that one shard packs, on average.
SHARD_ITEMS = 3_000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
#: Share of the capacity from which a bin is kept at once.
WELL_FILLED = 0.995

Bins = list[list[int]]

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian) of every document."""
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = worker_once(("json", tokenizer), lambda: JsonTokenizer(tokenizer))
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, body in zip(batch.column(0).to_pylist(), library.encode(batch.column(1).to_pylist()), strict=True):
                body += end
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    ids = body[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids), strict=False):
                        column.append(value)
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    schema = _PIECES.replace("doc_id bigint", f"doc_id {docs.schema[key].dataType.simpleString()}") + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text")).mapInArrow(stage, schema)


class _Room:
    """Bins by free room, to find the fullest bin that still takes a piece."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, number: int, room: int) -> None:
        self.by_room[room].append(number)
        self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        held = self.by_room[room]
        number = held.pop()
        if not held:
            self.mask ^= 1 << room
        return number, room


def best_fit(items: list[int], lengths: list[int], bins: Bins, fills: list[int], capacity: int) -> None:
    """Put ``items`` one after another into the fullest bin with room, opening bins as needed."""
    room = _Room(capacity)
    for number, fill in enumerate(fills):
        room.put(number, capacity - fill)
    for item in items:
        length = lengths[item]
        found = room.take(length)
        if found is None:
            bins.append([item])
            fills.append(length)
            room.put(len(bins) - 1, capacity - length)
        else:
            number, free = found
            bins[number].append(item)
            fills[number] += length
            room.put(number, free - length)


def _fitness(bins: Bins, lengths: list[int]) -> tuple[int, int]:
    """Fewer bins first; among equals, packings whose bins are filled unevenly, as these leave larger gaps."""
    return len(bins), -sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def crossover(taker: Bins, giver: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """``taker`` with some of the well-filled bins of ``giver`` injected whole."""
    fills = [sum(lengths[i] for i in b) for b in giver]
    best = sorted(range(len(giver)), key=lambda b: -fills[b])[: max(1, len(giver) // 2)]
    injected = rng.sample(best, max(1, len(best) // 3))
    held = {i for b in injected for i in giver[b]}
    kept, displaced = [], []
    for b in taker:
        if held.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in held]
    # The emptiest bins open too, so that their pieces can fill the gaps.
    kept.sort(key=lambda b: sum(lengths[i] for i in b))
    opened = max(1, len(kept) // 20)
    displaced += [i for b in kept[:opened] for i in b]
    child = kept[opened:] + [list(giver[b]) for b in injected]
    displaced.sort(key=lambda i: (-lengths[i], i))
    best_fit(displaced, lengths, child, [sum(lengths[i] for i in b) for b in child], capacity)
    return child


def evolve(lengths: list[int], elites: list[Bins], seed: int, capacity: int) -> Bins:
    """The best packing an island finds from its elites and fresh packings."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    population = [e for e in elites if e]
    while len(population) < POPULATION:
        jitter = 0 if not population else 0.1
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i] * (1 + jitter * rng.random()), i))
        bins: Bins = []
        best_fit(order, lengths, bins, [], capacity)
        population.append(bins)
        if len(bins) <= least:
            return bins
    scored = sorted(((_fitness(b, lengths), n, b) for n, b in enumerate(population)), key=lambda x: x[:2])
    born = len(scored)
    for _ in range(GENERATIONS):
        if scored[0][0][0] <= least:
            break
        one, other = rng.sample(scored, 2)
        child = crossover(one[2], other[2], lengths, capacity, rng)
        born += 1
        scored = sorted([*scored, (_fitness(child, lengths), born, child)], key=lambda x: x[:2])[:POPULATION]
    return scored[0][2]


def _assignment(bins: Bins, n: int) -> list[int]:
    where = [0] * n
    for number, held in enumerate(bins):
        for item in held:
            where[item] = number
    return where


def _bins(assignment) -> Bins:
    if assignment is None or len(assignment) == 0:
        return []
    bins: Bins = [[] for _ in range(max(assignment) + 1)]
    for item, number in enumerate(assignment):
        bins[number].append(item)
    return [b for b in bins if b]


_STATE = "shard bigint, island int, uids array<bigint>, lengths array<int>, best array<int>, n_bins int"


def _epoch(state: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Every island evolves its own packing and the one that came from its neighbour."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                elites = [_bins(row.best), _bins(row.migrant)]
                seed = (int(row.shard) * ISLANDS + int(row.island)) * EPOCHS + epoch
                bins = evolve(lengths, elites, seed, capacity)
                out.append((row.shard, row.island, row.uids, row.lengths, _assignment(bins, len(lengths)), len(bins)))
            yield pd.DataFrame(out, columns=["shard", "island", "uids", "lengths", "best", "n_bins"])

    return state.mapInPandas(stage, _STATE)


def _pack_round(items: DataFrame, shards: int, capacity: int, name: str) -> DataFrame:
    """``uid, length, shard, bin, fill`` of the best packing of every shard, written."""
    parts = max(1, min(shards * ISLANDS, 4 * items.sparkSession.sparkContext.defaultParallelism, 10_000))
    shard = F.pmod(F.xxhash64("uid", F.lit(name)), F.lit(shards)).alias("shard")
    start = (
        items.select(shard, F.struct("uid", "length").alias("item"))
        .groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.col("items.uid").alias("uids"), F.col("items.length").cast("array<int>").alias("lengths"),
        )
        .repartition(parts, "shard", "island")
    )
    none = F.lit(None).cast("array<int>")
    state = written(_epoch(start.select("*", none.alias("best"), none.alias("migrant")), 0, capacity), f"{name}_epoch0")
    for epoch in range(1, EPOCHS):
        leaving = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("migrant"))
        met = state.drop("n_bins").join(leaving, ["shard", "island"]).repartition(parts, "shard", "island")
        before, state = state, written(_epoch(met, epoch, capacity), f"{name}_epoch{epoch}")
        forget(before)
    won = state.groupBy("shard").agg(F.min_by(F.struct("uids", "lengths", "best"), F.struct("n_bins", "island")).alias("won"))
    flat = won.select("shard", F.inline(F.arrays_zip("won.uids", "won.lengths", "won.best"))).toDF("shard", "uid", "length", "bin")
    packed = written(flat.withColumn("fill", F.sum("length").over(Window.partitionBy("shard", "bin"))), f"{name}_best")
    forget(state)
    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``uid, sequence_id, offset`` for pieces of ``uid, length``; ``uid`` must be unique and not negative."""
    items = pieces.select(F.col("uid").cast("bigint").alias("uid"), F.col("length").cast("int").alias("length"))
    placed = items.filter(F.col("length") >= capacity).select("uid", "length", (-F.col("uid") - 1).alias("sequence_id"))
    left, turn, base = items.filter(F.col("length") < capacity), 0, 0
    count = left.count()
    while count:
        shards = -(-count // shard_items)
        packed = _pack_round(left, shards, capacity, f"pack{turn}")
        keep = F.lit(True) if shards == 1 else F.col("fill") >= F.lit(WELL_FILLED * capacity)
        opened = packed.filter(~keep).count()
        if opened > 0.5 * count:
            # What is left does not get much better by meeting other shards.
            keep, opened = F.lit(True), 0
        number = F.lit(base) + F.col("shard") * F.lit(1 << 24) + F.col("bin")
        placed = placed.union(packed.filter(keep).select("uid", "length", number.cast("bigint").alias("sequence_id")))
        left, count, turn = packed.filter(~keep).select("uid", "length"), opened, turn + 1
        base += shards << 24
    order = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("uid", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its document's key, its place there, and its sequence and offset."""
    cut = cut_pieces(docs, tokenizer, capacity, end_id, key, text)
    pieces = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces", LONG_ROWS)
    return pieces.join(pack(pieces, capacity), "uid").drop("uid")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, length`` from placed pieces with their ``ids`` (little-endian 32-bit words)."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p.ids", F.lit(b""), lambda held, ids: F.concat(held, ids)).alias("ids"),
        F.aggregate("p.length", F.lit(0).cast("bigint"), lambda held, n: held + n).alias("length"),
    )

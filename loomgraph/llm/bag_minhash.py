"""Near duplicates by BagMinHash signatures of shingle multisets.

A text is the multiset of its shingles of five words (all its words, if fewer).  A
signature estimates the weighted Jaccard similarity of two multisets.  It comes from
Poisson processes, one for every shingle and block of weights: the weight axis is cut
at 0, 1, 2, 4, 8 and so on, a block's process has the block's length as its rate, and
every point carries a slot and a place inside its block, found by halving the block as
often as needed.  Points above the shingle's weight are left out; the earliest point
of each slot is the signature.  Points are generated in order of time and only up to a
time at which the slots are filled, so a long text costs hardly more than a short one.

Bands of the signature give buckets.  In every bucket all texts meet one pivot, and the
best pivots of a text are verified by exact overlap of the multisets.  Classes that then share a
bucket make a family.  Texts of a family are compared by exact overlap, all classes with each other but not
within the largest one: a family is cut into blocks, and two blocks meet in one multiplication of
0/1 matrices, which sends back no more links than it takes to connect classes.  So no pair of texts is a
row, buckets are not cut off, and every link between classes that the bands find is found.

At a similarity of 0.8, 26 bands of 5 miss a pair with a chance of 3e-5, and comparing
pivots by signature drops one with a chance of 3e-5.  Equal texts are one node from the start.
Texts and shingles are told apart by 64-bit hashes.

Null text is empty.  A text without words is near no other text; equal ones are copies.
Repeated rows are copies of each other.  An empty table gives an empty result.  Only
key and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import LONG_ROWS, as_row, forget, named, whole_text, written

ship_by_value(__name__)

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
#: Equal slots from which a pair is verified: 4 standard deviations below the mean at the similarity.
LEAST_EQUAL = int(SIMILARITY * SLOTS - 4 * (SLOTS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Pivots that a text is verified with in the first pass.
FIRST_PIVOTS = 2
#: Texts and items of a block of a family.
BLOCK_TEXTS, BLOCK_ITEMS = 2_048, 1 << 18
#: Columns of a matrix that is multiplied.
TILE_ITEMS = 1_024
#: Node lists up to this length (8 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_NODES = 2_000_000
#: Texts to verify are broadcast up to this many bytes in total.
BROADCAST_TEXT_BYTES = 8 << 20
#: Shingles of the bags that a worker keeps.
KEPT_SHINGLES = 1 << 19
#: Words handled at a time in a worker.
CHUNK_WORDS = 1 << 18

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of texts given as word hashes one after another."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    words = words.astype(np.uint64)
    hashes = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for n in range(SHINGLE):
        hashes = mixed(hashes ^ words[n : n + len(hashes)]) + _U(n + 1)
    many = np.maximum(lengths - SHINGLE + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    extra = np.zeros(len(short), np.uint64)
    for k, row in enumerate(short):
        value = np.zeros(1, np.uint64)
        for n, word in enumerate(words[starts[row] : starts[row] + lengths[row]]):
            value = mixed(value ^ word) + _U(n + 1)
        extra[k] = value[0]
    return np.concatenate([rows, short]), np.concatenate([hashes[at], extra])


def bags(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and multiplicity of the different shingles of every row, in order."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, many: int) -> np.ndarray:
    """The earliest time in each slot for ``many`` rows; infinite for rows without shingles."""
    earliest = np.full(many * SLOTS, np.inf)
    totals = np.bincount(rows, weights=weights, minlength=many)
    if not len(rows):
        return earliest.reshape(many, SLOTS)
    # Processes: the shingle's blocks that begin below its weight.
    levels = [np.arange(len(rows))]
    while len(levels[-1]):
        levels.append(np.flatnonzero(weights > (1 << (len(levels) - 1))))
    item = np.concatenate(levels)
    level = np.concatenate([np.full(len(x), n) for n, x in enumerate(levels)])
    width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    below = np.where(level > 0, width, 0)
    seed = mixed(hashes[item] + _U(0x9E3779B97F4A7C15) * (level.astype(np.uint64) + _U(1)))
    row, room, rate = rows[item], weights[item] - below, width.astype(np.float64)
    limit = np.zeros(many)
    todo = totals > 0
    limit[todo] = SLOTS * (np.log(SLOTS) + 3.0) / totals[todo]
    unfilled = np.flatnonzero(todo)
    while len(unfilled):
        wanted = np.zeros(many, bool)
        wanted[unfilled] = True
        live = np.flatnonzero(wanted[row])
        time, turn = np.zeros(len(live)), 0
        state = seed[live]
        while len(live):
            turn += 1
            state = mixed(state + _U(0x9E3779B97F4A7C15))
            time = time - np.log(_uniform(state)) / rate[live]
            on = time <= limit[row[live]]
            live, time, state = live[on], time[on], state[on]
            draw = mixed(state ^ _U(0xD1B54A32D192ED03))
            slot = ((draw >> _U(32)) % _U(SLOTS)).astype(np.int64)
            # The block is halved by the bits of the draw down to a single unit of weight.
            unit = (draw & (width[live] - 1).astype(np.uint64)).astype(np.int64)
            inside = unit < room[live]
            np.minimum.at(earliest, row[live[inside]] * SLOTS + slot[inside], time[inside])
        left = np.isinf(earliest.reshape(many, SLOTS)[unfilled]).any(1)
        unfilled = unfilled[left]
        limit[unfilled] *= 2
    return earliest.reshape(many, SLOTS)


def sketch(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sixteen bits per slot to compare, and a hash per band."""
    values = mixed(np.ascontiguousarray(times).view(np.uint64))
    band = np.zeros((len(times), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    grouped = values.reshape(len(times), BANDS, ROWS)
    for n in range(ROWS):
        band = mixed(band ^ grouped[:, :, n])
    return (values & _U(0xFFFF)).astype("<u2"), band.view(np.int64)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words of a text."""
    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a column of lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets)


def _spans(lengths: np.ndarray, limit: int = CHUNK_WORDS) -> Iterator[tuple[int, int]]:
    cut = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lengths) // limit)) + 1, [len(lengths)]]))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node, weight, sig, bands`` of every different text; texts without words have no bands."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = _lists(batch.column(1))
            for first, last in _spans(lengths):
                part = batch.slice(first, last - first)
                words, counts = _lists(part.column(1))
                rows, hashes, weights = bags(*shingles(words, counts))
                times = signatures(rows, hashes, weights, len(counts))
                sig, band = sketch(times)
                total = np.bincount(rows, weights=weights, minlength=len(counts)).astype(np.int64)
                full = np.flatnonzero(total)
                offsets = np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(total), pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[full].ravel())),
                ], names=["node", "weight", "sig", "bands"])

    body = docs.select(whole_text(text).alias("text"))
    rows = body.select(F.xxhash64("text").alias("node"), word_hashes(F.col("text")).alias("words"))
    return rows.mapInArrow(stage, "node bigint, weight bigint, sig binary, bands array<bigint>").dropDuplicates(["node"])


def _equal_slots(pairs: DataFrame) -> DataFrame:
    """``x, y, equal`` for rows of ``x, y, sx, sy`` that can reach the similarity."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                one, two = (np.frombuffer(b"".join(part.column(n).to_pylist()), "<u2").reshape(-1, SLOTS) for n in (2, 3))
                equal = (one == two).sum(1)
                keep = pa.array(np.flatnonzero(equal >= LEAST_EQUAL))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(equal.astype(np.int64)).take(keep)], names=["x", "y", "equal"])

    return pairs.select("x", "y", "sx", "sy").mapInArrow(stage, "x bigint, y bigint, equal bigint")


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted different values and counts."""
    at = np.minimum(np.searchsorted(two[0], one[0]), max(0, len(two[0]) - 1))
    same = two[0][at] == one[0] if len(two[0]) else np.zeros(len(one[0]), bool)
    shared = np.minimum(one[1][same], two[1][at[same]]).sum()
    whole = one[1].sum() + two[1].sum() - shared
    return float(shared / whole) if whole else 0.0


def verified(pairs: DataFrame, docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``x, y`` of the pairs whose multisets reach the similarity."""
    needed = written(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "needed_nodes")
    texts = docs.select(F.xxhash64(whole_text(text)).alias("node"), whole_text(text).alias("text"))
    few = needed.count() <= BROADCAST_NODES
    found = texts.join(F.broadcast(needed) if few else needed, "node", "left_semi")
    # Copies of a text leave each map task once.
    found = written(found.groupBy("node").agg(F.first("text").alias("text")), "needed_texts")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= BROADCAST_TEXT_BYTES:
        # Few texts in many pairs, as of a large group of varied copies: hashed once each, and the pairs stay in place.
        hashed = written(found.select("node", word_hashes(F.col("text")).alias("w")), "needed_words")
        met = pairs.select("x", "y").join(F.broadcast(hashed.toDF("x", "wx")), "x").join(F.broadcast(hashed.toDF("y", "wy")), "y")
    else:
        one, two = found.toDF("x", "tx"), found.toDF("y", "ty")
        met = pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", word_hashes(F.col("tx")).alias("wx"), word_hashes(F.col("ty")).alias("wy"))

    def bag_of(words: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        values = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
        return np.unique(shingles(values, np.array([len(values)]))[1], return_counts=True)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bags of nodes that occur again, as long as they are few.
            bags_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            held, near = 0, []
            xs, ys = (batch.column(n).to_pylist() for n in (0, 1))
            for row, ends in enumerate(zip(xs, ys, strict=True)):
                pair = []
                for node, words in zip(ends, (2, 3), strict=True):
                    found = bags_of.get(node)
                    if found is None:
                        found = bags_of[node] = bag_of(batch.column(words)[row])
                        held += len(found[0])
                    pair.append(found)
                near.append(overlap(*pair) >= similarity)
                if held > KEPT_SHINGLES:
                    bags_of.clear()
                    held = 0
            keep = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["x", "y"])

    return met.select("x", "y", "wx", "wy").mapInArrow(stage, "x bigint, y bigint")


def classes(links: DataFrame) -> DataFrame:
    """``node, class``: the smallest node that links reach, for every node with a link."""
    ends = links.select("x", "y").union(links.select("y", "x")).toDF("a", "b").distinct()
    edges = written(ends, "class_edges")
    state = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("class")), "classes0")
    known, turn = None, 0
    while True:
        total = state.agg(F.sum(F.col("class").cast("decimal(38,0)"))).first()[0]
        if total == known:
            forget(edges)
            return state
        known, turn = total, turn + 1
        around = edges.join(state.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        pulled = state.join(around, "node").select("node", F.least("class", "near").alias("class"))
        jumped = pulled.join(state.toDF("class", "further"), "class", "left")
        before, state = state, written(jumped.select("node", F.least("class", "further").alias("class")), f"classes{turn}")
        forget(before)


def elements(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """``node, items``: the multiset of each wanted text as a set; the n-th use of a shingle is an item of its own."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = _lists(batch.column(1))
            for first, last in _spans(lengths):
                part = batch.slice(first, last - first)
                words, counts = _lists(part.column(1))
                rows, hashes, weights = bags(*shingles(words, counts))
                turn = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
                items = mixed(np.repeat(hashes, weights) + turn.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                total = np.bincount(rows, weights=weights, minlength=len(counts)).astype(np.int64)
                # Rows come in order but for those of few words.
                order = np.argsort(np.repeat(rows, weights), kind="stable")
                offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[order].view(np.int64)))], names=["node", "items"])

    few = nodes.count() <= BROADCAST_NODES
    texts = docs.select(F.xxhash64(whole_text(text)).alias("node"), whole_text(text).alias("text"))
    # Copies of a text leave each map task once.
    found = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return found.select("node", word_hashes(F.col("text")).alias("words")).mapInArrow(stage, "node bigint, items array<bigint>")


def shared_items(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all of ``two``, each flat items and lengths.

    A multiplication of 0/1 matrices, a tile of items at a time; sums are below 2 ** 24, so float32 is exact.
    """
    values = np.concatenate([one[0], two[0]])
    row = np.concatenate([np.repeat(np.arange(len(one[1])), one[1]), np.repeat(np.arange(len(two[1])), two[1])])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    total = np.zeros((len(one[1]), len(two[1])), np.int64)
    on = often[column]
    right = np.arange(len(values)) >= len(one[0])
    row, column, right = row[on], place[column[on]], right[on]
    order = np.argsort(column, kind="stable")
    row, column, right = row[order], column[order], right[order]
    for start in range(0, int(often.sum()), TILE_ITEMS):
        low, high = np.searchsorted(column, [start, start + TILE_ITEMS])
        r, c, side = row[low:high], column[low:high] - start, right[low:high]
        sides = [np.zeros((len(lengths), TILE_ITEMS), np.float32) for _, lengths in (one, two)]
        for dense, mask in zip(sides, (~side, side), strict=True):
            dense[r[mask], c[mask]] = 1
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of pairs that are enough to connect what all pairs connect."""
    parent: dict[int, int] = {}

    def top(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    keep = []
    for place, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(place)
    return np.array(keep, np.int64)


def family_links(members: DataFrame, docs: DataFrame, text: str, similarity: float) -> DataFrame:
    """``x, y``: links between different classes of a family, enough to connect its classes.

    ``members``: ``family, node, class``.  Texts of a family's largest class are known to be connected, so they
    meet the others only.  A family is cut into blocks; in a cell two blocks meet by one multiplication.
    """
    items = written(elements(docs, written(members.select("node").distinct(), "family_nodes"), text), "family_items", LONG_ROWS)
    sized = written(members.join(items.select("node", F.size("items").alias("size")), "node"), "family_members")
    kinds = sized.groupBy("family", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", "class", "size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_ITEMS), F.lit(1)).cast("int")
    plan = kinds.groupBy("family").agg(largest.alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).select(
        "family", F.col("most.class").alias("largest"), blocks(F.col("most.n"), F.col("most.size")).alias("tail"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("head"),
    )
    placed = sized.join(written(plan, "family_plan"), "family")
    inside = F.col("class") != F.col("largest")
    own = F.when(inside, F.pmod(F.xxhash64("node"), F.col("head"))).otherwise(F.col("head") + F.pmod(F.xxhash64("node"), F.col("tail"))).cast("int")
    others = F.sequence(F.lit(0), F.col("head") + F.when(inside, F.col("tail")).otherwise(0) - 1)
    spread = placed.select("family", "node", "class", own.alias("own"), F.explode(others).alias("other"))
    spread = spread.select("family", "node", "class", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, kind, own = (table.column(c).to_numpy() for c in ("node", "class", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        column = table.column("items").chunk(0)
        sides = []
        for block in (i, j):
            rows = np.flatnonzero(own == block)
            values, lengths = _lists(column.take(pa.array(rows)))
            sides.append((rows, values, lengths))
        (left, values, sizes), (right, values2, sizes2) = sides
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            shared = shared_items((values, sizes), (values2, sizes2))
            whole = sizes[:, None] + sizes2[None, :] - shared
            a, b = np.nonzero((shared / np.maximum(whole, 1) >= similarity) & (kind[left][:, None] != kind[right][None, :]))
            x, y = left[a], right[b]
            # One pair for two classes is enough, and of these as many as connect them.
            ends = np.stack([np.minimum(kind[x], kind[y]), np.maximum(kind[x], kind[y])], 1)
            ends, first = np.unique(ends, axis=0, return_index=True)
            keep = first[spanning(ends[:, 0], ends[:, 1])] if len(first) else first
            xs, ys = [np.minimum(node[x[keep]], node[y[keep]])], [np.maximum(node[x[keep]], node[y[keep]])]
        return pa.table({"x": pa.array(np.concatenate(xs)), "y": pa.array(np.concatenate(ys))})

    return spread.join(items, "node").groupBy("family", "i", "j").applyInArrow(cell, "x bigint, y bigint")


def links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``x, y``: verified pairs of texts, enough of them to connect every class.

    First every text is verified with its best pivots.  Buckets that then still hold different classes
    make families, whose texts of different classes are compared exactly.
    """
    nodes = written(sketches(docs, text), "sketches", LONG_ROWS)
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    # Another text of the bucket in each bucket, as nodes are mixed with the bucket's hash.
    pivots = buckets.groupBy("h").agg(F.min(F.col("node").bitwiseXOR(F.col("h"))).alias("m"), F.count("*").alias("n"))
    # Written, as a join with a plain table can split the rows of a large bucket.
    pivots = written(pivots.filter("n > 1").select("h", F.col("m").bitwiseXOR(F.col("h")).alias("pivot"), "n"), "pivots")
    shared = written(buckets.join(pivots, "h"), "shared_buckets")
    met = shared.filter("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    sig = nodes.select("node", "sig")
    compared = _equal_slots(met.join(sig.toDF("x", "sx"), "x").join(sig.toDF("y", "sy"), "y"))
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("equal"), "y"))
    ranked = written(compared.withColumn("r", best).filter(F.col("r") <= FIRST_PIVOTS), "pivot_pairs")
    first = written(verified(ranked, docs, text, similarity), "links1", LONG_ROWS)
    found = written(classes(first), "classes_of_pivots")
    # In a bucket of two, the pair with the pivot is all there is, but it may have been no best one.
    classed = shared.join(found, "node", "left").select("h", "node", F.coalesce("class", "node").alias("class"))
    mixed_h = classed.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("h", "low")
    open_rows = written(classed.join(written(mixed_h, "open_buckets"), "h").select("node", "class", "low").distinct(), "open_rows")
    tied = classes(open_rows.filter("class <> low").select(F.col("class").alias("x"), F.col("low").alias("y")).distinct())
    members = open_rows.select("node", "class").distinct().join(tied.toDF("class", "family"), "class").select("family", "node", "class")
    more = written(family_links(members, docs, text, similarity), "links2")
    forget(nodes, pivots, shared, ranked)
    return first.union(more)


def _classed(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """``row, key, node, class, class_id`` of every row."""
    found = classes(links(docs, text, similarity))
    rows = docs.select(as_row(docs), named(key).alias("key"), F.xxhash64(whole_text(text)).alias("node"))
    placed = rows.join(found, "node", "left").select("row", "key", "node", F.coalesce("class", "node").alias("class"))
    names = written(placed.groupBy("class").agg(F.min("key").alias("class_id")), "class_names")
    return placed.join(names, "class").select("row", "key", "node", "class", "class_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``key, node, class_id`` of every row; ``class_id`` is the smallest key of its class."""
    return _classed(docs, key, text, similarity).select(F.col("key").alias(key), "node", "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest key; rows without a key stay.

    Classes whose smallest keys are equal keep a row each.  Of the rows of a class that share its smallest
    key, the text with the smallest hash stays, and of equal texts the row whose other columns come first.
    """
    least = _classed(docs, key, text, similarity).filter(F.col("key").eqNullSafe(F.col("class_id")))
    texts = least.groupBy("class", "key", "node").agg(F.count("*").alias("times"))
    first = texts.filter(F.col("key").isNotNull()).groupBy("class").agg(F.min(F.struct("key", "node", "times")).alias("m")).select("m.*")
    kept = written(first.unionByName(texts.filter(F.col("key").isNull()).select("key", "node", F.lit(1).cast("bigint").alias("times"))), "kept_documents")
    rows = docs.select(as_row(docs), named(key).alias("key"), F.xxhash64(whole_text(text)).alias("node"))

    def among(some: DataFrame) -> DataFrame:
        return rows.join(some, rows["key"].eqNullSafe(some["key"]) & (rows["node"] == some["node"]), "left_semi")

    if kept.filter("times > 1").isEmpty():
        return among(kept).select("row.*")
    order = F.to_json(F.struct(named(text).isNull().alias("is_null"), F.struct(*[named(c) for c in docs.columns if c != text]).alias("others")), {"ignoreNullFields": "false"})
    repeated = docs.select(as_row(docs), named(key).alias("key"), F.xxhash64(whole_text(text)).alias("node"), order.alias("order"))
    twice = kept.filter("times > 1")
    repeated = repeated.join(twice, repeated["key"].eqNullSafe(twice["key"]) & (repeated["node"] == twice["node"]), "left_semi")
    once = repeated.groupBy("key", "node").agg(F.min_by("row", "order").alias("row"))
    return among(kept.filter("times = 1")).select("row.*").unionByName(once.select("row.*"))

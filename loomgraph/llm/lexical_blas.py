"""Ranked lexical search by dense blocked matrix multiplication.

Terms are the maximal runs of characters outside ASCII and of ASCII letters and digits, with
A to Z lower-cased.  A document's impact for a term is an integer,
``w * ((10**9 * tf) div (1000 * tf + 8 * m))``; the score of a document for an item is the sum
of the impacts of the item's terms, repeats included.

Items are searched in blocks.  A block's terms are its vocabulary; each document is reduced
to its vocabulary terms with their occurrences, written once.  The vocabulary is cut into
compact tiles: a tile of documents by vocabulary holds impacts, a tile of vocabulary by
items holds occurrences, and one multiplication in float64 (BLAS) scores the tile.  All entries
are integers, and tiles are cut so that no partial sum can reach 2 ** 53: every
product is exact, and partial sums are added as 64-bit integers.  A term that an item repeats so often that
one product could pass the bound gets several columns with a part of the repeats each.

Every task keeps, for each item, the best documents of its tiles: all that reach the k-th score
of a tile, ordered by score and id, cut at k.  So ties are decided by id alone, however tiles
and tasks are cut.  Tasks send at most k rows an item.

A null or empty text has no terms and is never found; it does not count as a document.
Items without terms, or none whose terms occur, have no rows.  Rows that repeat are found each, null ids
last.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import forget, named, whole_text, written
from loomgraph.llm.word_cache import blocks, chunks

ship_by_value(__name__)

#: Bytes that belong to terms, A to Z as a to z; all others part them.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
SATURATION = 10**9
#: Partial sums stay below this.
EXACT = 2**53
#: Items and terms of a block: its vocabulary goes to every task.
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 16
#: Terms of a vocabulary tile and documents of a document tile.
TILE_TERMS, TILE_DOCS = 2_048, 1_024
BATCH_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, term, times``: the terms of every item row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts: dict[bytes, int] = {}
                for term in terms(body):
                    counts[term] = counts.get(term, 0) + 1
                for at in range(0, len(counts), 10_000):
                    part = list(counts.items())[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item.as_py()] * len(part), item.type), pa.array([t for t, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64()),
                    ], names=["item", "term", "times"])

    schema = f"item {items.schema[key].dataType.simpleString()}, term binary, times bigint"
    rows = items.select(named(key).alias("item"), whole_text(text).alias("text")).mapInArrow(stage, schema)
    # Items whose rows repeat are one item with all their terms.
    return rows.groupBy("item", "term").agg(F.sum("times").alias("times"))


def document_terms(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``id, n, at, tf``: number of terms, and the occurrences of vocabulary terms by their places."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: n for n, term in enumerate(vocabulary)}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in chunks((len(t) for t in texts), BATCH_BYTES):
                many, ats, tfs = [], [], []
                for body in texts[first:last]:
                    number, known = 0, [np.zeros(0, np.int32)]
                    for part in blocks(body):
                        found = terms(part)
                        number += len(found)
                        known.append(np.fromiter((p for p in map(place.get, found) if p is not None), np.int32))
                    many.append(number)
                    at, tf = np.unique(np.concatenate(known), return_counts=True)
                    ats.append(at)
                    tfs.append(tf.astype(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in ats])]).astype(np.int32))
                flat = [np.concatenate([np.zeros(0, kind), *found]) for kind, found in ((np.int32, ats), (np.int64, tfs))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(many, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[0])), pa.ListArray.from_arrays(offsets, pa.array(flat[1])),
                ], names=["id", "n", "at", "tf"])

    return docs.select(named(key).cast("bigint").alias("id"), whole_text(text).alias("text")).mapInArrow(
        stage, "id bigint, n bigint, at array<int>, tf array<bigint>"
    )


def holders(found: DataFrame, many: int) -> DataFrame:
    """``at, df``: the documents that hold each vocabulary term."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for batch in batches:
            values, _ = flat_lists(batch.column(0))
            total += np.bincount(values, minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    return found.select("at").mapInArrow(stage, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("df"))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tiles(at: np.ndarray, item: np.ndarray, times: np.ndarray, most: np.ndarray, n_items: int, tile_terms: int = TILE_TERMS):
    """``columns, counts``: vocabulary places and the matrix (columns by items) of every tile.

    ``most`` bounds the impact of each place.  No sum of counts times bounds of a column of the matrix
    reaches ``EXACT``; counts above what one product may hold are dealt over several tiles.
    """
    pieces = []
    for place, who, count in zip(at.tolist(), item.tolist(), times.tolist(), strict=True):
        fit = max(1, (EXACT - 1) // max(1, int(most[place])))
        for turn in range(-(-count // fit)):
            pieces.append((turn, place, who, min(fit, count - turn * fit)))
    pieces.sort()
    columns: dict[int, int] = {}
    rows, sums, now = [], [0] * n_items, 0

    def tile():
        counts = np.zeros((len(columns), n_items))
        for column, who, count in rows:
            counts[column, who] = count
        return np.array(list(columns), np.int64), counts

    for turn, place, who, count in pieces:
        load = count * int(most[place])
        if rows and (turn != now or sums[who] + load >= EXACT or place not in columns and len(columns) >= tile_terms):
            yield tile()
            columns, rows, sums = {}, [], [0] * n_items
        now = turn
        rows.append((columns.setdefault(place, len(columns)), who, count))
        sums[who] += load
    if rows:
        yield tile()


def best_of(items: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of every item by score, then id."""
    order = np.lexsort((ids, -scores, items))
    items, scores, ids = items[order], scores[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, np.int64)
    place = np.arange(len(items)) - np.repeat(starts, np.diff(np.append(starts, len(items))))
    keep = place < k
    return items[keep], scores[keep], ids[keep]


def tile_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, scores and ids of the documents of a tile that may be among the ``k`` best: all ties with the k-th."""
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
    else:
        least = np.zeros(scores.shape[1], np.int64)
    doc, item = np.nonzero((scores >= least) & (scores > 0))
    return best_of(item, scores[doc, item], ids[doc], k)


def tile_scores(n: np.ndarray, at: np.ndarray, tf: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n_docs: int, total: int, parts) -> np.ndarray:
    """Scores (documents by items, 64-bit integers) of a tile of documents."""
    m = 100 - 75 + (75 * n * n_docs) // max(1, total)
    row = np.repeat(np.arange(len(n)), lengths)
    impact = weights[at] * ((SATURATION * tf) // (1000 * tf + 8 * m[row]))
    scores = None
    for columns, counts in parts:
        # The columns of this tile that some document of the tile holds.
        slot = np.full(len(weights), -1, np.int64)
        slot[columns] = np.arange(len(columns))
        here = slot[at]
        inside = np.flatnonzero(here >= 0)
        used, compact = np.unique(here[inside], return_inverse=True)
        dense = np.zeros((len(n), len(used)))
        dense[row[inside], compact] = impact[inside]
        part = (dense @ counts[used]).astype(np.int64)
        scores = part if scores is None else scores + part
    return scores


def _block(spark, docs: DataFrame, wanted: pd.DataFrame, k: int, key: str, text: str, tile_terms: int, tile_docs: int) -> DataFrame:
    vocabulary = sorted(set(wanted["term"]))
    place = {term: n for n, term in enumerate(vocabulary)}
    names = list(dict.fromkeys(wanted["item"].tolist()))
    number = {item: n for n, item in enumerate(names)}
    found = written(document_terms(docs, vocabulary, key, text), "document_terms")
    sums = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, total = sums["docs"], sums["terms"]
    df = np.zeros(len(vocabulary), np.int64)
    for row in holders(found, len(vocabulary)).collect():
        df[row["at"]] = row["df"]
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
    at, item = (np.array(x, np.int64) for x in ([place[t] for t in wanted["term"]], [number[i] for i in wanted["item"]]))
    times = wanted["times"].to_numpy(np.int64)
    held = df[at] > 0
    parts = (at[held], item[held], times[held], weights * (SATURATION // 1000))
    n_items = len(names)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = list(tiles(*parts, n_items, tile_terms))
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches if cut else ():
            for first in range(0, batch.num_rows, tile_docs):
                part = batch.slice(first, tile_docs)
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                places, lengths = flat_lists(part.column(2))
                scores = tile_scores(part.column(1).to_numpy(), places, flat_lists(part.column(3))[0], lengths, weights, n_docs, total, cut)
                best = best_of(*(np.concatenate(pair) for pair in zip(best, tile_best(scores, ids, k), strict=True)), k)
        yield pa.RecordBatch.from_arrays([
            pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2], mask=best[2] == NO_ID),
        ], names=["item", "score", "id"])

    rows = found.mapInArrow(stage, "item int, score bigint, id bigint")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = rows.withColumn("rank", first).filter(F.col("rank") <= k)
    # A block has few items; their names go back by number.
    known = spark.createDataFrame([(n, name) for n, name in enumerate(names)], f"item int, name {wanted.attrs['type']}")
    done = written(ranked.join(F.broadcast(known), "item").select(F.col("name").alias("item"), "rank", "id", "score"), "lexical_best")
    forget(found)
    return done


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, tile_terms: int = TILE_TERMS, tile_docs: int = TILE_DOCS,
) -> DataFrame:
    """``item_key, rank, key, score``: the ``k`` documents with the highest scores above 0 for every item."""
    spark = docs.sparkSession
    wanted = written(item_terms(items, item_key, item_text), "item_terms")
    kind = items.schema[item_key].dataType.simpleString()
    totals = wanted.agg(F.count_distinct(F.coalesce(F.xxhash64("item"), F.lit(0))).alias("items"), F.count("*").alias("terms")).first()
    many = max(1, -(-totals["items"] // block_items), -(-totals["terms"] // block_terms))
    found = None
    for block in range(many):
        part = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(many)) == block).sort("item", "term")
        rows = part.collect()
        if not rows:
            continue
        frame = pd.DataFrame({"item": [r["item"] for r in rows], "term": [bytes(r["term"]) for r in rows], "times": [r["times"] for r in rows]}, dtype=object)
        frame.attrs["type"] = kind
        more = _block(spark, docs, frame, k, key, text, tile_terms, tile_docs)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], f"item {kind}, rank int, id bigint, score bigint")
    return found.select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")

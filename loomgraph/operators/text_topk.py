"""Exact top-k by edit similarity, with few distances computed.

No edit script is shorter than the letters that one text has and the other lacks, so
letter counts bound the similarity of a pair from above at the price of some
subtractions.  The k pairs of a query with the highest bounds are computed first; the
k-th similarity found is what any other pair must be able to reach, and only pairs
whose bound does are computed after that.  The result is that of computing all.

Queries are taken in blocks of ``BLOCK``, whose letter counts and texts go to every task.
A text travels once, with the queries that it is to be compared with, and meets them all in one
pass over its letters: the columns of their edit tables lie side by side as bits of one integer
(Myers 1999, Hyyrö 2003).  Keys are unique; null keys and null
texts take no part; equal similarities go by the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.session import cut_lineage, widen

ship_by_value(__name__)

BLOCK = 512
#: Letters of texts that meet a single problem side by side; longer texts meet it alone.
BLOCK_CHARS = 1 << 17
DIGITS = 6
#: Characters counted one by one; all others are counted together.
COUNTED = "abcdefghijklmnopqrstuvwxyz .,"
_COUNTS = [f"c{i}" for i in range(len(COUNTED) + 1)]


def letter_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the length and the letter counts of every text, lower-cased as the similarity has it."""
    lowered = texts.select(F.col(key).alias("key"), F.lower(text).alias("t")).filter("key IS NOT NULL AND t IS NOT NULL")
    size = F.length("t")
    rest = F.length(F.translate("t", COUNTED, ""))
    each = [(size - F.length(F.translate("t", c, ""))).alias(name) for c, name in zip(COUNTED, _COUNTS)]
    return lowered.select("key", size.alias("size"), *each, rest.alias(_COUNTS[-1]))


def edit_similarity_bound(a: Column, b: Column) -> Column:
    """The most that the edit similarity of two texts can be: only letters of ``b`` that ``a`` has too can stay."""
    left, right = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(left), F.length(right))
    stay = F.least(F.length(left), F.length(right) - F.length(F.call_function("translate", right, left, F.lit(""))))
    return F.when(longest == 0, F.lit(1.0)).otherwise(stay / longest)


def _bound(left: str, right: str) -> Column:
    """The most that the similarity of two rows of letter counts can be."""
    def lacking(a: str, b: str) -> Column:
        return reduce(Column.__add__, [F.greatest(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(0)) for c in _COUNTS])

    longest = F.greatest(F.col(f"{left}.size"), F.col(f"{right}.size"))
    edits = F.greatest(lacking(left, right), lacking(right, left))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - edits / longest)


def _first(pairs: DataFrame, value: str, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc(value), "key")
    return pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)


def letter_places(text: str) -> dict[str, int]:
    """For every letter of a text the places where it stands, as bits."""
    places: dict[str, int] = {}
    for at, letter in enumerate(text):
        places[letter] = places.get(letter, 0) | 1 << at
    return places


def _edit_columns(text: str, equal: dict[str, int], first: int, every: int) -> tuple[int, int]:
    """Where the last columns of edit tables rise and fall, for tables side by side that ``text`` walks over.

    ``equal`` has the places of every letter, ``first`` the first place of every table and ``every`` all their places.
    """
    up, down, get = every, 0, equal.get
    for letter in text:
        same = get(letter, 0)
        x = same | down
        across = (((same & up) + up) ^ up) | same
        more = ((down | (every & ~(across | up))) << 1) | first
        less = (up & across) << 1
        up = (less & every) | (every & ~(x | more))
        down = more & x & every
    return up, down


def edits_to(text: str, queries: list[tuple[int, dict[str, int]]]) -> list[int]:
    """Edits between ``text`` and every query, given by its length and ``letter_places``."""
    equal: dict[str, int] = {}
    starts, at, first, every = [], 0, 0, 0
    for length, places in queries:
        starts.append(at)
        if length:
            first |= 1 << at
            every |= ((1 << length) - 1) << at
            for letter, bits in places.items():
                equal[letter] = equal.get(letter, 0) | bits << at
        # A bit between two queries takes what is carried out of the one below.
        at += length + 1
    up, down = _edit_columns(text, equal, first, every)
    found = []
    for (length, _), start in zip(queries, starts, strict=True):
        own = (1 << length) - 1
        found.append(len(text) + (up >> start & own).bit_count() - (down >> start & own).bit_count())
    return found


def edits_from(problem: str, texts: list[str]) -> list[int]:
    """Edits between ``problem`` and every text.

    Here the texts are the tables, so a step over a letter of the problem serves all of them.
    """
    found: list[int] = []
    begin = 0
    while begin < len(texts):
        end, held = begin + 1, len(texts[begin])
        while end < len(texts) and held + len(texts[end]) <= BLOCK_CHARS:
            held += len(texts[end])
            end += 1
        block = texts[begin:end]
        begin = end
        # A place between two texts, which equals no letter, takes what is carried out of the one before.
        codes = np.frombuffer(("\0".join(block) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in block])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        own = np.ones(len(codes), bool)
        own[ends] = False
        first = np.zeros(len(codes), bool)
        first[starts[lengths > 0]] = True
        equal = {letter: _as_bits((codes == ord(letter)) & own) for letter in set(problem)}
        up, down = _edit_columns(problem, equal, _as_bits(first), _as_bits(own))
        risen = np.cumsum(_from_bits(up, len(codes)).astype(np.int64) - _from_bits(down, len(codes)))
        # The places between texts are never set, so the sum at one is the sum at the end of its text.
        found += (len(problem) + np.diff(risen[ends], prepend=0)).tolist()
    return found


def _as_bits(places: np.ndarray) -> int:
    return int.from_bytes(np.packbits(places, bitorder="little").tobytes(), "little")


def _from_bits(bits: int, size: int) -> np.ndarray:
    held = bits.to_bytes(-(-size // 8), "little")
    return np.unpackbits(np.frombuffer(held, np.uint8), count=size, bitorder="little")


def edit_similarities(texts: DataFrame, problem: str | None, key: str, text: str = "text") -> DataFrame:
    """``key`` and the ``similarity`` of every text with ``problem``; null where either is null."""
    kind = texts.schema[key].dataType.simpleString()
    keyed = texts.select(F.col(key).alias("key"), F.lower(text).alias("row_text"))
    if problem is None:
        return keyed.select(F.col("key").alias(key), F.lit(None).cast("double").alias("similarity"))
    lowered = texts.sparkSession.range(1).select(F.lower(F.lit(problem))).first()[0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            edits = iter(edits_from(lowered, [row for row in rows if row is not None]))
            counted = [None if row is None else next(edits) for row in rows]
            longest = [None if row is None else max(len(row), len(lowered)) for row in rows]
            held = [batch.column(0), pa.array(counted, pa.int32()), pa.array(longest, pa.int32())]
            yield pa.RecordBatch.from_arrays(held, names=["key", "edits", "longest"])

    edits = keyed.mapInArrow(compare, f"key {kind}, edits int, longest int")
    found = F.when(F.col("longest") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("edits") / F.col("longest"))
    return edits.select(F.col("key").alias(key), found.alias("similarity"))


def edit_topk(queries: DataFrame, texts: DataFrame, k: int, query_key: str, key: str, text: str = "text") -> tuple[DataFrame, int]:
    """``query, key, similarity``, the ``k`` most similar texts of every query, and how many distances that took."""
    spark = texts.sparkSession
    counts = cut_lineage(letter_counts(widen(texts), key, text))
    asked = letter_counts(queries, query_key, text)
    asked = cut_lineage(asked.withColumn("block", F.floor((F.row_number().over(Window.orderBy("key")) - 1) / BLOCK)))
    left = queries.select(F.col(query_key).alias("query"), F.lower(text).alias("query_text"))
    right = texts.select(F.col(key).alias("key"), F.lower(text).alias("row_text"))
    kinds = {name: table.schema[name].dataType.simpleString() for name, table in (("query", left), ("key", right))}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def computed(pairs: DataFrame, block: DataFrame) -> DataFrame:
        # At most BLOCK texts.
        wanted = spark.sparkContext.broadcast({r[0]: r[1] for r in left.join(F.broadcast(block), "query", "left_semi").collect()})

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict = {}
            for frame in frames:
                out = []
                for row_key, row_text, found in zip(frame["key"], frame["row_text"], frame["queries"], strict=True):
                    found = list(found)
                    for query in found:
                        if query not in known:
                            known[query] = len(wanted.value[query]), letter_places(wanted.value[query])
                    for query, edits in zip(found, edits_to(row_text, [known[q] for q in found]), strict=True):
                        out.append((query, row_key, edits, max(len(row_text), known[query][0])))
                yield pd.DataFrame(out, columns=["query", "key", "edits", "longest"])

        held = pairs.groupBy("key").agg(F.collect_list("query").alias("queries")).join(right, "key")
        # Long texts may sit together; a comparison is far dearer than moving its row.
        spread = held.repartition(parts, F.xxhash64("key")).select("key", "row_text", "queries")
        edits = spread.mapInPandas(compare, f"query {kinds['query']}, key {kinds['key']}, edits int, longest int")
        found = F.when(F.col("longest") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("edits") / F.col("longest"))
        return cut_lineage(edits.select("query", "key", F.round(found, DIGITS).alias("similarity")))

    results, distances = [], 0
    for number in sorted(r.block for r in asked.select("block").distinct().collect()):
        block = asked.filter(F.col("block") == number)
        met = counts.alias("d").join(F.broadcast(block).alias("q"), F.lit(True))
        names = block.select(F.col("key").alias("query"))
        # Every pair has a bound, so bounds are computed twice rather than kept.
        bounds = met.select(F.col("q.key").alias("query"), F.col("d.key").alias("key"), _bound("q", "d").alias("bound"))
        begun = cut_lineage(_first(bounds, "bound", k).select("query", "key"))
        first = computed(begun, names)
        least = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-1.0).alias("least"))
        # Similarities are rounded, so a bound may lie below one by half a digit.
        able = bounds.join(F.broadcast(least), "query").filter(F.col("bound") + 10.0**-DIGITS >= F.col("least"))
        rest = computed(able.join(F.broadcast(begun), ["query", "key"], "left_anti").select("query", "key"), names)
        both = first.unionAll(rest)
        distances += both.count()
        results.append(cut_lineage(_first(both, "similarity", k).select("query", "key", "similarity")))
    if not results:
        return left.limit(0).join(right.limit(0), F.lit(True)).select("query", "key", F.lit(0.0).alias("similarity")), 0
    return reduce(DataFrame.unionAll, results), distances

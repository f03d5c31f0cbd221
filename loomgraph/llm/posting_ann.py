"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors get one more coordinate so that the largest inner product becomes the
smallest distance.  Centroids are fitted on a bounded sample and split until each
holds a like share of it.  A vector enters the list of its nearest centroid and of
every other that is nearly as near (``BOUNDARY``), up to ``MOST_COPIES`` lists.  The
centroids form a graph in memory; a best-first walk finds those near a vector.  A
query reads the lists whose centroids are within ``PROBE`` times the distance of the
nearest one, and the ``LEAST_LISTS`` nearest.  Lists are cut into blocks of bounded size, so a dense region is many
tasks, and every score is exact.

Equal vectors are indexed once, with the ``k + 1`` smallest of their ids, which is all
that any result can hold of them.  A first pass over a query's nearest lists gives a
score that later candidates must reach.

Vectors that are null, zero, or hold null or non-finite components take no part;
neither do those of another length than the most frequent one (the smaller of equally
frequent ones).  Rows that repeat an id count once.  With fewer candidates than ``k``
all are returned, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import written

ship_by_value(__name__)

K = 20
#: Vectors per list, the most lists there are (a table of so many rows may be broadcast), and the sample for each.
LIST_VECTORS, MOST_LISTS, SAMPLE_PER_LIST = 200, 4_096, 32
BOUNDARY, MOST_COPIES = 0.08, 4
PROBE = 0.25
#: Lists that a query reads in any case, as the nearest centroid may be next to it.
LEAST_LISTS = 24
#: Vectors and queries that meet in one step.
BLOCK_VECTORS, BLOCK_QUERIES = 2_048, 2_048
#: Lists of the first pass.
FIRST_LISTS = 4
NEIGHBOURS, ROUNDS = 24, 6

_PROBES = "key bigint, list int, place int"


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T
    return np.maximum(found, 0)


#: Distances that the driver holds at once when it fits centroids.
FIT_DISTANCES = 1 << 21


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of every point, some points at a time."""
    step = max(1, FIT_DISTANCES // len(centres))
    return np.concatenate([squared_distances(points[at : at + step], centres).argmin(1) for at in range(0, len(points), step)])


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of clusters of which none holds over twice its share of the sample."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    most = max(2, 2 * len(sample) // lists)
    done, open_sets = [], [(np.arange(len(sample)), lists)]
    while open_sets:
        rows, parts = open_sets.pop()
        points = sample[rows]
        if parts <= 1 and len(rows) <= most:
            done.append(points.mean(0))
            continue
        parts = max(2, parts)
        centres = points[rng.choice(len(points), min(parts, len(points)), replace=False)]
        for _ in range(ROUNDS):
            near = nearest_centres(points, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            counts = np.bincount(near, minlength=len(centres))
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        near = nearest_centres(points, centres)
        groups = [rows[near == c] for c in range(len(centres))]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:
            # Points that cannot be told apart are divided as they come.
            done += [points.mean(0)]
            continue
        open_sets += [(g, 1 if len(g) <= most else -(-2 * len(g) // most)) for g in groups]
    return np.array(done)


class CentroidGraph:
    """A nearest-neighbour graph over the centroids and best-first walks on it."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        n = len(centres)
        width = min(NEIGHBOURS, n)
        order = [squared_distances(centres[a : a + 256], centres).argsort(1)[:, :width] for a in range(0, n, 256)]
        # A ring keeps the graph in one piece.
        ring = (np.arange(n)[:, None] + 1) % n
        self.links = np.hstack([np.vstack(order), ring])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, max(8, int(n**0.5)))).astype(int))

    def near(self, points: np.ndarray, ratio: float, least: int = 1) -> np.ndarray:
        """Distances to the centroids found, infinite elsewhere.

        Walks end ``ratio`` beyond the nearest, but not before the ``least`` nearest are settled.
        """
        many, n = len(points), len(self.centres)
        found = np.full((many, n), np.inf)
        found[:, self.entries] = np.sqrt(squared_distances(points, self.centres[self.entries]))
        waiting = found.copy()
        active = np.arange(many)
        while len(active):
            nodes = waiting[active].argmin(1)
            away = waiting[active, nodes]
            known = found[active]
            bound = np.maximum((1 + ratio) * known.min(1), np.partition(known, min(least, n) - 1, 1)[:, min(least, n) - 1])
            going = (away <= bound) & np.isfinite(away)
            active, nodes = active[going], nodes[going]
            if not len(active):
                break
            waiting[active, nodes] = np.inf
            links = self.links[nodes]
            gaps = points[active][:, None, :] - self.centres[links]
            reach = np.sqrt(np.einsum("qld,qld->ql", gaps, gaps))
            fresh = np.isinf(found[active[:, None], links])
            rows = np.broadcast_to(active[:, None], links.shape)[fresh]
            found[rows, links[fresh]] = reach[fresh]
            waiting[rows, links[fresh]] = reach[fresh]
        return found


def distinct_vectors(table: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``key, vec, ids`` of every different vector (``key`` its smallest id), and ``vec_id, key`` of every row."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(key).cast("bigint").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(vec, lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    rows = rows.filter(F.size("vec") == F.lit(common.d if common else 0))
    hashed = rows.withColumn("h", F.xxhash64("vec"))
    ranked = hashed.dropDuplicates(["h", "vec", "vec_id"]).withColumn("r", F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id")))
    groups = ranked.filter(F.col("r") <= k + 1).groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = written(groups.select(F.col("ids")[0].alias("key"), "vec", "ids", "h"), "distinct_vectors")
    keys = groups.select("h", F.col("vec").alias("gvec"), "key")
    members = hashed.join(keys, (hashed.h == keys.h) & (hashed.vec == keys.gvec)).select("vec_id", "key").distinct()
    return groups.drop("h"), members


def _augmented(vecs: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, largest - (vecs * vecs).sum(1)))
    return np.hstack([vecs, rest[:, None]])


def fit(groups: DataFrame, n: int, largest: float) -> CentroidGraph:
    """The graph of centroids from a sample of at most ``MOST_LISTS * SAMPLE_PER_LIST`` vectors."""
    lists = max(1, min(MOST_LISTS, n // LIST_VECTORS))
    size = lists * SAMPLE_PER_LIST
    sample = groups.orderBy(F.xxhash64("key"), "key").limit(size).select("vec").toArrow()["vec"].combine_chunks()
    points = sample.flatten().to_numpy().reshape(len(sample), -1)
    return CentroidGraph(balanced_centroids(_augmented(points, largest), lists))


def _places(rows: DataFrame, graph: CentroidGraph, largest: float | None, ratio: float, most: int | None = None, least: int = 1) -> DataFrame:
    """The lists of every ``key, vec``: all within ``ratio`` of the nearest and the ``least`` nearest, ``most`` at most if given."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                vecs = np.stack(part["vec"].to_list()).astype(float)
                # A query's extra coordinate is zero.
                points = np.hstack([vecs, np.zeros((len(vecs), 1))]) if largest is None else _augmented(vecs, largest)
                away = graph.near(points, ratio, least)
                order = away.argsort(1, kind="stable")
                near = np.take_along_axis(away, order, 1)
                kept = near <= (1 + ratio) * near[:, :1]
                kept[:, :least] = np.isfinite(near[:, :least])
                if most:
                    kept[:, most:] = False
                rows, places = np.nonzero(kept)
                yield pd.DataFrame({"key": part["key"].to_numpy()[rows], "list": order[rows, places].astype("int32"), "place": places.astype("int32")})

    return rows.select("key", "vec").mapInPandas(stage, _PROBES)


_SCORES = "query bigint, key bigint, score double"


def _meet(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Per cell of a list, the best ``k + 1`` vectors of every query that reach the query's ``least``."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        right = right.sort_values("key")
        scores = np.stack(left["vec"].to_list()).astype(float) @ np.stack(right["vec"].to_list()).astype(float).T
        order = (-scores).argsort(1, kind="stable")[:, : k + 1]
        best = np.take_along_axis(scores, order, 1)
        rows, places = np.nonzero(best >= left["least"].to_numpy(float)[:, None])
        return pd.DataFrame({"query": left["key"].to_numpy()[rows], "key": right["key"].to_numpy()[order[rows, places]], "score": best[rows, places]})

    cells = ["list", "block", "qblock"]
    # New names for the columns, as both sides come from the same table.
    queries, index = queries.toDF(*queries.columns), index.toDF(*index.columns)
    return queries.groupBy(*cells).cogroup(index.groupBy(*cells)).applyInPandas(cell, _SCORES)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k + 1`` different vectors of every query."""
    once = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)


def nearest(table: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other rows of every row whose id ``is_query`` accepts."""
    groups, members = distinct_vectors(table, key, vector, k)
    norm = F.aggregate("vec", F.lit(0.0), lambda held, x: held + x * x)
    about = groups.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    if not about.n:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    graph = fit(groups, about.n, about.largest)
    asked = written(members.filter(is_query(F.col("vec_id"))), "asked_vectors")
    queries = groups.join(asked.select("key").distinct(), "key", "left_semi")
    placed = written(_places(groups, graph, about.largest, BOUNDARY, MOST_COPIES).drop("place"), "placed_vectors")
    probes = written(_places(queries, graph, None, PROBE, least=LEAST_LISTS), "probes")
    # One row per list, of which there are MOST_LISTS at most.
    held = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    asking = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qblocks"))
    lists = F.broadcast(written(held.join(asking, "list"), "list_blocks"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    split = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    index = placed.join(lists, "list").join(groups.select("key", "vec"), "key").select(
        "key", "vec", "list", split("blocks").alias("block"), spread("qblocks").alias("qblock")
    )
    reads = probes.join(lists, "list").join(groups.select("key", "vec"), "key").select(
        "key", "vec", "list", "place", spread("blocks").alias("block"), split("qblocks").alias("qblock")
    )
    first = reads.filter(F.col("place") < FIRST_LISTS).withColumn("least", F.lit(float("-inf")))
    begun = written(_best(_meet(first.drop("place"), index, k), k), "first_lists")
    reached = begun.filter(F.col("r") == k + 1).select(F.col("query").alias("key"), F.col("score").alias("least"))
    later = reads.filter(F.col("place") >= FIRST_LISTS).join(reached, "key", "left").fillna(float("-inf"), ["least"])
    best = _best(begun.select("query", "key", "score").unionByName(_meet(later.drop("place"), index, k)), k).drop("r")
    ids = groups.select("key", F.explode("ids").alias("vec_id"))
    found = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(best, "query").join(ids, "key")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

"""Shortest paths as rounds of frontier joins.

Distances are whole units, tenths for the published weights, so sums are exact and
every engine that adds them agrees.  One round joins the nearest nodes that are still
open with their outgoing edges and keeps the minimum per target.  The range of distances
taken at once is no wider than the lightest edge, unless that is far below the others,
so an edge is followed once and not again whenever a way to its source gets shorter.
The state after each round is written, and the one before deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators.lookups import BROADCAST_ROWS, heavy_keys, repeat_rows, spread_rows
from loomgraph.session import bucketed, cut_lineage, discard, planned_bytes, stored


#: Bytes of stored arcs that one pass of their layout by source shuffles; as shuffled they are several times as large.
PASS_BYTES = 4 << 30
#: Units of the finest weights, per 1.0.
FINE = 1_000_000


@dataclass(frozen=True)
class Weights:
    """Edge weights per type in whole units, ``scale`` of them per 1.0; ``uniform`` charges the default for every
    edge, which is what edges stored without a single type cost."""

    tenths: tuple[tuple[str, int], ...] = tuple(model.EDGE_WEIGHT_TENTHS.items())
    default: int = model.DEFAULT_WEIGHT_TENTHS
    uniform: bool = False
    scale: int = 10

    def updated(self, new: dict[str, float]) -> Weights:
        """Other weights for some types; units become millionths where tenths cannot hold them."""
        fine = self.scale == FINE or any(abs(w * self.scale - round(w * self.scale)) > 1e-9 for w in new.values())
        scale = FINE if fine else self.scale
        table = {kind: w * (scale // self.scale) for kind, w in self.tenths}
        default = self.default * (scale // self.scale)
        for kind, weight in new.items():
            units = round(weight * scale)
            if units <= 0:
                raise ValueError(f"weight {weight} of {kind} is not above zero")
            if kind == "default":
                default = units
            else:
                table[kind] = units
        return Weights(tuple(table.items()), default, self.uniform, scale)

    def as_dict(self) -> dict[str, float]:
        return {**{k: v / self.scale for k, v in self.tenths}, "default": self.default / self.scale}

    def units(self, distance: float) -> int:
        """The most units within a distance."""
        return int(distance * self.scale + 1e-9)

    def distance(self, units: Column) -> Column:
        return F.coalesce(units / F.lit(float(self.scale)), F.lit(float("inf")))

    @property
    def lightest(self) -> int:
        """No edge weighs less."""
        return self.default if self.uniform else min([self.default, *(w for _, w in self.tenths)])

    def column(self, edge_type: Column) -> Column:
        if self.uniform or not self.tenths:
            return F.lit(self.default)
        pairs = [F.lit(x) for kind, weight in self.tenths for x in (kind, weight)]
        return F.coalesce(F.create_map(*pairs)[edge_type], F.lit(self.default))


HOPS = Weights(tenths=(), default=1, scale=1)


class Arcs:
    """``src, dst, w`` for repeated joins on ``src``; a pair may have several rows, of which the lightest counts.

    ``lightest`` is no more than any ``w``; ``width`` is the range of distances that a search takes at once.
    """

    def __init__(self, rows: DataFrame, lightest: int = 0, width: int = 1):
        self.rows = rows
        self.lightest = lightest
        self.width = max(lightest, width, 1)
        self._placed: tuple[DataFrame, DataFrame] | None = None

    def reversed(self) -> Arcs:
        return Arcs(self.rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), self.lightest, self.width)

    def leaving(self, frontier: DataFrame, count: int) -> DataFrame:
        """Arcs whose ``src`` is in ``frontier``, which has ``count`` rows.

        A small frontier is broadcast.  The first large one lays the arcs out in
        buckets by source, the arcs of a hub over several; from then on a round
        shuffles the frontier alone.
        """
        if count <= BROADCAST_ROWS:
            return self.rows.join(F.broadcast(frontier), "src")
        if self._placed is None:
            heavy = cut_lineage(heavy_keys(self.rows, ["src"]))
            spread = spread_rows(self.rows, heavy, ["src"], F.xxhash64("dst"))
            self._placed = bucketed(spread, ["src", "_salt"], -(-planned_bytes(self.rows) // PASS_BYTES)), heavy
        placed, heavy = self._placed
        return placed.join(repeat_rows(frontier, heavy, ["src"]), ["src", "_salt"])


def prepare(edges: DataFrame, weights: Weights = Weights(), directed: bool = True) -> Arcs:
    """The weighted edges, written once as they come; both ways of an edge are read from one row."""
    kind = F.col("type") if "type" in edges.columns else F.lit(None).cast("string")
    rows = stored(edges.select("src", "dst", weights.column(kind).cast("bigint").alias("w")).filter("src <> dst"))
    if not directed:
        rows = rows.unionAll(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return Arcs(rows, weights.lightest, weights.default // 2)


def search(
    arcs: Arcs,
    seeds: DataFrame,
    cutoff: int | None = None,
    target: str | None = None,
    parents: bool = True,
    enough: Callable[[DataFrame, int | None], bool] | None = None,
) -> DataFrame:
    """Distances from ``seeds(id, dist, parent)`` as ``id, dist, parent``.

    ``parent`` is the smallest id among the predecessors that lie on a shortest
    path; without ``parents`` it is left out.  With a ``target`` the search stops once
    nothing shorter can reach it.  ``enough(state, before)`` is asked before every round and may
    end the search: rows of ``state`` with ``dist < before`` will not change, and all others, found or not,
    end at ``before`` or further.  ``before`` is ``None`` when nothing is left to do.
    """
    value = ["dist", "parent"] if parents else ["dist"]

    def lowest(rows: DataFrame) -> DataFrame:
        # Half units tell a distance whose arcs were followed from the same distance found again.
        keyed = rows.withColumn("_key", F.col("dist") * 2 + F.when(F.col("done"), 0).otherwise(1))
        best = [F.min(F.struct(*value)).alias("_best")] if parents else []
        found = keyed.groupBy("id").agg(F.min("_key").alias("_key"), *best)
        return found.select(
            "id", F.floor(F.col("_key") / 2).cast("bigint").alias("dist"), *(["_best.parent"] if parents else []), (F.col("_key") % 2 == 0).alias("done"),
        )

    state = stored(lowest(seeds.select("id", F.col("dist").cast("bigint").alias("dist"), "parent", F.lit(False).alias("done")).select("id", *value, "done")))
    while True:
        open_ = F.col("done") == F.lit(False)
        probe = F.max(F.when(F.col("id") == F.lit(target), F.col("dist"))) if target else F.lit(None).cast("bigint")
        least, reached = state.agg(F.min(F.when(open_, F.col("dist"))), probe).first()
        before = None if least is None else least + arcs.lightest
        if enough is not None and enough(state, before):
            break
        # A distance below ``before`` is final, and so are the nodes on the way to it.
        if least is None or reached is not None and (reached < before or reached <= least):
            break
        limit = min(x for x in (cutoff, reached, 2**61) if x is not None)
        now = open_ & (F.col("dist") < least + arcs.width)
        frontier = state.filter(now)
        step = arcs.leaving(frontier.select(F.col("id").alias("src"), F.col("dist").alias("d")), frontier.count())
        found = step.select(
            F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("dist"), F.col("src").alias("parent"), F.lit(False).alias("done"),
        ).filter(F.col("dist") <= limit)
        merged = lowest(state.withColumn("done", F.col("done") | now).unionAll(found.select(*state.columns)))
        last, state = state, stored(merged)
        discard(last)
    return state.select("id", *value)


def seed(nodes: DataFrame, source: str) -> DataFrame:
    """The start row; empty when the source is not a node."""
    return nodes.filter(F.col("id") == source).limit(1).select(
        "id", F.lit(0).alias("dist"), F.lit(None).cast("string").alias("parent")
    )


def distances_from(
    nodes: DataFrame, edges: DataFrame, source: str, max_distance: float = model.MAX_PATH_LENGTH,
    weights: Weights = Weights(), directed: bool = True,
) -> DataFrame:
    """``id, distance`` of every node within ``max_distance``."""
    found = search(prepare(edges, weights, directed), seed(nodes, source), cutoff=weights.units(max_distance), parents=False)
    return found.select("id", weights.distance(F.col("dist")).alias("distance"))


def within_distance(nodes, edges, source, max_distance, weights=Weights(), directed=True) -> DataFrame:
    return distances_from(nodes, edges, source, max_distance, weights, directed).filter(
        F.col("distance") <= max_distance
    )


def trace(found: DataFrame, targets: list[str]) -> dict[str, list[str]]:
    """Paths to a few targets (a top-k), read back one hop per pass over the search state."""
    parents: dict[str, str | None] = {}
    pending = set(targets)
    while pending:
        rows = found.filter(F.col("id").isin(sorted(pending))).select("id", "parent").collect()
        parents.update({r.id: r.parent for r in rows})
        pending = {r.parent for r in rows if r.parent is not None} - set(parents)
    traced = {}
    for target in targets:
        if target in parents:
            walk = [target]
            while parents.get(walk[0]) is not None:
                walk.insert(0, parents[walk[0]])
            traced[target] = walk
    return traced


def walks(found: DataFrame) -> DataFrame:
    """``id, dist, path`` for every reached node, from the state of a search.

    Pointers double: each node holds the way from a node above it, and takes that node's way in front of its
    own, so a round halves the hops that are left.
    """
    up = cut_lineage(found.select("id", "dist", F.col("parent").alias("top"), F.array("id").alias("path")))
    while not up.filter("top IS NOT NULL").isEmpty():
        above = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("front"))
        longer = up.filter("top IS NOT NULL").join(above, "top").select("id", "dist", F.col("next").alias("top"), F.concat("front", "path").alias("path"))
        up = cut_lineage(up.filter("top IS NULL").unionByName(longer))
    return up.select("id", "dist", "path")


def all_shortest_paths(
    nodes: DataFrame, edges: DataFrame, source: str, max_distance: float = model.MAX_PATH_LENGTH,
    weights: Weights = Weights(), directed: bool = True,
) -> DataFrame:
    """``id, distance, path`` of every node within ``max_distance``, one path each."""
    found = walks(search(prepare(edges, weights, directed), seed(nodes, source), cutoff=weights.units(max_distance)))
    return found.select("id", weights.distance(F.col("dist")).alias("distance"), "path")


def shortest_path(
    nodes: DataFrame, edges: DataFrame, source: str, target: str,
    weights: Weights = Weights(), directed: bool = True,
) -> DataFrame:
    """One row ``source, target, distance, path``; infinity and no path when unreachable."""
    found = search(prepare(edges, weights, directed), seed(nodes, source), target=target)
    ends = nodes.sparkSession.createDataFrame([(source, target)], "source string, target string")
    way = walks(found).filter(F.col("id") == target).select(F.col("id").alias("target"), "dist", "path")
    return ends.join(way, "target", "left").select(
        "source", "target", weights.distance(F.col("dist")).alias("distance"), F.coalesce("path", F.array().cast("array<string>")).alias("path"),
    )


def shortest_hops(nodes: DataFrame, edges: DataFrame, source: str, target: str, directed: bool = True) -> DataFrame:
    """Unweighted variant: ``distance`` is the number of edges."""
    return shortest_path(nodes, edges, source, target, HOPS, directed)


def distance_between(
    nodes: DataFrame, edges: DataFrame, source: str, target: str, weights: Weights = Weights(), directed: bool = True,
) -> DataFrame:
    """One row ``source, target, distance, reached`` by a search from both ends; infinity when there is no way.

    The side with the smaller frontier takes the next round.  A shortest path of fewest edges that is not found
    yet crosses both frontiers and at least one more edge, so the search ends when the sum of the least distances on
    the frontiers and of the lightest edge is no less than the best meeting.  ``reached`` counts the rows of both sides.
    """
    spark = nodes.sparkSession
    arcs = prepare(edges, weights, directed)
    back = arcs.reversed()
    lightest = arcs.rows.agg(F.coalesce(F.min("w"), F.lit(0))).first()[0]
    ways = [arcs, back]
    states = [cut_lineage(seed(nodes, end).select("id", F.col("dist").cast("bigint").alias("dist"), F.lit(0).alias("round"))) for end in (source, target)]
    open_ = [state.agg(F.count("*"), F.min("dist")).first() for state in states]
    rounds, best = [0, 0], 0 if source == target and open_[0][0] else None
    while all(rows for rows, _ in open_):
        if best is not None and open_[0][1] + open_[1][1] + lightest >= best:
            break
        side = 0 if open_[0][0] <= open_[1][0] else 1
        active = states[side].filter(F.col("round") == rounds[side])
        rounds[side] += 1
        step = ways[side].leaving(active.select(F.col("id").alias("src"), F.col("dist").alias("d")), open_[side][0])
        found = step.select(F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("dist"), F.lit(rounds[side]).alias("round"))
        if best is not None:
            found = found.filter(F.col("dist") < best)
        merged = states[side].unionAll(found).groupBy("id").agg(F.min(F.struct("dist", "round")).alias("best"))
        states[side] = cut_lineage(merged.select("id", "best.*"))
        fresh = states[side].filter(F.col("round") == rounds[side])
        other = states[1 - side].select("id", F.col("dist").alias("rest"))
        met = fresh.join(other, "id").agg(F.min(F.col("dist") + F.col("rest"))).first()[0]
        best = min((x for x in (best, met) if x is not None), default=None)
        for end in (0, 1):
            of_use = F.col("round") == rounds[end]
            if best is not None:
                of_use = of_use & (F.col("dist") < best)
            open_[end] = states[end].filter(of_use).agg(F.count("*"), F.min("dist")).first()
    reached = sum(state.count() for state in states)
    ends = spark.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(best).cast("bigint").alias("dist"))
    return ends.select("source", "target", weights.distance(F.col("dist")).alias("distance"), F.lit(reached).cast("bigint").alias("reached"))


def _source_reach(arcs: Arcs, nodes: DataFrame, source: str, target: str) -> DataFrame | None:
    """``id`` of all that ``source`` reaches, or nothing if all that reaches ``target`` is found with smaller rounds.

    Both sides grow, the one with fewer nodes first, until one has all of its nodes.
    """
    ways = [arcs, arcs.reversed()]
    states = [cut_lineage(seed(nodes, end).select("id", F.lit(True).alias("fresh"))) for end in (source, target)]
    found = [state.count() for state in states]
    fresh = list(found)
    while all(fresh):
        side = 0 if found[0] <= found[1] else 1
        step = ways[side].leaving(states[side].filter("fresh").select(F.col("id").alias("src")), fresh[side])
        rows = states[side].withColumn("fresh", F.lit(False)).unionAll(step.select(F.col("dst").alias("id"), F.lit(True).alias("fresh")))
        # A node is fresh if all its rows are.
        states[side] = cut_lineage(rows.groupBy("id").agg(F.min("fresh").alias("fresh")))
        found[side], fresh[side] = states[side].agg(F.count("*"), F.count_if("fresh")).first()
    return states[0].select("id") if not fresh[0] else None


def k_shortest_paths(
    nodes: DataFrame, edges: DataFrame, source: str, target: str, k: int = 3, weights: Weights = Weights(), directed: bool = True,
    published: bool = False,
) -> DataFrame:
    """``source, target, distance, path`` of the ``k`` shortest paths without a repeated node, the shortest first.

    Paths of equal length come by their nodes.  A search from the target gives every node's distance to
    it.  Then partial paths grow from the source, those first whose length plus the distance left is
    least, until nothing that is left can be among the first ``k``; so paths are exact, and none
    that could not end in time is followed.  ``published``: at most the shortest one.
    """
    if published or k < 2:
        found = shortest_path(nodes, edges, source, target, weights, directed)
        return found.filter(F.size("path") > 0).limit(min(k, 1))
    spark = nodes.sparkSession
    arcs = prepare(edges, weights, directed)
    reach = _source_reach(arcs, nodes, source, target)
    if reach is not None:
        # No path leaves what the source reaches.
        inner = stored(arcs.leaving(reach.withColumnRenamed("id", "src"), reach.count()).select("src", "dst", "w"))
        arcs = Arcs(inner, arcs.lightest, arcs.width)
    left = search(arcs.reversed(), seed(nodes, target), parents=False).select("id", F.col("dist").alias("left"))
    shape = "id string, dist bigint, path array<string>, least bigint"
    open_ = left.filter(F.col("id") == source).select(
        "id", F.lit(0).cast("bigint").alias("dist"), F.array("id").alias("path"), F.col("left").alias("least")
    )
    done = spark.createDataFrame([], shape)
    if source == target:
        open_, done = done, open_
    else:
        open_ = open_.join(nodes.filter(F.col("id") == source).select("id").distinct(), "id", "left_semi")
    open_, last = cut_lineage(open_), None
    while True:
        least, many = open_.agg(F.min("least"), F.count("*")).first()
        if not many or last is not None and least > last:
            break
        now = open_.filter(F.col("least") <= least)
        step = arcs.leaving(now.select(F.col("id").alias("src"), "dist", "path"), many)
        lightest = step.groupBy("path", "dst", "dist").agg(F.min("w").alias("w"))
        grown = lightest.filter(~F.array_contains("path", F.col("dst"))).select(
            F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.concat("path", F.array("dst")).alias("path")
        )
        grown = cut_lineage(grown.join(left, "id").select("id", "dist", "path", (F.col("dist") + F.col("left")).alias("least")))
        done = cut_lineage(done.unionByName(grown.filter(F.col("id") == target)).orderBy("dist", "path").limit(k))
        ends, most = done.agg(F.count("*"), F.max("dist")).first()
        last = most if ends == k else None
        open_ = open_.filter(F.col("least") > least).unionByName(grown.filter(F.col("id") != target))
        open_ = cut_lineage(open_ if last is None else open_.filter(F.col("least") <= last))
    return done.select(F.lit(source).alias("source"), F.lit(target).alias("target"), weights.distance(F.col("dist")).alias("distance"), "path")


def path_info(
    paths: DataFrame, nodes: DataFrame, edges: DataFrame, weights: Weights = Weights(), directed: bool = True,
    few_paths: bool = False,
) -> DataFrame:
    """Add ``length`` (nodes on the path), ``total_weight``, ``edges`` and ``node_types``
    to rows of ``id, path``.

    ``few_paths`` says that the caller bounds the paths, as a top-k does; their
    steps are then broadcast and the graph is filtered in place.
    """
    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few_paths else df

    steps = paths.select("id", F.posexplode("path").alias("pos", "node"), "path").select(
        "id", "pos", "node", F.get("path", F.col("pos") + 1).alias("next")
    )
    types = nodes.select(F.col("id").alias("node"), F.coalesce("type", F.lit("unknown")).alias("node_type"))
    types = types.join(small(steps.select("node").distinct()), "node", "left_semi")
    typed = edges.select(
        F.col("src").alias("node"), F.col("dst").alias("next"), "type", weights.column(F.col("type")).alias("w")
    )
    if not directed:
        flipped = typed.select(F.col("next").alias("node"), F.col("node").alias("next"), "type", "w")
        typed = reduce(DataFrame.unionAll, [typed, flipped])
    # Keep only edges on the paths before choosing the lightest type of each pair.
    wanted = steps.filter("next IS NOT NULL").select("node", "next").distinct()
    lightest = (
        typed.join(small(wanted), ["node", "next"], "left_semi")
        .groupBy("node", "next")
        .agg(F.min(F.struct("w", "type")).alias("edge"))
    )
    virtual = F.when(F.col("edge.type") == "VIRTUAL_MENTIONS", F.col("edge.type")).otherwise("unknown")
    shown_type = virtual if weights.uniform else F.col("edge.type")
    rows = (
        steps.join(types, "node", "left")
        .join(lightest, ["node", "next"], "left")
        .select(
            "id",
            F.struct(
                "pos", "node_type",
                F.when(
                    F.col("edge").isNotNull(),
                    F.struct(
                        F.col("node").alias("source"), F.col("next").alias("target"),
                        shown_type.alias("type"), (F.col("edge.w") / F.lit(float(weights.scale))).alias("weight"),
                    ),
                ).alias("edge"),
                F.col("edge.w").cast("bigint").alias("units"),
            ).alias("step"),
        )
    )
    # A path has few nodes, so the list stays small.
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return gathered.select(
        "id",
        F.size("steps").alias("length"),
        (F.aggregate("steps", F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(s["units"], F.lit(0))) / F.lit(float(weights.scale))).alias(
            "total_weight"
        ),
        F.filter(F.transform("steps", lambda s: s["edge"]), lambda e: e.isNotNull()).alias("edges"),
        F.transform("steps", lambda s: s["node_type"]).alias("node_types"),
    )

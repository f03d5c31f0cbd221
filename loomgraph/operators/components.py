"""Weakly connected components by hooking and pointer jumping.

Follows FastSV (Zhang, Azad and Hu, 2020): every node points at a smaller one,
neighbours pull both a node and the node it points at towards the smallest
pointer around, and pointers are halved each round.  Edges are laid out once and
never rewritten; a round shuffles one row per node.  The number of rounds grows
with the logarithm of the longest path.

Before that every task replaces runs of its edges by one edge from each of their nodes
to a node of its component in the run, first as the edges come, then with the rows of a
node together.  So about as many edges as nodes are numbered and followed in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.operators.lookups import BROADCAST_ROWS, salted_lookup
from loomgraph.operators.paths import HOPS, Arcs, prepare
from loomgraph.session import discard, stored

ship_by_value(__name__)

_MAX_ROUNDS = 100
#: Edges that a task holds at once.
RUN_EDGES = 1_000_000


def _join_few_or_many(rows: DataFrame, table: DataFrame, size: int, key: str, how: str) -> DataFrame:
    """One row per ``key`` in ``table``: broadcast while its counted size allows."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    return salted_lookup(rows, table, [key], how)


def _pointers(numbers: DataFrame, arcs: Arcs, size: int) -> DataFrame:
    """``id, f`` where ``f`` is the smallest number of the component of ``id``."""
    state = stored(numbers.select(F.col("n").alias("id"), F.col("n").alias("f"), F.col("n").alias("gf")))
    known = None
    for _ in range(_MAX_ROUNDS):
        pulls = arcs.leaving(state.select(F.col("id").alias("src"), "gf"), size)
        lowest = pulls.groupBy(F.col("dst").alias("id")).agg(F.min("gf").alias("low"))
        offers = state.join(lowest, "id", "left").select(
            F.inline(
                F.array(
                    F.struct("id", F.least("f", "gf", "low").alias("f")),
                    F.struct(F.col("f").alias("id"), F.least("f", "low").alias("f")),
                )
            )
        )
        pointers = offers.groupBy("id").agg(F.min("f").alias("f"))
        above = pointers.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        # A root may be the pointer of most nodes.
        last, state = state, stored(_join_few_or_many(pointers, above, size, "f", "inner").select("id", "f", "gf"))
        discard(last)
        # Pointers only ever fall, so equal sums mean that none moved.
        total = state.agg(F.sum((F.col("f").cast("decimal(38,0)") + F.col("gf")))).first()[0]
        if total == known:
            return state.select("id", "f")
        known = total
    raise RuntimeError("components did not settle")


def least_linked(one: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """For every number below ``size`` the least one of its component under the given pairs."""
    least = np.arange(size)
    while True:
        one, other = least[one], least[other]
        apart = one != other
        if not apart.any():
            return least
        one, other = one[apart], other[apart]
        np.minimum.at(least, np.maximum(one, other), np.minimum(one, other))
        while True:
            above = least[least]
            if np.array_equal(above, least):
                break
            least = above


def _contracted(links: DataFrame) -> DataFrame:
    """``src, dst`` that link what ``links`` link: for every run of a task each of its nodes, once, with one of its component."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        numbers = ends.indices.to_numpy()
        least = least_linked(numbers[: table.num_rows], numbers[table.num_rows :], len(ends.dictionary))
        return pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(least))], names=["src", "dst"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_EDGES:
                yield run(held)
                held, rows = [], 0
        if rows:
            yield run(held)

    return links.mapInArrow(contract, links.schema)


def _numbered_links(links: DataFrame, numbers: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The contracted ``links`` with the number of ``src``, null where it is no node, and the ends that are none."""
    few = _contracted(_contracted(links).repartition("src"))
    side = numbers.select(F.col("id").alias("src"), F.col("n").alias("_src"))
    few = stored(_join_few_or_many(few, side, size, "src", "left"))
    # Every end of an edge is a ``src`` here.
    return few, few.filter("_src IS NULL").select("src").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` where the component is named after its smallest id.

    The rounds run on numbers instead of ids: their minima need no sorting.
    """
    numbers = stored(nodes.select("id", F.monotonically_increasing_id().alias("n")), sized=True)
    size = numbers.count()
    links = edges.select("src", "dst").filter("src <> dst")
    few, unknown = _numbered_links(links, numbers, size)
    if not unknown.isEmpty():
        # An end that is no node links nothing.
        for end in ("src", "dst"):
            links = links.join(unknown.withColumnRenamed("src", end), end, "left_anti").select("src", "dst")
        few, _ = _numbered_links(links, numbers, size)
    side = numbers.select(F.col("id").alias("dst"), F.col("n").alias("_dst"))
    links = _join_few_or_many(few.filter("src <> dst"), side, size, "dst", "inner")
    arcs = prepare(links.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")), HOPS, directed=False)
    found = numbers.join(_pointers(numbers, arcs, size).withColumnRenamed("id", "n"), "n")
    names = found.groupBy("f").agg(F.min("id").alias("component"))
    return salted_lookup(found, names, ["f"], "inner", F.xxhash64("id")).select("id", "component")


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))


def component_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per distinct size, which carries the sorted size list in bounded form."""
    return component_sizes(nodes, edges).groupBy("size").agg(F.count("*").alias("components"))


def component_info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of components, largest size and total nodes, in one row."""
    return component_sizes(nodes, edges).agg(
        F.count("*").alias("num_components"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_component_size"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_nodes"),
    )

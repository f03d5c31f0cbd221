"""Merkle manifest of a dataset as a postorder append log.

A row is a leaf: the SHA-256 (lower-case hex) of its columns, each ``-`` if null, else its
length in UTF-8 bytes, ``:`` and its value.  The leaves of a group (a source) ascend by key;
three consecutive nodes at a time, the last ones fewer, become the digest of their
digests, until one remains: the group's root.  The roots of all groups, ordered by group
(null first, then by UTF-8 bytes), form a tree of the same kind; its root stands for the
dataset.

The log holds the nodes of a tree in the order in which they are complete (postorder).  A
builder owns an aligned range of leaves, reads them in order and writes each node as soon
as its last child is there, so it holds two digests a level at most.  The tops of the
ranges are the leaves of the next tier of builders.  Sizes of subtrees give the place of any
node in the log in closed form (``position``), so builders need not know each other, and
the siblings that a proof needs are addressed by their places.

Leaves are numbered by ranges: rows are sorted over all tasks at once, and the counts per
group and task are added up.  So a group that holds most rows is spread over many tasks,
and every tier works on ranges of at most ``3 ** TIER_LEVELS`` nodes.

Null groups form one group, nulls in any column are the leaf's ``-``, null keys come first,
repeated keys are ordered by leaf digest and equal rows are leaves each.  Long texts are
hashed whole.  An empty table has no root and no proofs.  Only the named columns are
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import named, written

ship_by_value(__name__)

#: Nodes that become one.
ARITY = 3
#: Levels that one builder writes; it reads up to 3 ** 7 = 2187 nodes.
TIER_LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
#: Proofs that a worker hands over at a time.
STEP_ROWS = 2_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def level_nodes(size: int, level: int) -> int:
    """Nodes on a level of a tree of ``size`` leaves."""
    return -(-size // ARITY**level)


def height(size: int) -> int:
    """Levels above the leaves."""
    level = 0
    while level_nodes(size, level) > 1:
        level += 1
    return level


def position(level: int, index: int, size: int) -> int:
    """Place of a node in the postorder log of a tree of ``size`` leaves.

    Before it stand the leaves up to its last one, its own descendants and the nodes
    that were complete before its first leaf.
    """
    top = height(size)
    later = sum(index // ARITY**m for m in range(1, top - level + 1))
    if level == 0:
        return index + later
    end = min((index + 1) * ARITY**level, size)
    return end + sum(-(-end // ARITY**m) for m in range(1, level)) + index + later


def completed(digests: list[str], first: int, size: int, tier: int, levels: int) -> Iterator[tuple[int, int, str]]:
    """Level, index and digest of the nodes that an aligned range completes, in that order.

    ``digests`` are the nodes from index ``first`` on of the level where the tier begins.
    """
    base = tier * levels
    stop = min(base + levels, height(size))
    waiting: list[list[str]] = [[] for _ in range(levels)]
    for index, found in enumerate(digests, first):
        level = base
        yield level, index, found
        while level < stop:
            run = waiting[level - base]
            run.append(found)
            if index % ARITY < ARITY - 1 and index < level_nodes(size, level) - 1:
                break
            found = digest("".join(run))
            run.clear()
            level, index = level + 1, index // ARITY
            yield level, index, found


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(columns: list[Column]) -> Column:
    def encoded(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def group_key(group: Column) -> Column:
    """The group as text that sorts null first; no group is null in it."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``g`` with their ``index`` in the group by ``order`` and its ``size``."""
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle_ranges")
    runs = placed.groupBy("g", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    # A group has a run per task at most.
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_at")).alias("shift"),
        F.sum("n").over(Window.partitionBy("g")).alias("size"),
    )
    met = placed.join(written(starts, "merkle_starts"), ["g", "part"])
    return met.withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@dataclass
class Log:
    """The tiers of a forest's log: ``g, size, block, position, level, index, digest, root``."""

    tiers: list[DataFrame]
    levels: int

    def roots(self) -> DataFrame:
        """``g, size, digest`` of the last node of every tree."""
        found = [t.filter("root").select("g", "size", "digest") for t in self.tiers]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]


def _build_tier(nodes: DataFrame, tier: int, levels: int) -> DataFrame:
    span = ARITY**levels

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def log() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            (g, block, size), top = key, height(key[2])
            done = list(completed(held, block * span, size, tier, levels))
            many = len(done)
            yield pa.RecordBatch.from_arrays([
                pa.array([g] * many, pa.string()), pa.array([size] * many, pa.int64()), pa.array([block] * many, pa.int64()),
                pa.array([position(level, index, size) for level, index, _ in done], pa.int64()),
                pa.array([level for level, _, _ in done], pa.int32()), pa.array([index for _, index, _ in done], pa.int64()),
                pa.array([d for _, _, d in done], pa.string()), pa.array([level == top for level, _, _ in done], pa.bool_()),
            ], names=["g", "size", "block", "position", "level", "index", "digest", "root"])

        for batch in batches:
            for g, block, size, found in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                if key != (g, block, size):
                    yield from log()
                    key, held = (g, block, size), []
                held.append(found)
        yield from log()

    rows = nodes.select("g", F.floor(F.col("index") / span).cast("bigint").alias("block"), "size", "digest", "index")
    ordered = rows.repartition("g", "block").sortWithinPartitions("g", "block", "index")
    return ordered.select("g", "block", "size", "digest").mapInArrow(
        stage, "g string, size bigint, block bigint, position bigint, level int, index bigint, digest string, root boolean"
    )


def append_log(leaves: DataFrame, levels: int = TIER_LEVELS) -> Log:
    """The log of the trees over ``g, index, size, digest``."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    tiers, nodes = [], leaves
    while not tiers or level_nodes(most, len(tiers) * levels) > 1:
        tiers.append(written(_build_tier(nodes, len(tiers), levels), f"merkle_tier{len(tiers)}"))
        begin = len(tiers) * levels
        nodes = tiers[-1].filter((F.col("level") == begin) & ~F.col("root")).select("g", "index", "size", "digest")
    return Log(tiers, levels)


def _prove_tier(log: DataFrame, heads: DataFrame, requests: DataFrame | None, tier: int, levels: int) -> DataFrame:
    """Ways up from nodes where the tier begins: those of ``requests``, or all.

    ``heads``: ``g, block, path, top``, the way up from a range's top node.
    """
    base = tier * levels
    tag = requests.schema["tag"].dataType.simpleString() if requests is not None else "int"
    none = lambda kind: F.lit(None).cast(kind)
    rows = heads.select(
        "g", "block", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"), none("string").alias("digest"), none("bigint").alias("size"),
        none("bigint").alias("index"), "path", "top", none(tag).alias("tag"),
    ).unionByName(log.select(
        "g", "block", F.lit(1).alias("kind"), F.col("position").alias("at"), "digest", "size",
        F.when(F.col("level") == base, F.col("index")).alias("index"), none(PATH).alias("path"), none("string").alias("top"), none(tag).alias("tag"),
    ))
    every = requests is None
    if not every:
        rows = rows.unionByName(requests.select(
            "g", F.floor(F.col("index") / ARITY**levels).cast("bigint").alias("block"), F.lit(2).alias("kind"), F.col("index").alias("at"),
            "digest", none("bigint").alias("size"), "index", none(PATH).alias("path"), none("string").alias("top"), "tag",
        ))
    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def ways(size: int, nodes: dict[int, str], head: list[tuple[str, str]]):
        """The function from an index to its way up; nodes above share theirs."""
        stop, known = min(base + levels, height(size)), {}

        def way(level: int, index: int) -> list[tuple[str, str]]:
            if level == stop:
                return head
            found = known.get((level, index))
            if found is None:
                first = index - index % ARITY
                run = range(first, min(first + ARITY, level_nodes(size, level)))
                left, right = ("".join(nodes[position(level, k, size)] for k in side) for side in (range(first, index), range(index + 1, run.stop)))
                found = known[level, index] = [(left, right), *way(level + 1, index // ARITY)]
            return found

        return lambda index: way(base, index)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, way = None, [], None
        nodes, inputs, size, head, top = {}, [], 0, [], None

        def flush(tags: pa.Array | None) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            paths = pa.array([[{"left": a, "right": b} for a, b in p] for p in columns[2]], path_type)
            found = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), paths, pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())]
            if tags is None:
                return pa.RecordBatch.from_arrays(found, names=["g", "index", "path", "top", "folded"])
            return pa.RecordBatch.from_arrays([*found, tags.take(pa.array(columns[5], pa.int64()))], names=["g", "index", "path", "top", "folded", "tag"])

        def whole_range() -> None:
            if every and key is not None:
                up = ways(size, nodes, head)
                out.extend((key[0], index, up(index), top, None, 0) for index in inputs)

        for batch in batches:
            tags = None if every else batch.column(8)
            columns = [batch.column(n).to_pylist() for n in range(8)]
            for row, (g, block, kind, at, found, many, index, path) in enumerate(zip(*columns, strict=True)):
                if key != (g, block):
                    whole_range()
                    key, nodes, inputs, way = (g, block), {}, [], None
                if kind == 0:
                    head, top = [(p["left"], p["right"]) for p in path], batch.column(9)[row].as_py()
                elif kind == 1:
                    nodes[at], size = found, many
                    if index is not None:
                        inputs.append(index)
                else:
                    way = way or ways(size, nodes, head)
                    up = way(index)
                    out.append((g, index, up, top, fold(found, up), row))
                if len(out) >= STEP_ROWS:
                    yield flush(tags)
            if not every or len(out) >= STEP_ROWS:
                yield flush(tags)
        whole_range()
        if every:
            yield flush(None)

    columns = ["g", "block", "kind", "at", "digest", "size", "index", "path", "tag", "top"]
    ordered = rows.select(*columns).repartition("g", "block").sortWithinPartitions("g", "block", "kind", "at")
    return ordered.mapInArrow(stage, f"g string, index bigint, path {PATH}, top string, folded string" + ("" if every else f", tag {tag}"))


def prove(log: Log, heads: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """``g, index, path, top, folded, tag`` of requested leaves (``g, index, digest, tag``), or of all without the last two.

    ``heads``: ``g, size, path, top`` of every tree, the way up from its root.  ``folded`` is the
    root that the given digest leads to.
    """
    span, found = ARITY**log.levels, None
    for tier in reversed(range(len(log.tiers))):
        ends_here = (F.col("size") <= span ** (tier + 1)) & ((F.col("size") > span**tier) | F.lit(tier == 0))
        tops = heads.filter(ends_here).select("g", F.lit(0).cast("bigint").alias("block"), "path", "top")
        if found is not None:
            tops = tops.unionByName(found.select("g", F.col("index").alias("block"), "path", "top"))
        found = _prove_tier(log.tiers[tier], tops, requests if tier == 0 else None, tier, log.levels)
        if tier:
            found = written(found, f"merkle_ways{tier}")
    return found


def manifest(
    docs: DataFrame, changed: Column | None = None, key: str = "doc_id", group: str = "source", text: str = "text",
    columns: tuple[str, ...] = COLUMNS, levels: int = TIER_LEVELS,
) -> tuple[DataFrame, str | None]:
    """A proof for every row, and the root.

    Rows: ``key, leaf, subroot, root, path, folded_root``.  ``changed`` is the text that is checked against
    the manifest, the row's own by default; where it differs, ``folded_root`` is not the root.
    """
    own = [named(c) for c in columns]
    leaf = leaf_digest(own)
    other = leaf_digest([changed if c == text else v for c, v in zip(columns, own, strict=True)]) if changed is not None else leaf
    leaves = docs.select(
        group_key(named(group)).alias("g"), named(key).alias("key"), leaf.alias("digest"), other.alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = written(numbered(written(leaves, "merkle_leaves"), ["key", "digest", "tie"]), "merkle_numbered")
    log = append_log(leaves.select("g", "index", "size", "digest"), levels)
    subroots = log.roots().select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("size").alias("of_size"), "digest")
    subroots = written(numbered(subroots, ["of"]), "merkle_subroots")
    top_log = append_log(subroots, levels)
    found = top_log.roots().first()
    root = found["digest"] if found else None
    # The way up from the only tree's root is empty.
    start = top_log.roots().select("g", "size", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    asked = subroots.select("g", "index", "digest", F.struct("of", "of_size", "digest").alias("tag"))
    heads = prove(top_log, start, asked).select(F.col("tag.of").alias("g"), F.col("tag.of_size").alias("size"), "path", F.col("tag.digest").alias("top"))
    requests = leaves.select("g", "index", F.col("other").alias("digest"), F.struct("key", F.col("digest").alias("leaf")).alias("tag"))
    proofs = prove(log, written(heads, "merkle_heads"), requests)
    rows = proofs.select(
        F.col("tag.key").alias(key), F.col("tag.leaf").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"),
        "path", F.col("folded").alias("folded_root"),
    )
    return rows, root


def proof_text(path: Column) -> Column:
    """The siblings of a way up, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")

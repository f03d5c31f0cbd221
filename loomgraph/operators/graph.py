"""The property graph: two DataFrames and the queries over them.

``nodes`` has ``id, name, type, file_path`` and any of the optional columns;
``edges`` has one row per (src, dst, type) and optionally ``line, call_text``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators.lookups import salted_lookup

Ids = DataFrame | Iterable[str]

# Types whose edges carry a line and a call text.
_LOCATED_EDGES = ["CREATES", "USES"]
# Types of a pair that one number holds.
_MASK_BITS = 62


def _membership(df: DataFrame, column: str, ids: Ids, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` against a list (pushed to the scan) or a DataFrame."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return salted_lookup(df, keys, [column], how).select(*df.columns)
    match = F.col(column).isin(list(ids))
    return df.filter(match if how == "left_semi" else ~match)


class PropertyGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes
        self.edges = edges

    # -- nodes ---------------------------------------------------------------

    def by_id(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def by_name(self, name: str) -> DataFrame:
        return self.nodes.filter(F.col("name") == name)

    def by_type(self, node_type: str) -> DataFrame:
        return self.nodes.filter(F.col("type") == node_type)

    def by_file(self, file_path: str) -> DataFrame:
        return self.nodes.filter(F.col("file_path") == file_path)

    def query_entities(
        self, entity_type: str | None = None, file_path: str | None = None, name: str | None = None
    ) -> DataFrame:
        """One filter at most, the name first, then the type, then the file."""
        if name:
            return self.by_name(name)
        if entity_type:
            return self.by_type(entity_type)
        if file_path:
            return self.by_file(file_path)
        return self.nodes

    def candidates(self, types: list[str] | None = None) -> DataFrame:
        """Rows the ranking may return, with defaults in place of absent columns."""
        have = set(self.nodes.columns)

        def text(name: str) -> Column:
            return (F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")).alias(name)

        def number(name: str) -> Column:
            value = F.coalesce(F.col(name), F.lit(0)) if name in have else F.lit(0)
            return value.cast("long").alias(name)

        return self.nodes.filter(F.col("type").isin(types or model.CANDIDATE_TYPES)).select(
            "id", text("name"), F.coalesce("type", F.lit("unknown")).alias("type"),
            text("file_path"), text("signature"), text("docstring"), text("code"),
            number("line_start"), number("line_end"),
        )

    def overview(self) -> DataFrame:
        """Narrow projection for drawing, with the table each node is stored in."""
        return self.nodes.select("id", "name", "type", "file_path", node_table(F.col("type")).alias("table"))

    # -- edges ---------------------------------------------------------------

    def relationships(
        self, source: str | None = None, target: str | None = None, rel_type: str | None = None
    ) -> DataFrame:
        found = self.edges
        for column, wanted in (("src", source), ("dst", target), ("type", rel_type)):
            if wanted:
                found = found.filter(F.col(column) == wanted)
        return found

    def edge_pairs(self) -> DataFrame:
        return edge_pairs(self.edges)

    def neighbors(self, node_id: str) -> DataFrame:
        """Full rows of predecessors and successors, one per neighbour and direction."""
        touching = self.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
        sides = touching.select(
            F.explode(
                F.array(
                    F.when(F.col("dst") == node_id, F.struct(F.col("src").alias("id"), F.lit("predecessor").alias("direction"))),
                    F.when(F.col("src") == node_id, F.struct(F.col("dst").alias("id"), F.lit("successor").alias("direction"))),
                )
            ).alias("side")
        ).filter("side IS NOT NULL").select("side.*").distinct()
        return sides.join(self.nodes, "id")

    def subgraph(self, ids: Ids, include_neighbors: bool = False) -> PropertyGraph:
        keep: Ids = ids
        if include_neighbors:
            out = _membership(self.edges, "src", ids, "left_semi").select(F.col("dst").alias("id"))
            into = _membership(self.edges, "dst", ids, "left_semi").select(F.col("src").alias("id"))
            own = _membership(self.nodes, "id", ids, "left_semi").select("id")
            keep = own.unionAll(out).unionAll(into).distinct()
        inner = _membership(_membership(self.edges, "src", keep, "left_semi"), "dst", keep, "left_semi")
        return PropertyGraph(_membership(self.nodes, "id", keep, "left_semi"), inner)

    def dangling_edges(self) -> DataFrame:
        """Edges with an endpoint that is not a node, and which end is missing."""
        known = self.nodes.select(F.col("id").alias("src"), F.lit(True).alias("_src"))
        marked = salted_lookup(self.edges, known, ["src"])
        known = self.nodes.select(F.col("id").alias("dst"), F.lit(True).alias("_dst"))
        marked = salted_lookup(marked, known, ["dst"])
        return (
            marked.filter("_src IS NULL OR _dst IS NULL")
            .withColumn(
                "missing",
                F.when(F.col("_src").isNotNull(), "target")
                .when(F.col("_dst").isNotNull(), "source")
                .otherwise("both"),
            )
            .select(*self.edges.columns, "missing")
        )

    def valid_edges(self) -> DataFrame:
        ids = self.nodes.select("id")
        return _membership(_membership(self.edges, "src", ids, "left_semi"), "dst", ids, "left_semi")

    # -- aggregates ------------------------------------------------------------

    def node_type_counts(self) -> DataFrame:
        kind = F.coalesce(F.col("type"), F.lit("unknown"))
        return self.nodes.groupBy(kind.alias("type")).agg(F.count("*").alias("cnt"))

    def rel_type_counts(self) -> DataFrame:
        """Counts of distinct (pair, type)."""
        return (
            self.edges.select("src", "dst", "type").distinct().groupBy("type").agg(F.count("*").alias("cnt"))
        )

    def statistics(self, components: bool = True) -> DataFrame:
        """Long form: ``metric, key, value``.  ``total_edges`` counts pairs, while
        ``relationship_types`` counts each type of a pair."""

        rows = self._node_statistics()
        if components:
            from loomgraph.operators.components import component_sizes

            sizes = component_sizes(self.nodes, self.edges)
            largest = sizes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("value"))
            rows = rows.unionAll(largest.select(F.lit("largest_component_size"), F.lit(""), "value"))
        return rows.unionAll(_edge_statistics(self.edges))

    def _node_statistics(self) -> DataFrame:
        """Counts by type, of all nodes and of their files, in one scan."""
        kind = F.coalesce(F.col("type"), F.lit("unknown"))
        groups = self.nodes.groupBy(kind.alias("type"), "file_path").agg(F.count("*").alias("n"))
        measured = groups.select(
            F.inline(
                F.array(
                    _measure("node_types", F.col("type"), F.col("n")),
                    _measure("total_nodes", F.lit(""), F.col("n")),
                    _measure("files_covered", F.lit(""), F.lit(0), F.when(F.col("file_path") != "", F.col("file_path"))),
                )
            )
        )
        zeros = self.nodes.sparkSession.range(1).select(
            F.inline(F.array(*[_measure(m, F.lit(""), F.lit(0)) for m in ("total_nodes", "files_covered")]))
        )
        return measured.unionAll(zeros).groupBy("metric", "key").agg(
            (F.sum("value") + F.count_distinct("file")).alias("value")
        )

    # -- changes ---------------------------------------------------------------

    def upsert_nodes(self, incoming: DataFrame) -> PropertyGraph:
        return PropertyGraph(upsert_nodes(self.nodes, incoming), self.edges)

    def upsert_edges(self, incoming: DataFrame) -> PropertyGraph:
        """Add typed edges whose endpoints exist; the rest are skipped."""
        valid = PropertyGraph(self.nodes, incoming).valid_edges()
        return PropertyGraph(self.nodes, merged_edges(self.edges, valid))

    def remove(self, ids: Ids) -> PropertyGraph:
        """Drop nodes and every edge that touches them."""
        edges = _membership(_membership(self.edges, "src", ids, "left_anti"), "dst", ids, "left_anti")
        return PropertyGraph(_membership(self.nodes, "id", ids, "left_anti"), edges)

    def update_entity(self, node_id: str, updates: dict[str, object]) -> PropertyGraph:
        """Set attributes of a node; one that no node has yet becomes a column, null elsewhere."""
        hit = F.col("id") == node_id
        known = set(self.nodes.columns)
        nodes = self.nodes.withColumns(
            {
                name: F.when(hit, F.lit(value)).otherwise(F.col(name)) if name in known else F.when(hit, F.lit(value))
                for name, value in updates.items()
            }
        )
        return PropertyGraph(nodes, self.edges)

    def cleared(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.limit(0), self.edges.limit(0))

    def new_ids(self, incoming: DataFrame) -> DataFrame:
        """Ids of ``incoming`` that the graph does not hold yet."""
        return _membership(incoming.select("id").distinct(), "id", self.nodes.select("id"), "left_anti")

    def new_pairs(self, incoming: DataFrame) -> DataFrame:
        """Pairs that adding ``incoming`` would create."""
        valid = PropertyGraph(self.nodes, incoming).valid_edges().select("src", "dst").distinct()
        return valid.join(self.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def _measure(metric: str, key: Column, value: Column, file: Column | None = None) -> Column:
    file = F.lit(None).cast("string") if file is None else file
    return F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("value"), file.alias("file"))


def _edge_statistics(edges: DataFrame) -> DataFrame:
    """Counts of pairs by each of their types, and of all pairs.

    The types, a small set, are numbered, so that a pair carries a bit for each of its own.
    """
    types = sorted((r.type for r in edges.select("type").distinct().collect()), key=lambda t: (t is not None, t))
    masks = []
    for first in range(0, len(types), _MASK_BITS):
        value = F.lit(0).cast("bigint")
        for bit, kind in enumerate(types[first : first + _MASK_BITS]):
            value = F.when(F.col("type").eqNullSafe(F.lit(kind)), F.lit(1 << bit).cast("bigint")).otherwise(value)
        masks.append(F.bit_or(value).alias(f"_types{first}"))
    pairs = edges.groupBy("src", "dst").agg(*masks or [F.count("*")])
    counted = [F.count(F.lit(1)).alias("c")]
    for at in range(len(types)):
        held = F.col(f"_types{at - at % _MASK_BITS}").bitwiseAND(F.lit(1 << at % _MASK_BITS).cast("bigint"))
        counted.append(F.count_if(held != 0).alias(f"c{at}"))
    rows = [F.struct(F.lit("total_edges").alias("metric"), F.lit("").alias("key"), F.col("c").alias("value"))]
    for at, kind in enumerate(types):
        rows.append(F.struct(F.lit("relationship_types").alias("metric"), F.lit(kind).cast("string").alias("key"), F.col(f"c{at}").alias("value")))
    return pairs.agg(*counted).select(F.inline(F.array(*rows)))


def node_table(node_type: Column) -> Column:
    """Name of the node table that stores a node type."""
    choice = F.lit("CodeEntity")
    for kind, name in model.NODE_TABLE_BY_TYPE.items():
        choice = F.when(node_type == kind, name).otherwise(choice)
    return choice


def edge_pairs(edges: DataFrame) -> DataFrame:
    """One row per (src, dst) with the sorted set of types.

    The set has at most one entry per relationship type.  A pair shares one
    line and call text, those of its last located edge.
    """
    aggregates = [F.array_sort(F.collect_set("type")).alias("types")]
    if {"line", "call_text", "ord"} <= set(edges.columns):
        for name in ("line", "call_text"):
            value = F.when(F.col("type").isin(_LOCATED_EDGES), F.struct(name))
            order = F.when(F.col("type").isin(_LOCATED_EDGES), F.col("ord"))
            aggregates.append(F.max_by(value, order)[name].alias(name))
    return edges.groupBy("src", "dst").agg(*aggregates)


def merged_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (src, dst, type) of either; values of ``incoming`` win."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    extra = [c for c in both.columns if c not in ("src", "dst", "type", "_batch")]
    merged = both.groupBy("src", "dst", "type").agg(
        F.max("_batch").alias("_batch"), *[F.max_by(c, "_batch").alias(c) for c in extra]
    )
    return merged.drop("_batch")


def upsert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by id.  Columns given by the newer row win, even when null; columns
    it does not carry keep their old value.

    ``incoming`` may hold an ``ord`` column that orders rows of the same id.
    """
    order = F.col("ord") if "ord" in incoming.columns else F.lit(0)
    both = existing.withColumn("_at", F.struct(F.lit(0).alias("b"), F.lit(None).cast(_order_type(incoming)).alias("o"))).unionByName(
        incoming.withColumn("_at", F.struct(F.lit(1).alias("b"), order.alias("o"))).drop("ord"),
        allowMissingColumns=True,
    )
    core = [name for name, _ in model.CORE_NODE_FIELDS if name != "id"]
    known = {name for name, _ in model.OPTIONAL_NODE_FIELDS}

    def merged(name: str) -> Column:
        if name in core:
            return F.max_by(name, "_at").alias(name)
        given = F.col(name).isNotNull()
        if name in known:
            carriers = [kind for kind, keys in model.KEYS_BY_TYPE.items() if name in keys]
            given = given | F.col("type").isin(carriers)
        # The struct keeps an explicit null: max_by skips rows whose order is null.
        return F.max_by(F.struct(name), F.when(given, F.col("_at")))[name].alias(name)

    columns = [c for c in both.columns if c not in ("id", "_at")]
    return both.groupBy("id").agg(*[merged(c) for c in columns])


def _order_type(incoming: DataFrame):
    return incoming.schema["ord"].dataType if "ord" in incoming.columns else "int"

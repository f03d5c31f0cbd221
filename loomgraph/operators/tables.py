"""The graph as typed tables: five for nodes, nine for relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators.graph import node_table
from loomgraph.operators.lookups import heavy_keys, repeat_rows, salted_lookup, spread_rows

# Columns stored as 0 when a node gives no value.
_ZERO_WHEN_ABSENT = {"line_start", "line_end", "line", "number", "stars", "forks"}
_FALSE_WHEN_ABSENT = {"is_test", "is_placeholder"}


def node_rows(nodes: DataFrame, table_name: str, text_lists: bool = False) -> DataFrame:
    """Rows of one node table with its own columns and defaults.

    ``text_lists`` prints lists the way the published store does, ``''`` for an empty one.
    """
    columns = []
    types = dict(model.CORE_NODE_FIELDS + model.OPTIONAL_NODE_FIELDS)
    for name in model.NODE_TABLE_COLUMNS[table_name]:
        present = name in nodes.columns
        kind = types.get(name, model.STR)
        value = F.col(name) if present else F.lit(None).cast(kind)
        if kind == model.STRS:
            items = F.coalesce(value, F.array().cast("array<string>"))
            printed = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
            value = F.when(F.size(items) > 0, printed).otherwise("") if text_lists else items
        elif name in _ZERO_WHEN_ABSENT:
            value = F.coalesce(value, F.lit(0).cast("long"))
        elif name in _FALSE_WHEN_ABSENT:
            value = F.coalesce(value, F.lit(False))
        else:
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(name))
    return nodes.filter(node_table(F.col("type")) == table_name).select(*columns)


def _known_types(edges: DataFrame) -> DataFrame:
    typed = edges.withColumn("type", F.upper("type"))
    return typed.filter(
        F.col("type").isin(list(model.REL_ENDPOINTS)) & F.col("src").isNotNull() & F.col("dst").isNotNull()
    )


def storable_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a known type whose endpoints exist in the tables that type connects."""
    typed = _known_types(edges).select("src", "dst", "type")
    bits = {name: 1 << at for at, name in enumerate(model.NODE_TABLE_COLUMNS)}
    numbered = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])

    def fits(end: str, position: int) -> Column:
        # An equality would become a key of the join and part the equal edges of a source.
        wanted = [F.lit(x) for kind, ends in model.REL_ENDPOINTS.items() for x in (kind, bits[ends[position]])]
        return F.create_map(*wanted)[F.col("type")].bitwiseAND(F.col(f"_{end}")) != 0

    def side(end: str) -> DataFrame:
        return nodes.select(F.col("id").alias(end), numbered[node_table(F.col("type"))].alias(f"_{end}"))

    # Equal edges lie together as they meet their source, so they need no shuffle of their own.
    heavy = heavy_keys(typed, ["src"])
    placed = spread_rows(typed, heavy, ["src"], F.xxhash64("dst"))
    met = placed.join(repeat_rows(side("src"), heavy, ["src"]), ["src", "_salt"]).filter(fits("src", 0))
    single = met.select("src", "_salt", "dst", "type").distinct().drop("_salt")
    return salted_lookup(single, side("dst"), ["dst"], "inner").filter(fits("dst", 1)).select("src", "dst", "type")


def table_statistics(nodes: DataFrame, edges: DataFrame, published: bool = False) -> DataFrame:
    """``metric, value``: a count per table and the totals.

    The published node total also adds the CREATES and USES counts.
    """
    node_keys = F.array(*[F.lit(t) for t in model.NODE_TABLE_COLUMNS])
    rel_keys = F.array(*[F.lit(t) for t in model.REL_ENDPOINTS])
    spark = nodes.sparkSession

    def counted(df: DataFrame, names, keys) -> DataFrame:
        counts = df.groupBy(names.alias("t")).agg(F.count("*").alias("n"))
        every = spark.range(1).select(F.explode(keys).alias("t"))
        return every.join(counts, "t", "left").select(
            F.concat(F.lower("t"), F.lit("_count")).alias("metric"), F.coalesce("n", F.lit(0)).alias("value")
        )

    node_counts = counted(nodes, node_table(F.col("type")), node_keys)
    rel_counts = counted(_known_types(edges).select("src", "dst", "type").distinct(), F.col("type"), rel_keys)
    in_total = node_counts
    if published:
        in_total = node_counts.unionAll(rel_counts.filter("metric IN ('creates_count', 'uses_count')"))

    def total(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.sum("value").alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [node_counts, rel_counts, total("total_nodes", in_total), total("total_relationships", rel_counts)]
    return reduce(DataFrame.unionAll, parts)


def nodes_per_table(nodes: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` nodes of every table, lowest ids first.

    One ordered limit per table keeps only ``limit`` rows per task; a window
    would bring a whole table to one task.
    """
    shown = nodes.select("id", "name", "type", "file_path", node_table(F.col("type")).alias("table"))
    parts = [shown.filter(F.col("table") == name).orderBy("id").limit(limit) for name in model.NODE_TABLE_COLUMNS]
    return reduce(DataFrame.unionAll, parts)


def edges_per_table(edges: DataFrame, limit: int) -> DataFrame:
    typed = _known_types(edges).select("src", "dst", "type")
    parts = [
        typed.filter(F.col("type") == name).orderBy("src", "dst").limit(limit) for name in model.REL_ENDPOINTS
    ]
    return reduce(DataFrame.unionAll, parts)

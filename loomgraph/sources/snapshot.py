"""The graph as JSON lines: one metadata line, one line per node, one per typed edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import model
from loomgraph.operators.graph import PropertyGraph

# Node columns beside the schema that have a place of their own; any other goes into ``props``.
_OWN_FIELDS = [("ord", model.LONG), ("signature", model.STR), ("docstring", model.STR), ("code", model.STR)]
_PROPS = T.MapType(model.STR, model.STR)
_LINE_SCHEMA = T.StructType(
    model.NODE_SCHEMA.fields
    + [T.StructField(n, t) for n, t in _OWN_FIELDS]
    + [T.StructField("props", _PROPS)]
    + [T.StructField(n, model.STR) for n in ("type_category", "source", "target", "call_text")]
)


def _as_text(df: DataFrame, column: str) -> Column:
    simple = not isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.col(column).cast("string") if simple else F.to_json(column)


def _props(rows: DataFrame, known: set[str]) -> Column | None:
    """Columns without a place of their own, as a map from name to text (JSON for nested values)."""
    others = [c for c in rows.columns if c not in known]
    given = F.col("props") if "props" in rows.columns else None
    if not others:
        return given
    found = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), _as_text(rows, c))]), lambda k, v: v.isNotNull())
    return found if given is None else F.map_concat(found, F.map_filter(F.coalesce(given, F.create_map().cast(_PROPS)), lambda k, v: ~k.isin(others)))


def snapshot_lines(graph: PropertyGraph, metadata: bool = True) -> DataFrame:
    """``value`` column of JSON texts, metadata first."""
    spark = graph.nodes.sparkSession
    nodes = graph.nodes.withColumn("type_category", F.lit("node"))
    props = _props(graph.nodes, set(_LINE_SCHEMA.fieldNames()))
    fields = [c for c in nodes.columns if c in set(_LINE_SCHEMA.fieldNames()) and c != "props"]
    nodes = nodes.select(F.to_json(F.struct(*fields, *([] if props is None else [props.alias("props")]))).alias("value"))
    extra = [c for c in ("line", "call_text", "ord") if c in graph.edges.columns]
    edge_props = _props(graph.edges, {"src", "dst", "type", "line", "call_text", "ord", "props"})
    if edge_props is not None:
        extra.append(edge_props.alias("props"))
    edges = graph.edges.select(
        F.to_json(
            F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", *extra, F.lit("edge").alias("type_category"))
        ).alias("value")
    )
    lines = nodes.unionAll(edges)
    if not metadata:
        return lines
    # The statistics have a handful of rows: one per metric and type.
    stats = graph.statistics().groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "metric", F.when(F.col("key") != "", F.col("key"))), "value"))).alias("statistics")
    )
    head = stats.select(
        F.to_json(
            F.struct(F.lit("metadata").alias("type"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "statistics")
        ).alias("value")
    )
    return head.coalesce(1).unionAll(lines)


def graph_from_lines(lines: DataFrame) -> PropertyGraph:
    """Rebuild a graph from ``value`` texts; metadata lines are skipped."""
    parsed = lines.select(F.from_json("value", _LINE_SCHEMA).alias("r")).select("r.*").filter(
        F.coalesce(F.col("type"), F.lit("")) != "metadata"
    )
    nodes = parsed.filter("type_category = 'node'").select(
        *model.NODE_SCHEMA.fieldNames(), *[n for n, _ in _OWN_FIELDS], "props"
    )
    edges = parsed.filter("type_category = 'edge'").select(
        F.col("source").alias("src"), F.col("target").alias("dst"), "type", "line", "call_text", "ord", "props"
    )
    return PropertyGraph(nodes, edges)


def export_snapshot(graph: PropertyGraph, path: str) -> None:
    snapshot_lines(graph).write.mode("overwrite").text(path)


def import_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    return graph_from_lines(spark.read.text(path))


def export_entities(nodes: DataFrame, path: str) -> None:
    """Entities alone, under a metadata line with their number."""
    total = nodes.agg(F.count("*").alias("total_entities")).select(
        F.to_json(F.struct(F.lit("metadata").alias("type"), "total_entities")).alias("value")
    )
    rows = nodes.select(F.to_json(F.struct(*nodes.columns)).alias("value"))
    total.coalesce(1).unionAll(rows).write.mode("overwrite").text(path)

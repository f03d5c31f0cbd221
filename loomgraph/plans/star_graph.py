"""The relational star schema seen as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph


# Declared schemas spare every query a pass over the file footers.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per dimension or order row; a literal ``type`` lets filters prune tables."""
    specs = [
        ("region", "region", "r_regionkey", "r_name", None),
        ("nation", "nation", "n_nationkey", "n_name", None),
        ("supplier", "supplier", "s_suppkey", "s_name", None),
        ("customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
        ("part", "part", "p_partkey", "p_name", "p_brand"),
        ("order", "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"),
    ]
    parts = [
        table(spark, sf_dir, source).select(
            _id(kind, key).alias("id"),
            F.col(name).alias("name"),
            F.lit(kind).alias("type"),
            (F.col(path) if path else F.lit("")).alias("file_path"),
        )
        for kind, source, key, name, path in specs
    ]
    return reduce(DataFrame.unionAll, parts)


def star_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Typed edges.  Line items are deduplicated on their narrow numeric keys before
    the string ids are built; path searches, which keep the lightest edge of a pair
    anyway, ask for the repeated rows and save those shuffles."""
    item = table(spark, sf_dir, "lineitem")
    specs = [
        ("BELONGS_TO", table(spark, sf_dir, "nation"), "nation", "n_nationkey", "region", "n_regionkey"),
        ("BELONGS_TO", table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"),
        ("BELONGS_TO", table(spark, sf_dir, "customer"), "customer", "c_custkey", "nation", "c_nationkey"),
        ("CALLS", table(spark, sf_dir, "orders"), "order", "o_orderkey", "customer", "o_custkey"),
        ("USES", item, "order", "l_orderkey", "part", "l_partkey"),
        ("CREATES", item, "order", "l_orderkey", "supplier", "l_suppkey"),
        ("MODIFIES", item.filter("l_returnflag = 'R'"), "order", "l_orderkey", "supplier", "l_suppkey"),
        ("IMPORTS", item, "part", "l_partkey", "supplier", "l_suppkey"),
    ]
    parts = []
    for kind, source, src_kind, src_key, dst_kind, dst_key in specs:
        keys = source.select(src_key, dst_key)
        if distinct and source.columns[0] == "l_orderkey":
            keys = keys.distinct()
        parts.append(
            keys.select(
                _id(src_kind, src_key).alias("src"),
                _id(dst_kind, dst_key).alias("dst"),
                F.lit(kind).alias("type"),
            )
        )
    return reduce(DataFrame.unionAll, parts)


def star_graph(spark: SparkSession, sf_dir: str, distinct: bool = True) -> PropertyGraph:
    return PropertyGraph(star_nodes(spark, sf_dir), star_edges(spark, sf_dir, distinct))


# The same graph for the SQL checks.
STAR_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type, '' AS file_path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', '' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', '' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', p_brand FROM part
  UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority, 'order', o_orderstatus FROM orders
),
edges AS (
  SELECT DISTINCT src, dst, type FROM (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'BELONGS_TO' AS type FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BELONGS_TO' FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'BELONGS_TO' FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'CALLS' FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'USES' FROM lineitem
    UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'CREATES' FROM lineitem
    UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'MODIFIES' FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'IMPORTS' FROM lineitem
  ) e
)
"""

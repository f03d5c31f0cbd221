"""Versioned Parquet storage of graphs and state tables.

Every save writes a new version folder and then appends a commit row, so readers
see a whole version or the one before it.  Nodes and edges are partitioned by
type: a type filter reads its own folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph

_COMMITS = "version BIGINT, committed_at TIMESTAMP"


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def current_version(self) -> int:
        """0 when nothing was saved yet."""
        try:
            commits = self.spark.read.schema(_COMMITS).json(f"{self.root}/commits")
            return commits.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def save(self, graph: PropertyGraph, **tables: DataFrame) -> int:
        """Write the graph and any named state tables as the next version."""
        version = self.current_version() + 1
        folder = f"{self.root}/version={version}"
        graph.nodes.write.partitionBy("type").parquet(f"{folder}/nodes")
        graph.edges.write.partitionBy("type").parquet(f"{folder}/edges")
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
        commit = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"))
        commit.write.mode("append").json(f"{self.root}/commits")
        return version

    def table(self, name: str, version: int | None = None) -> DataFrame:
        version = version or self.current_version()
        if not version:
            raise FileNotFoundError(f"no committed version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/version={version}/{name}")

    def load(self, version: int | None = None) -> PropertyGraph:
        version = version or self.current_version()
        return PropertyGraph(self.table("nodes", version), self.table("edges", version))

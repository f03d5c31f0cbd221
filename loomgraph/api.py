"""One object for analysing projects, querying the graph and ranking entities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.operators import incremental, paths, renames, tables
from loomgraph.operators.components import component_info, connected_components
from loomgraph.operators.extract import extract
from loomgraph.operators.graph import PropertyGraph, upsert_nodes
from loomgraph.plans import relevance
from loomgraph.session import cut_lineage
from loomgraph.sources import artifacts as artifact_source
from loomgraph.sources import snapshot
from loomgraph.sources.source_tree import parse_sources, read_source_tree
from loomgraph.sources.store import GraphStore

Progress = Callable[[int, str], None]


class KnowledgeBase:
    """A project's graph and the queries over it.

    ``published=True`` follows the published rules to the letter (uniform edge
    costs, matching-block text ratio, first-match quirks); the default reads
    them as intended.
    """

    def __init__(self, spark: SparkSession, published: bool = False):
        self.spark = spark
        self.published = published
        self.mode = relevance.PUBLISHED if published else relevance.INTENDED
        self.hyper = relevance.Hyperparameters()
        nodes = spark.createDataFrame([], model.NODE_SCHEMA)
        self.graph = PropertyGraph(nodes, spark.createDataFrame([], model.EDGE_SCHEMA))
        self.artifact_paths: list[str] = []
        self.syntax: DataFrame | None = None
        self.files: DataFrame | None = None

    # -- building --------------------------------------------------------------------

    def analyze_project(
        self, path: str, artifacts: str | None = None, progress: Progress | None = None
    ) -> dict[str, int]:
        """Scan, parse and extract the sources under ``path``, and add the artifact
        documents at ``artifacts`` when given.  Returns the counts of the run."""

        def tell(step: int, text: str) -> None:
            if progress:
                progress(step, text)

        tell(1, "scan")
        files = read_source_tree(self.spark, path, self.published)
        self.files = cut_lineage(renames.line_profile(files))
        tell(2, "parse")
        self.syntax = cut_lineage(parse_sources(files))
        tell(3, "extract")
        self._load_syntax()
        self.artifact_paths = []
        if artifacts:
            tell(4, "artifacts")
            self.add_artifacts(artifacts)
        tell(5, "summarise")
        return self.summary()

    def _load_syntax(self) -> None:
        found = extract(self.syntax, published=self.published)
        nodes = found.entities.drop("scope")
        edges = found.relationships.drop("scope")
        # Repeated relationships of a pair and type keep their last occurrence.
        kept = edges.groupBy("src", "dst", "type").agg(
            *[F.max_by(c, "ord").alias(c) for c in ("line", "call_text")], F.max("ord").alias("ord")
        )
        nodes = cut_lineage(nodes)
        self.graph = PropertyGraph(nodes, cut_lineage(PropertyGraph(nodes, kept).valid_edges()))

    def add_artifacts(self, path: str) -> dict[str, int]:
        """Add repositories, pull requests, issues and commits; files they touch must exist."""
        documents = artifact_source.read_artifacts(self.spark, path)
        documents = artifact_source.capped(documents) if self.published else artifact_source.scanned(documents)
        nodes, edges = artifact_source.artifact_graph(documents, self.published)
        if path not in self.artifact_paths:
            self.artifact_paths.append(path)
        nodes = cut_lineage(nodes)
        added = self.graph.new_ids(nodes).count()
        ordered = "ord" in self.graph.nodes.columns
        order = self.graph.nodes.select("id", "ord") if ordered else None
        merged = upsert_nodes(self.graph.nodes.drop("ord"), nodes)
        if order is not None:
            merged = merged.join(order, "id", "left")
        grown = PropertyGraph(cut_lineage(merged), self.graph.edges)
        pairs = grown.new_pairs(edges).count()
        self.graph = PropertyGraph(grown.nodes, cut_lineage(grown.upsert_edges(edges).edges))
        return {"entities_added": added, "relationships_added": pairs}

    def update_project(self, path: str) -> dict[str, int]:
        """Re-read ``path``, parse only files whose content is new there and rebuild the links.

        A file that moved with its content keeps its parsed events under the new path.  The
        artifact documents that were added are read again, so they stay and are refreshed.
        """
        if self.syntax is None or self.files is None:
            return self.analyze_project(path)
        files = read_source_tree(self.spark, path, self.published)
        now = cut_lineage(renames.line_profile(files))
        moved = cut_lineage(renames.renames(self.files, now))
        plain = incremental.change_feed(self.files, now, python_only=False)
        feed = cut_lineage(renames.with_renames(plain, moved, python_only=False))
        counts = {r.change_type: r["count"] for r in feed.groupBy("change_type").count().collect()}
        # Events depend on the content, and on the path only through the language.
        suffix = lambda c: F.lower(F.regexp_extract(c, r"\.[^./]*$", 0))
        carried = moved.filter((F.col("similarity") == 1.0) & (suffix("old_path") == suffix("new_path")))
        carried = carried.join(self._hashes(self.files, "old_path"), "old_path").join(self._hashes(now, "new_path"), ["new_path", "content_hash"])
        carried = cut_lineage(carried.select("old_path", "new_path"))
        known = incremental.renamed_files(self.files, carried)
        changed = incremental.changed_files(known, files)
        deleted = known.join(now, "file_path", "left_anti")
        self.syntax = cut_lineage(incremental.refreshed(self.syntax, cut_lineage(parse_sources(changed)), deleted, carried))
        self.files = now
        self._load_syntax()
        for documents in self.artifact_paths:
            self.add_artifacts(documents)
        return {f"files_{kind}": counts.get(kind, 0) for kind in ("added", "modified", "deleted", "renamed")}

    @staticmethod
    def _hashes(listing: DataFrame, name: str) -> DataFrame:
        return listing.select(F.col("file_path").alias(name), "content_hash")

    def summary(self) -> dict[str, int]:
        kinds = {r.type: r.cnt for r in self.graph.node_type_counts().collect()}
        pairs = self.graph.edges.select("src", "dst").distinct().count()
        return {"files": kinds.get("file", 0), "entities": sum(kinds.values()), "relationships": pairs,
                **{f"entities_{kind}": n for kind, n in sorted(kinds.items())}}

    def clear(self) -> None:
        self.graph = self.graph.cleared()

    # -- queries -----------------------------------------------------------------------

    def query_entities(self, entity_type=None, file_path=None, name=None) -> DataFrame:
        return self.graph.query_entities(entity_type, file_path, name)

    def query_relationships(self, source=None, target=None, rel_type=None) -> DataFrame:
        return self.graph.relationships(source, target, rel_type)

    def query(self, kind: str, **filters: str) -> DataFrame:
        """``entities`` by type, ``relationships`` by type, or ``neighbors`` of an id."""
        if kind == "entities":
            return self.graph.by_type(filters["entity_type"])
        if kind == "relationships":
            return self.graph.relationships(rel_type=filters["rel_type"])
        if kind == "neighbors":
            return self.graph.neighbors(filters["entity_id"])
        raise ValueError(f"unknown query type: {kind}")

    def statistics(self) -> DataFrame:
        return self.graph.statistics()

    def table_statistics(self) -> DataFrame:
        return tables.table_statistics(self.graph.nodes, self.graph.edges, self.published)

    def all_nodes(self, limit: int = 100) -> DataFrame:
        return tables.nodes_per_table(self.graph.nodes, limit)

    def all_relationships(self, limit: int = 100) -> DataFrame:
        return tables.edges_per_table(self.graph.edges, limit)

    def shortest_path(self, source: str, target: str) -> DataFrame:
        return paths.shortest_hops(self.graph.nodes, self.graph.edges, source, target)

    def within_distance(self, source: str, distance: float) -> DataFrame:
        mode = self.mode
        return paths.within_distance(self.graph.nodes, self.graph.edges, source, distance, mode.weights, mode.directed)

    def components(self) -> DataFrame:
        return connected_components(self.graph.nodes, self.graph.edges)

    def component_info(self) -> DataFrame:
        return component_info(self.graph.nodes, self.graph.edges)

    # -- ranking ---------------------------------------------------------------------------

    def update_hyperparameters(self, **changes: float) -> None:
        self.hyper = self.hyper.updated(**changes)

    def relevance(self, problem: str, **options) -> DataFrame:
        """Top entities for a problem text; see ``plans.relevance.rank``."""
        return relevance.rank(self.graph, problem, self.hyper, self.mode, **options)

    def top_functions(self, problem: str, k: int = 10) -> DataFrame:
        return relevance.top_functions(self.relevance(problem, limit=k), k)

    def save_ranking(self, ranked: DataFrame, path: str) -> None:
        """Write a ranking as JSON; it has at most ``top_k`` rows, so one file holds it."""
        ranked.coalesce(1).write.mode("overwrite").json(path)

    # -- storage ---------------------------------------------------------------------------

    def export(self, path: str) -> None:
        snapshot.export_snapshot(self.graph, path)

    def load(self, path: str) -> None:
        self.graph = snapshot.import_snapshot(self.spark, path)

    def save(self, root: str) -> int:
        state = {name: df for name, df in (("syntax", self.syntax), ("files", self.files)) if df is not None}
        return GraphStore(self.spark, root).save(self.graph, **state)

    def open(self, root: str) -> None:
        store = GraphStore(self.spark, root)
        self.graph, self.syntax, self.files = store.load(), store.table("syntax"), store.table("files")


def union_graphs(graphs: list[PropertyGraph]) -> PropertyGraph:
    """Code and artifact graphs side by side; columns that one lacks become null."""
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b, allowMissingColumns=True)

    return PropertyGraph(reduce(both, [g.nodes for g in graphs]), reduce(both, [g.edges for g in graphs]))

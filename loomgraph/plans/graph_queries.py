"""Filters, neighbourhoods, aggregates and changes on the star-schema graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import tables
from loomgraph.operators.components import component_info, component_summary, connected_components
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans.registry import query
from loomgraph.plans.star_graph import STAR_SQL, star_edges, star_graph, star_nodes, table

WITH = f"WITH {STAR_SQL}"


# -- node filters --------------------------------------------------------------

@query("entity_by_id", f"{WITH} SELECT * FROM nodes WHERE id = 'customer:7'")
def entity_by_id(spark, sf):
    return star_graph(spark, sf).by_id("customer:7")


@query("entities_by_name", f"{WITH} SELECT * FROM nodes WHERE name = 'cold widget'")
def entities_by_name(spark, sf):
    return star_graph(spark, sf).by_name("cold widget")


@query("entities_by_type", f"{WITH} SELECT * FROM nodes WHERE type = 'supplier'")
def entities_by_type(spark, sf):
    return star_graph(spark, sf).by_type("supplier")


@query("entities_by_file", f"{WITH} SELECT * FROM nodes WHERE file_path = 'BUILDING'")
def entities_by_file(spark, sf):
    return star_graph(spark, sf).by_file("BUILDING")


@query("query_entities_precedence", f"{WITH} SELECT * FROM nodes WHERE name = '1-URGENT'")
def query_entities_precedence(spark, sf):
    return star_graph(spark, sf).query_entities(entity_type="part", file_path="F", name="1-URGENT")


@query("query_entities_unfiltered", f"{WITH} SELECT * FROM nodes")
def query_entities_unfiltered(spark, sf):
    return star_graph(spark, sf).query_entities()


@query(
    "candidate_entities",
    f"""{WITH} SELECT id, name, type, file_path, '' AS signature, '' AS docstring, '' AS code,
    0::BIGINT AS line_start, 0::BIGINT AS line_end FROM nodes WHERE type IN ('part', 'supplier')""",
)
def candidate_entities(spark, sf):
    return star_graph(spark, sf).candidates(["part", "supplier"])


@query("node_overview", f"""{WITH} SELECT id, name, type, file_path, 'CodeEntity' AS "table" FROM nodes""")
def node_overview(spark, sf):
    return star_graph(spark, sf).overview()


# -- edge filters ----------------------------------------------------------------

@query("relationships_filtered", f"{WITH} SELECT * FROM edges WHERE src = 'order:1' AND type = 'USES'")
def relationships_filtered(spark, sf):
    return star_graph(spark, sf).relationships(source="order:1", rel_type="USES")


@query("relationships_by_target", f"{WITH} SELECT * FROM edges WHERE dst = 'supplier:3'")
def relationships_by_target(spark, sf):
    return star_graph(spark, sf).relationships(target="supplier:3")


@query("relationships_by_type", f"{WITH} SELECT * FROM edges WHERE type = 'IMPORTS'")
def relationships_by_type(spark, sf):
    return star_graph(spark, sf).relationships(rel_type="IMPORTS")


@query(
    "neighbors",
    f"""{WITH} SELECT DISTINCT n.*, 'predecessor' AS direction FROM edges e JOIN nodes n ON n.id = e.src
    WHERE e.dst = 'part:1' UNION ALL
    SELECT DISTINCT n.*, 'successor' FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = 'part:1'""",
)
def neighbors(spark, sf):
    return star_graph(spark, sf).neighbors("part:1")


@query(
    "subgraph_induced",
    f"""{WITH}, keep AS (SELECT id FROM nodes WHERE type IN ('part', 'supplier', 'nation'))
    SELECT * FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""",
)
def subgraph_induced(spark, sf):
    graph = star_graph(spark, sf)
    keep = graph.nodes.filter(F.col("type").isin("part", "supplier", "nation")).select("id")
    return graph.subgraph(keep).edges


_ONE_HOP = f"""{WITH}, keep AS (SELECT id FROM nodes WHERE id IN ('nation:3', 'part:5')
    UNION SELECT dst FROM edges WHERE src IN ('nation:3', 'part:5')
    UNION SELECT src FROM edges WHERE dst IN ('nation:3', 'part:5'))"""


@query(
    "subgraph_one_hop",
    f"{_ONE_HOP} SELECT * FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)",
)
def subgraph_one_hop(spark, sf):
    return star_graph(spark, sf).subgraph(["nation:3", "part:5"], include_neighbors=True).edges


@query("subgraph_one_hop_nodes", f"{_ONE_HOP} SELECT * FROM nodes WHERE id IN (SELECT id FROM keep)")
def subgraph_one_hop_nodes(spark, sf):
    return star_graph(spark, sf).subgraph(["nation:3", "part:5"], include_neighbors=True).nodes


# -- aggregates --------------------------------------------------------------------

@query("node_type_counts", f"{WITH} SELECT type, count(*) AS cnt FROM nodes GROUP BY type")
def node_type_counts(spark, sf):
    return star_graph(spark, sf).node_type_counts()


@query("rel_type_counts", f"{WITH} SELECT type, count(*) AS cnt FROM edges GROUP BY type")
def rel_type_counts(spark, sf):
    return star_graph(spark, sf).rel_type_counts()


_UNDIRECTED = """und AS (SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) u)"""

# Smallest label spread until nothing changes.
_LABELS = """labels(id, label) USING KEY (id) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT e.dst, min(l.label) FROM labels l JOIN und e ON e.src = l.id
  JOIN recurring.labels cur ON cur.id = e.dst WHERE l.label < cur.label GROUP BY e.dst)"""


@query(
    "graph_statistics",
    f"""WITH RECURSIVE {STAR_SQL}, {_UNDIRECTED}, {_LABELS}
    SELECT 'node_types' AS metric, type AS "key", count(*) AS value FROM nodes GROUP BY type
    UNION ALL SELECT 'relationship_types', type, count(*) FROM edges GROUP BY type
    UNION ALL SELECT 'total_nodes', '', count(*) FROM nodes
    UNION ALL SELECT 'total_edges', '', count(*) FROM (SELECT DISTINCT src, dst FROM edges)
    UNION ALL SELECT 'files_covered', '', count(DISTINCT file_path) FROM nodes WHERE file_path <> ''
    UNION ALL SELECT 'largest_component_size', '', max(n) FROM
      (SELECT count(*) AS n FROM labels GROUP BY label)""",
)
def graph_statistics(spark, sf):
    return star_graph(spark, sf, distinct=False).statistics()


@query(
    "edge_pair_types",
    f"""{WITH} SELECT src, dst, array_to_string(list_sort(list(DISTINCT type)), ',') AS types
    FROM edges GROUP BY src, dst""",
)
def edge_pair_types(spark, sf):
    return star_graph(spark, sf).edge_pairs().select("src", "dst", F.array_join("types", ",").alias("types"))


@query(
    "type_counts_for_display",
    f"""{WITH} SELECT (SELECT count(DISTINCT type) FROM nodes) AS node_types,
    (SELECT count(DISTINCT type) FROM edges) AS relationship_types""",
)
def type_counts_for_display(spark, sf):
    graph = star_graph(spark, sf)
    nodes = graph.nodes.agg(F.countDistinct("type").alias("node_types"))
    edges = graph.edges.agg(F.countDistinct("type").alias("relationship_types"))
    return nodes.select("node_types", edges.scalar().alias("relationship_types"))


def _orders_of_customers(spark, sf) -> PropertyGraph:
    """A graph of many components: customers and the orders that call them."""
    graph = star_graph(spark, sf)
    return PropertyGraph(
        graph.nodes.filter(F.col("type").isin("order", "customer")), graph.edges.filter("type = 'CALLS'")
    )


_CALLS_GRAPH = f"""WITH RECURSIVE {STAR_SQL.replace("nodes AS (", "all_nodes AS (").replace("edges AS (", "all_edges AS (")},
  nodes AS (SELECT * FROM all_nodes WHERE type IN ('order', 'customer')),
  edges AS (SELECT * FROM all_edges WHERE type = 'CALLS'), {_UNDIRECTED}, {_LABELS}"""


@query("connected_components", f"{_CALLS_GRAPH} SELECT id, label AS component FROM labels")
def components(spark, sf):
    graph = _orders_of_customers(spark, sf)
    return connected_components(graph.nodes, graph.edges)


@query(
    "connected_components_sizes",
    f"""{_CALLS_GRAPH} SELECT size, count(*) AS components FROM
    (SELECT count(*) AS size FROM labels GROUP BY label) GROUP BY size""",
)
def components_sizes(spark, sf):
    graph = _orders_of_customers(spark, sf)
    return component_summary(graph.nodes, graph.edges)


@query(
    "connected_components_info",
    f"""WITH RECURSIVE {STAR_SQL}, {_UNDIRECTED}, {_LABELS}
    SELECT count(*) AS num_components, max(size) AS largest_component_size, sum(size)::BIGINT AS total_nodes
    FROM (SELECT count(*) AS size FROM labels GROUP BY label)""",
)
def components_info(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    return component_info(graph.nodes, graph.edges)


# -- changes -----------------------------------------------------------------------

def _incoming_nodes(spark, sf) -> DataFrame:
    """Every supplier under a new name, and an archived twin of every customer."""
    suppliers = star_nodes(spark, sf).filter("type = 'supplier'").withColumn("name", F.upper("name"))
    customers = star_nodes(spark, sf).filter("type = 'customer'").withColumn("id", F.concat("id", F.lit(":archived")))
    return suppliers.unionAll(customers)


_INCOMING_NODES = """incoming AS (
  SELECT id, upper(name) AS name, type, file_path FROM nodes WHERE type = 'supplier'
  UNION ALL SELECT id || ':archived', name, type, file_path FROM nodes WHERE type = 'customer')"""


@query(
    "upsert_nodes",
    f"""{WITH}, {_INCOMING_NODES} SELECT * FROM incoming UNION ALL
    SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM incoming)""",
)
def upsert_nodes(spark, sf):
    return star_graph(spark, sf).upsert_nodes(_incoming_nodes(spark, sf)).nodes


def _incoming_edges(spark, sf) -> DataFrame:
    """Suppliers test the parts that import them; some point at parts that do not exist."""
    imports = star_edges(spark, sf).filter("type = 'IMPORTS'")
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("TESTS").alias("type"))
    lost = back.withColumn("dst", F.concat("dst", F.lit(":gone")))
    again = imports.withColumn("type", F.lit("CALLS"))
    return back.unionAll(lost).unionAll(again)


_INCOMING_EDGES = """incoming AS (
  SELECT dst AS src, src AS dst, 'TESTS' AS type FROM edges WHERE type = 'IMPORTS'
  UNION ALL SELECT dst, src || ':gone', 'TESTS' FROM edges WHERE type = 'IMPORTS'
  UNION ALL SELECT src, dst, 'CALLS' FROM edges WHERE type = 'IMPORTS'),
valid AS (SELECT * FROM incoming WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


@query("upsert_edges", f"{WITH}, {_INCOMING_EDGES} SELECT * FROM edges UNION SELECT * FROM valid")
def upsert_edges(spark, sf):
    return star_graph(spark, sf).upsert_edges(_incoming_edges(spark, sf)).edges


@query(
    "upsert_counts",
    f"""{WITH}, {_INCOMING_EDGES}, {_INCOMING_NODES.replace("incoming AS", "incoming_nodes AS")}
    SELECT (SELECT count(DISTINCT id) FROM incoming_nodes WHERE id NOT IN (SELECT id FROM nodes)) AS nodes_added,
    (SELECT count(*) FROM (SELECT src, dst FROM valid EXCEPT SELECT src, dst FROM edges)) AS pairs_added""",
)
def upsert_counts(spark, sf):
    graph = star_graph(spark, sf)
    nodes = graph.new_ids(_incoming_nodes(spark, sf)).agg(F.count("*").alias("nodes_added"))
    pairs = graph.new_pairs(_incoming_edges(spark, sf)).agg(F.count("*").alias("pairs_added"))
    return nodes.select("nodes_added", pairs.scalar().alias("pairs_added"))


@query(
    "dangling_edges",
    f"""{WITH}, {_INCOMING_EDGES} SELECT src, dst, type, 'target' AS missing FROM incoming
    WHERE dst NOT IN (SELECT id FROM nodes)""",
)
def dangling_edges(spark, sf):
    return PropertyGraph(star_nodes(spark, sf), _incoming_edges(spark, sf)).dangling_edges()


_REMOVED = "removed AS (SELECT id FROM nodes WHERE file_path IN ('Brand#13', 'MACHINERY'))"


def _removal(spark, sf) -> PropertyGraph:
    graph = star_graph(spark, sf)
    return graph.remove(graph.nodes.filter(F.col("file_path").isin("Brand#13", "MACHINERY")).select("id"))


@query(
    "remove_cascade",
    f"""{WITH}, {_REMOVED} SELECT * FROM edges WHERE src NOT IN (SELECT id FROM removed)
    AND dst NOT IN (SELECT id FROM removed)""",
)
def remove_cascade(spark, sf):
    return _removal(spark, sf).edges


@query("remove_cascade_nodes", f"{WITH}, {_REMOVED} SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM removed)")
def remove_cascade_nodes(spark, sf):
    return _removal(spark, sf).nodes


@query(
    "update_entity",
    f"""{WITH} SELECT id, CASE WHEN id = 'nation:4' THEN 'RENAMED' ELSE name END AS name, type, file_path
    FROM nodes WHERE type = 'nation'""",
)
def update_entity(spark, sf):
    return star_graph(spark, sf).update_entity("nation:4", {"name": "RENAMED"}).by_type("nation")


# -- typed tables --------------------------------------------------------------------

@query(
    "table_statistics",
    f"""{WITH} SELECT 'codeentity_count' AS metric, count(*) AS value FROM nodes
    UNION ALL SELECT m, 0 FROM (VALUES ('commit_count'), ('issue_count'), ('pullrequest_count'), ('repository_count'),
      ('mentions_issue_count'), ('mentions_pr_count'), ('tests_count')) v(m)
    UNION ALL SELECT lower(type) || '_count', count(*) FROM edges GROUP BY type
    UNION ALL SELECT 'total_nodes', count(*) FROM nodes
    UNION ALL SELECT 'total_relationships', count(*) FROM edges""",
)
def table_statistics(spark, sf):
    graph = star_graph(spark, sf)
    return tables.table_statistics(graph.nodes, graph.edges)


@query(
    "per_table_limit",
    f"""{WITH} SELECT id, name, type, file_path, 'CodeEntity' AS "table" FROM nodes ORDER BY id LIMIT 100""",
)
def per_table_limit(spark, sf):
    return tables.nodes_per_table(star_nodes(spark, sf), 100)


@query(
    "relationships_per_table_limit",
    f"""{WITH} SELECT src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY src, dst) AS rn
    FROM edges) t WHERE rn <= 50""",
)
def relationships_per_table_limit(spark, sf):
    return tables.edges_per_table(star_edges(spark, sf), 50)


@query(
    "typed_endpoint_edges",
    f"""{WITH} SELECT e.src, e.dst, e.type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
    WHERE e.type <> 'MODIFIES'""",
)
def typed_endpoint_edges(spark, sf):
    return tables.storable_edges(star_nodes(spark, sf), star_edges(spark, sf, distinct=False))

import os

import pytest

import __spark_entry__ as contract
from loomgraph.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
QUICK = [
    "entities_by_type", "query_entities_precedence", "relationships_filtered", "neighbors", "subgraph_induced",
    "edge_pair_types", "upsert_nodes", "dangling_edges", "table_statistics", "per_table_limit", "cosine_topk",
    "text_edit_topk", "entity_hash", "snapshot_diff", "change_summary", "line_enclosing_entity", "call_predicates",
    "artifact_edges", "within_distance",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def test_every_twin_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    rows_only = set(catalog.QUERIES) - set(catalog.SQL)
    assert rows_only == {"text_matching_topk", "relevance_rank_published", "tested_names", "camel_split"}


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql_twin(spark, name):
    con = oracle.duck(SF)
    assert oracle.compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) is None


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    """A stored graph prunes folders by type and pushes other filters down."""
    from loomgraph.plans.star_graph import star_graph
    from loomgraph.sources.store import GraphStore

    store = GraphStore(spark, str(tmp_path))
    store.save(star_graph(spark, SF))
    found = store.load().by_type("supplier").filter("name = 'x'").select("id")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan
    assert "EqualTo(name,x)" in plan
    assert "ReadSchema: struct<id:string,name:string>" in plan

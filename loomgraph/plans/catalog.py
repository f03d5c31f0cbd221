"""Every registered query."""

from loomgraph.plans import code_queries, graph_queries, ranking_queries, store_queries  # noqa: F401
from loomgraph.plans.registry import QUERIES, SQL  # noqa: F401

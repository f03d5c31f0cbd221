"""A search follows an edge once, and a ranking ends when nothing left can enter it."""

import random

from loomgraph.operators import paths
from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import relevance


def test_each_node_is_expanded_once(spark, monkeypatch):
    # The way over many light edges is shorter than the direct heavy one, so hop order would reach nodes too early.
    edges = [(f"n{i}", f"n{j}", "CREATES" if j == i + 1 else "MODIFIES") for i in range(9) for j in range(i + 1, min(i + 4, 10))]
    weights = paths.Weights((("CREATES", 10), ("MODIFIES", 35)), 20)
    expanded, leaving = [], paths.Arcs.leaving
    monkeypatch.setattr(paths.Arcs, "leaving", lambda self, frontier, count: expanded.append(count) or leaving(self, frontier, count))
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(10)], "id string")
    found = paths.search(paths.prepare(spark.createDataFrame(edges, "src string, dst string, type string"), weights), paths.seed(nodes, "n0"))
    assert {r.id: (r.dist, r.parent) for r in found.collect()} == {f"n{i}": (10 * i, f"n{i - 1}" if i else None) for i in range(10)}
    assert sum(expanded) <= 10


def test_very_light_edges_do_not_make_many_rounds(spark, monkeypatch):
    rounds, leaving = [], paths.Arcs.leaving
    monkeypatch.setattr(paths.Arcs, "leaving", lambda self, frontier, count: rounds.append(count) or leaving(self, frontier, count))
    edges = [(f"a{i}", f"a{i + 1}", "CALLS") for i in range(6)] + [(f"a{i}", f"b{i}", "USES") for i in range(6)] + [("a0", "a6", "CREATES")]
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e[:2]}], "id string")
    weights = paths.Weights().updated({"USES": 0.00001, "CALLS": 0.3})
    found = paths.distances_from(nodes, spark.createDataFrame(edges, "src string, dst string, type string"), "a0", weights=weights)
    want = {f"a{i}": 0.3 * i for i in range(7)} | {f"b{i}": 0.3 * i + 0.00001 for i in range(6)}
    assert {r.id: round(r.distance, 6) for r in found.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert len(rounds) <= 14


def test_a_ranking_ends_early_and_equals_scoring_all(spark, monkeypatch):
    rng = random.Random(4)
    names = ["login fails", "session expires", "logout", "zzz qqq", "user login session"]
    nodes = [("i", "login fails after session", "issue", "")] + [(f"f{n}", rng.choice(names), "function", "a.py") for n in range(120)]
    edges = [("i", f"f{n}", "BELONGS_TO") for n in range(20)] + [(f"f{n // 2}", f"f{n}", "CALLS") for n in range(20, 120)]
    graph = PropertyGraph(
        spark.createDataFrame(nodes, "id string, name string, type string, file_path string"), spark.createDataFrame(edges, "src string, dst string, type string")
    )
    hyper, searched, search = relevance.Hyperparameters(top_k=5), [], paths.search
    whole = search(paths.prepare(graph.edges, directed=False), paths.seed(graph.nodes, "i"), cutoff=100)
    scored = relevance.score(graph.candidates(None), whole, "login fails", hyper, relevance.INTENDED).collect()
    want = sorted(((-r.total_score, r.entity_id) for r in scored))
    monkeypatch.setattr(paths, "search", lambda *a, **k: searched.append(search(*a, **k)) or searched[-1])
    for k in (5, 60):
        ranked = relevance.rank(graph, "login fails", hyper, with_path_info=False, limit=k).collect()
        assert [(-r.total_score, r.entity_id) for r in sorted(ranked, key=lambda r: r.rank)] == want[:k]
    assert searched[0].count() < 60 and searched[-1].count() > 60

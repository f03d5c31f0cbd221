import heapq
import random

from pyspark.sql import functions as F

from loomgraph.operators import lookups, paths
from loomgraph.operators.components import connected_components
from loomgraph.operators.containment import contained_pairs
from loomgraph.operators.ranges import first_covering


def _graph(spark, ids, edges):
    nodes = spark.createDataFrame([(i, i, "function", "") for i in ids], "id string, name string, type string, file_path string")
    return nodes, spark.createDataFrame(edges, "src string, dst string, type string")


def _components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(3)
    ids = [f"n{i:03d}" for i in range(160)]
    chain = [(ids[i], ids[i + 1], "CALLS") for i in range(0, 60)]
    shuffled = ids[61:100]
    rng.shuffle(shuffled)
    chain += [(a, b, "CALLS") for a, b in zip(shuffled, shuffled[1:])]
    hub = [(ids[140], i, "USES") for i in ids[100:139]]
    loops = [(ids[150], ids[150], "CALLS")]
    nodes, edges = _graph(spark, ids, chain + hub + loops)
    got = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert got == _components(ids, chain + hub)


def _dijkstra(source, edges, weights, directed):
    links = {}
    for a, b, kind in edges:
        w = dict(weights.tenths).get(kind, weights.default)
        links.setdefault(a, []).append((b, w))
        if not directed:
            links.setdefault(b, []).append((a, w))
    best, queue = {}, [(0, source)]
    while queue:
        d, node = heapq.heappop(queue)
        if node in best:
            continue
        best[node] = d
        for other, w in links.get(node, []):
            heapq.heappush(queue, (d + w, other))
    return best


def test_distances_match_dijkstra(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    kinds = ["CALLS", "BELONGS_TO", "USES", "SOMETHING"]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(kinds)) for _ in range(90)]
    nodes, rows = _graph(spark, ids, edges)
    for directed in (True, False):
        got = {r.id: r.distance for r in paths.distances_from(nodes, rows, "n0", 4.0, directed=directed).collect()}
        want = {k: v / 10 for k, v in _dijkstra("n0", edges, paths.Weights(), directed).items() if v <= 40}
        assert got == want


def test_search_from_both_ends(spark):
    rng = random.Random(8)
    ids = [f"n{i:03d}" for i in range(150)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    kinds = ["CONTAINS", "CALLS", "IMPORTS", "other"]
    rows = [(*rng.sample(ids[:140], 2), rng.choice(kinds)) for _ in range(420)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string").cache()
    for source, target in [("n000", "n001"), ("n002", "n077"), ("n000", "n149"), ("n003", "n003"), ("n003", "lost"), ("lost", "lost")]:
        for weights in (paths.Weights(), paths.HOPS):
            want = paths.shortest_path(nodes, edges, source, target, weights).first().distance
            assert paths.distance_between(nodes, edges, source, target, weights).first().distance == want
    # On a tree of three children each, two frontiers reach far fewer rows than one.
    tree = [(f"t{(i - 1) // 3}", f"t{i}", "CALLS") for i in range(1, 1093)]
    tree_nodes = spark.createDataFrame([(f"t{i}",) for i in range(1093)], "id string")
    found = paths.distance_between(tree_nodes, spark.createDataFrame(tree, "src string, dst string, type string"), "t0", "t1092", paths.HOPS).first()
    assert found.distance == 6 and found.reached < 20


def test_toy_ranking_graph(spark):
    nodes, edges = _graph(
        spark, ["issue_1", "func_1", "func_2", "func_3"], [("issue_1", "func_2", "MENTIONS"), ("func_2", "func_3", "CALLS")]
    )
    got = {r.id: r.distance for r in paths.distances_from(nodes, edges, "issue_1", directed=False).collect()}
    assert got == {"issue_1": 0.0, "func_2": 2.0, "func_3": 3.2}
    path = paths.shortest_path(nodes, edges, "issue_1", "func_3").first()
    assert path.path == ["issue_1", "func_2", "func_3"] and path.distance == 3.2
    assert paths.shortest_path(nodes, edges, "issue_1", "func_1").first().path == []
    assert paths.shortest_path(nodes, edges, "func_1", "func_1").first().path == ["func_1"]
    assert paths.k_shortest_paths(nodes, edges, "issue_1", "func_1").count() == 0
    info = paths.path_info(
        spark.createDataFrame([("func_3", ["issue_1", "func_2", "func_3"]), ("x", ["func_1"])], "id string, path array<string>"),
        nodes, edges,
    )
    rows = {r.id: r for r in info.collect()}
    assert (rows["func_3"].length, rows["func_3"].total_weight) == (3, 3.2)
    assert [e.type for e in rows["func_3"].edges] == ["MENTIONS", "CALLS"]
    assert (rows["x"].length, rows["x"].total_weight, rows["x"].edges) == (1, 0.0, [])


def test_edge_weights_can_change():
    weights = paths.Weights().updated({"CALLS": 3.0, "default": 4.5})
    assert weights.as_dict()["CALLS"] == 3.0 and weights.as_dict()["default"] == 4.5


def test_fine_weights_stay_exact(spark):
    import pytest

    weights = paths.Weights().updated({"CALLS": 1.25, "MENTIONS": 0.04})
    assert weights.as_dict()["CALLS"] == 1.25 and weights.as_dict()["MENTIONS"] == 0.04
    assert weights.as_dict()["default"] == paths.Weights().as_dict()["default"]
    for bad in (0.0, -1.0, 1e-9):
        with pytest.raises(ValueError):
            paths.Weights().updated({"CALLS": bad})
    nodes, edges = _graph(spark, ["a", "b", "c"], [("a", "b", "CALLS"), ("b", "c", "MENTIONS")])
    got = {r.id: (r.distance, r.path) for r in paths.all_shortest_paths(nodes, edges, "a", weights=weights).collect()}
    assert got == {"a": (0.0, ["a"]), "b": (1.25, ["a", "b"]), "c": (1.29, ["a", "b", "c"])}


def test_k_shortest_paths_equal_enumeration(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(9)]
    links = sorted({(a, b, rng.choice(["CALLS", "MENTIONS", "USES"])) for _ in range(34) for a, b in [rng.sample(names, 2)]})
    nodes, edges = _graph(spark, names, links)
    weights = paths.Weights()
    cost = {}
    for a, b, kind in links:
        w = dict(weights.tenths).get(kind, weights.default)
        cost[a, b] = min(w, cost.get((a, b), w))
    every = []

    def walk(node, d, path):
        if node == "n8":
            return every.append((d, path))
        for (a, b), w in cost.items():
            if a == node and b not in path:
                walk(b, d + w, [*path, b])

    walk("n0", 0, ["n0"])
    want = sorted(every)[:7]
    got = sorted((r.distance, r.path) for r in paths.k_shortest_paths(nodes, edges, "n0", "n8", k=7).collect())
    assert len(every) > 7 and got == [(d / 10, p) for d, p in want]
    assert [r.path for r in paths.k_shortest_paths(nodes, edges, "n0", "n0", k=3).collect()] == [["n0"]]
    assert paths.k_shortest_paths(nodes, edges, "n0", "n8", k=3, published=True).count() == 1
    assert paths.k_shortest_paths(nodes, edges, "absent", "n8", k=3).count() == 0


def test_first_covering_interval(spark):
    rng = random.Random(1)
    spans = [0, 1, 2, 5, 7, 8, 15, 16, 31, 64, 100]
    intervals = [(rng.choice("abc"), low := rng.randint(0, 300), low + rng.choice(spans), i) for i in range(200)]
    points = [(rng.choice("abcd"), rng.randint(0, 420), i) for i in range(400)]
    got = first_covering(
        spark.createDataFrame(points, "k string, at int, pid int"),
        spark.createDataFrame(intervals, "k string, low int, high int, o int"),
        ["k"], "at", "low", "high", F.col("o"), F.col("o"), "hit", ["pid"],
    )
    want = {p: min([o for k, lo, hi, o in intervals if k == key and lo <= at <= hi], default=None) for key, at, p in points}
    assert {r.pid: r.hit for r in got.collect()} == want


def test_contained_pairs(spark):
    needles = [("s", n) for n in ("main", "src/main", "ab", "zzz", "a/b.py", "x")] + [("t", "main")]
    hay = [("s", h) for h in ("src/main/java", "domain", "a/b.py", "cab", "")] + [("t", "other")]
    got = contained_pairs(
        spark.createDataFrame(needles, "scope string, needle string"), spark.createDataFrame(hay, "scope string, hay string"), ["scope"]
    )
    want = {(s, n, h) for s, n in needles for t, h in hay if s == t and n in h}
    assert {(r.scope, r.needle, r.hay) for r in got.collect()} == want


def test_heavy_keys_are_spread_and_results_stay(spark, monkeypatch):
    monkeypatch.setattr(lookups, "ROWS_PER_TASK", 50)
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id"
    )
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    heavy = lookups.heavy_keys(rows, ["k"])
    assert [tuple(r) for r in heavy.collect()] == [("hot", 6)]
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = lookups.salted_lookup(rows, table, ["k"], how, heavy=heavy)
        want = rows.join(table, ["k"], how)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    nodes, edges = _graph(spark, ["hub", *[f"n{i}" for i in range(300)]], [("hub", f"n{i}", "CALLS") for i in range(300)])
    monkeypatch.setattr(paths, "BROADCAST_ROWS", 0)
    got = paths.distances_from(nodes, edges, "hub").collect()
    assert len(got) == 301 and {r.distance for r in got} == {0.0, 1.2}


def test_large_frontiers_leave_the_arcs_in_place(spark, monkeypatch):
    monkeypatch.setattr(paths, "BROADCAST_ROWS", 0)
    nodes, edges = _graph(spark, ["a", "b"], [("a", "b", "CALLS")])
    arcs = paths.prepare(edges)
    joined = arcs.leaving(spark.range(10).selectExpr("string(id) AS src", "0 AS d"), 10)
    plan = joined._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("Exchange hashpartitioning") <= 1
    assert joined.count() == 0


def test_wide_intervals(spark):
    bounds = [0, 1, 2**48, 2**49 + 1, 2**53 + 1, 2**55 + 12345, 2**60, 2**61 - 1, -(2**60)]
    intervals = [(a, b, i) for i, (a, b) in enumerate((x, y) for x in bounds for y in bounds if x <= y)]
    points = [p + d for p in bounds for d in (-1, 0, 1)]
    got = first_covering(
        spark.createDataFrame([("k", p) for p in points], "k string, at long"),
        spark.createDataFrame([("k", *i) for i in intervals], "k string, low long, high long, o int"),
        ["k"], "at", "low", "high", F.col("o"), F.col("o"), "hit", ["at"],
    )
    want = {p: min([o for lo, hi, o in intervals if lo <= p <= hi], default=None) for p in points}
    assert {r.at: r.hit for r in got.collect()} == want


def test_components_number_few_edges(spark, monkeypatch):
    """About an edge per node goes into the rounds, and an end that is no node links nothing."""
    import random

    from loomgraph.operators import components

    followed = []
    own = components.prepare

    def counted(edges, *args, **kwargs):
        followed.append(edges.count())
        return own(edges, *args, **kwargs)

    monkeypatch.setattr(components, "prepare", counted)
    rng = random.Random(4)
    names = [f"n{i}" for i in range(120)]
    group = {n: i % 3 for i, n in enumerate(names)}
    edges = [(a, b) for a in names for b in names if group[a] == group[b] and rng.random() < 0.5]
    edges += [("n0", "gone"), ("gone", "n1"), ("lone", "lone"), ("n2", None)]
    nodes = spark.createDataFrame([(n,) for n in [*names, "lone"]], "id string")
    for run in (7, 1_000_000):
        monkeypatch.setattr(components, "RUN_EDGES", run)
        got = {r.id: r.component for r in components.connected_components(nodes, spark.createDataFrame(edges, "src string, dst string")).collect()}
        assert got == {n: min(x for x in names if group[x] == g) for n, g in group.items()} | {"lone": "lone"}
    assert followed[-1] < 1000 < len(edges)


def test_statistics_of_many_types_group_pairs_by_hash(spark, monkeypatch):
    from loomgraph.operators import graph as property_graph

    monkeypatch.setattr(property_graph, "_MASK_BITS", 3)
    kinds = [None, *[f"T{i}" for i in range(8)]]
    edges = [(f"n{i % 5}", f"n{i % 7}", kinds[i % 9]) for i in range(400)] + [("n0", None, "T1"), ("n0", None, "T1")]
    frame = spark.createDataFrame(edges, "src string, dst string, type string")
    found = property_graph._edge_statistics(frame)
    want = {("relationship_types", k): len({e[:2] for e in edges if e[2] == k}) for k in kinds}
    assert {(r.metric, r.key): r.value for r in found.collect()} == want | {("total_edges", ""): len({e[:2] for e in edges})}
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_storable_edges_shuffle_once_for_an_end(spark, monkeypatch):
    from loomgraph import model
    from loomgraph.operators import lookups, tables

    monkeypatch.setattr(lookups, "ROWS_PER_TASK", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(f"c{i}", "class") for i in range(40)] + [("o", "commit")], "id string, type string")
        kind = next(k for k, ends in model.REL_ENDPOINTS.items() if ends == ("CodeEntity", "CodeEntity"))
        edges = [("c0", f"c{i % 40}", kind) for i in range(90)] + [(f"c{i % 9}", "c1", kind.lower()) for i in range(30)]
        edges += [("c0", "gone", kind), ("gone", "c0", kind), ("o", "c1", kind), ("c1", "o", kind), ("c1", "c2", "ODD"), (None, "c1", kind)]
        found = tables.storable_edges(nodes, spark.createDataFrame(edges, "src string, dst string, type string"))
        known = {f"c{i}" for i in range(40)}
        want = {(a, b, kind) for a, b, k in edges if a in known and b in known and k.upper() == kind}
        assert sorted(map(tuple, found.collect())) == sorted(want)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "hashpartitioning(src" in plan
        assert [line for line in plan.splitlines() if "hashpartitioning(src" in line and "dst#" in line] == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_k_shortest_paths_stay_where_the_source_leads(spark, monkeypatch):
    edges = [("s", "a", "CALLS"), ("a", "t", "CALLS"), ("s", "b", "CALLS"), ("b", "t", "USES")]
    edges += [(f"x{i}", "t", "CALLS") for i in range(300)] + [(f"y{i}", f"x{i}", "CALLS") for i in range(300)]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e[:2]})], "id string")
    searched, search = [], paths.search
    monkeypatch.setattr(paths, "search", lambda *a, **k: searched.append(search(*a, **k)) or searched[-1])
    found = paths.k_shortest_paths(nodes, spark.createDataFrame(edges, "src string, dst string, type string"), "s", "t", k=3)
    assert sorted(r.path for r in found.collect()) == [["s", "a", "t"], ["s", "b", "t"]]
    assert searched[0].count() == 4


def test_rounds_of_components_leave_one_state(spark, monkeypatch):
    from loomgraph.operators import components

    made, gone, stored, discard = [], [], components.stored, components.discard
    monkeypatch.setattr(components, "stored", lambda rows, **how: made.append(stored(rows, **how)) or made[-1])
    monkeypatch.setattr(components, "discard", lambda table: gone.append(table) or discard(table))
    nodes = spark.range(50).select(F.format_string("n%02d", "id").alias("id"))
    edges = spark.range(48).select(F.format_string("n%02d", "id").alias("src"), F.format_string("n%02d", F.col("id") + 2).alias("dst"))
    found = components.connected_components(nodes, edges)
    assert sorted({r.component for r in found.collect()}) == ["n00", "n01"]
    # The numbers, the links and the last state.
    assert gone and len(made) - len(gone) == 3

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.api import KnowledgeBase
from loomgraph.operators import incremental
from loomgraph.operators.extract import extract
from loomgraph.operators.graph import PropertyGraph, upsert_nodes
from loomgraph.plans import relevance
from loomgraph.sources import artifacts, snapshot
from loomgraph.sources.embedding_cache import cache_stats, fill_cache, read_cache
from loomgraph.functions.similarity import HashingEmbedder, levenshtein_similarity, matching_ratio
from loomgraph.functions import predicates as is_
from loomgraph.functions import text as texts
from loomgraph.sources.source_tree import parse_sources, read_source_tree
from loomgraph.streaming.changes import keep_events, latest_events
from tests.conftest import SAMPLE

ARTIFACTS = {
    "repository": {"owner": "o", "name": "r", "full_name": "o/r", "stars": 3},
    "pulls": [{"number": 1, "title": "Fix", "body": "b", "state": "open", "author": "a", "created_at": "2024-01-01",
               "updated_at": "2024-01-02", "files_changed": ["src/calc.py", "src/A.java", "gone.py"]}],
    "issues": [{"number": 7, "title": "Broken area", "body": "area fails", "state": "open", "author": "a",
                "created_at": "2024-01-01", "updated_at": "2024-01-03", "labels": ["bug"]},
               {"number": 8, "title": "a pull", "updated_at": "2024-01-04", "pull_request": "yes"}],
    "commits": [{"sha": "abcdef1234567890", "message": "change " * 20, "author": "a", "date": "2024-01-01",
                 "files_changed": ["src/calc.py"]}],
}


def _write(root, sources):
    for path, text in sources.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def test_project_life_cycle(spark, tmp_path):
    root = tmp_path / "project"
    _write(root, {**SAMPLE, "venv/skipped.py": "x = 1\n", "notes.txt": "no"})
    (tmp_path / "artifacts.json").write_text(json.dumps(ARTIFACTS))
    base = KnowledgeBase(spark, published=True)
    steps = []
    counts = base.analyze_project(str(root), str(tmp_path / "artifacts.json"), lambda n, s: steps.append(n))
    assert steps == [1, 2, 3, 4, 5]
    assert counts["files"] == 2 and counts["relationships"] == 16 + 2
    kinds = {r.type: r.cnt for r in base.graph.node_type_counts().collect()}
    assert (kinds["issue"], kinds["pull_request"], kinds["commit"], kinds["repository"]) == (1, 1, 1, 1)
    modifies = {(r.src, r.dst) for r in base.query_relationships(rel_type="MODIFIES").collect()}
    assert modifies == {("pr_1", "file_src_calc_py"), ("commit_abcdef12", "file_src_calc_py")}
    commit = base.query_entities(entity_type="commit").first()
    assert commit.name == "Commit abcdef12: " + ("change " * 20)[:50] + "..."
    assert base.query("neighbors", entity_id="src_calc_py_class_Calculator").count() == 2

    # Saved, exported and read back.
    assert base.save(str(tmp_path / "store")) == 1
    other = KnowledgeBase(spark, published=True)
    other.open(str(tmp_path / "store"))
    assert other.graph.nodes.count() == base.graph.nodes.count()
    base.export(str(tmp_path / "snapshot"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "snapshot")).collect()]
    assert sum(line["type"] == "metadata" for line in lines) == 1
    other.load(str(tmp_path / "snapshot"))
    triples = lambda b: {tuple(r) for r in b.graph.edges.select("src", "dst", "type").collect()}
    assert triples(other) == triples(base)

    # An issue starts the search but leads nowhere: all scores are 0 and order decides.
    ranked = base.relevance("area fails").collect()
    assert all(r.total_score == 0 for r in ranked) and ranked[0].entity_id == "src_calc_py_class_Calculator"

    # One file changes, one goes: the rebuilt links equal a full run.
    (root / "tests/test_calc.py").unlink()
    (root / "src/calc.py").write_text(SAMPLE["src/calc.py"] + "\ndef extra():\n    build()\n")
    update = base.update_project(str(root))
    assert update == {"files_added": 0, "files_modified": 1, "files_deleted": 1, "files_renamed": 0}
    fresh = KnowledgeBase(spark, published=True)
    fresh.analyze_project(str(root), str(tmp_path / "artifacts.json"))
    assert triples(base) == triples(fresh)
    kinds = {r.type for r in base.graph.nodes.select("type").distinct().collect()}
    assert {"repository", "pull_request", "issue"} <= kinds


def test_ranking_of_toy_graph(spark):
    nodes = spark.createDataFrame(
        [("issue_1", "login bug", "issue", ""), ("func_1", "a", "function", ""), ("func_2", "login", "function", "auth.py"),
         ("func_3", "check", "function", "auth.py")], "id string, name string, type string, file_path string")
    edges = spark.createDataFrame([("issue_1", "func_2", "MENTIONS"), ("func_2", "func_3", "CALLS")], "src string, dst string, type string")
    ranked = relevance.rank(PropertyGraph(nodes, edges), "login fails").collect()
    rows = {r.entity_id: r for r in ranked}
    assert [r.rank for r in ranked] == [1, 2, 3]
    assert rows["func_2"].path_decay_factor == pytest.approx(0.36)
    assert rows["func_3"].path_decay_factor == pytest.approx(0.6**3.2)
    assert rows["func_1"].path_length == float("inf") and rows["func_1"].total_score == 0
    assert rows["func_3"].path_info.length == 3 and rows["func_3"].path_info.node_types == ["issue", "function", "function"]
    no_issue = PropertyGraph(nodes.filter("type <> 'issue'"), edges.filter("type = 'CALLS'"))
    ranked = relevance.rank(no_issue, "zzz", mode=relevance.PUBLISHED).collect()
    assert {r.path_length for r in ranked} == {2.0}
    assert ranked[0].path_info.edges[0].type == "VIRTUAL_MENTIONS"
    for bad in ({"alpha": 1.5}, {"beta": 0.05}, {"top_k": 0}):
        with pytest.raises(ValueError):
            relevance.Hyperparameters(**bad)


def test_similarities(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("Same", "same"), ("", "")], "a string, b string")
    got = rows.select(levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), matching_ratio(F.col("a"), F.col("b")).alias("m")).collect()
    assert [round(r.l, 6) for r in got] == [0.571429, 1.0, 1.0]
    assert [round(r.m, 6) for r in got] == [0.615385, 1.0, 1.0]


def test_test_name_rules(spark):
    names = ["test_foo", "test_foo_bar", "testShouldCalcSum"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.t for r in rows.select("n", is_.test_target_names(is_.tested_name(F.col("n"))).alias("t")).collect()}
    assert got["test_foo"] == ["_foo", "", "_foo"]
    assert got["test_foo_bar"] == ["_foo_bar", "", "_foo", "_foo_bar", "foo", "foobar"]
    assert got["testShouldCalcSum"] == ["calcSum", "calc", "calcSum"]


def test_paths_and_urls(spark):
    rows = spark.createDataFrame([("a/b.c.py",), (".hidden",), ("plain",)], "p string")
    assert [r.s for r in rows.select(texts.stem(F.col("p")).alias("s")).collect()] == ["b.c", ".hidden", "plain"]
    urls = ["https://github.com/o/r.git", "git@github.com:o/r", "o/r/", "http://else/o/r", "x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.x and tuple(r.x) for r in rows.select(texts.repository_from_url(F.col("u")).alias("x")).collect()]
    assert got == [("o", "r"), ("o", "r"), ("o", "r"), None, None]
    folder = spark.createDataFrame([("/w/own_er_name",), ("/w/x",)], "p string")
    got = [r.x and tuple(r.x) for r in folder.select(texts.owner_and_name_from_folder(F.col("p")).alias("x")).collect()]
    assert got == [("own", "er_name"), None]


def test_upsert_keeps_absent_and_overwrites_given(spark):
    schema = "id string, name string, type string, file_path string, line_start bigint, from_module string"
    old = spark.createDataFrame([("a", "f", "function", "p", 3, "kept"), ("b", "g", "function", "p", 1, None)], schema)
    new = spark.createDataFrame([("a", "f2", "function", "p", None, None)], schema)
    rows = {r.id: r for r in upsert_nodes(old, new).collect()}
    assert (rows["a"].name, rows["a"].line_start, rows["a"].from_module) == ("f2", None, "kept")
    again = upsert_nodes(upsert_nodes(old, new), new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, upsert_nodes(old, new).collect()))


def test_edge_pairs_share_the_last_location(spark):
    edges = spark.createDataFrame(
        [("a", "b", "CREATES", 3, "x()", 1), ("a", "b", "USES", 9, "y()", 2), ("a", "b", "CALLS", None, None, 3)],
        "src string, dst string, type string, line bigint, call_text string, ord int")
    row = PropertyGraph(edges.select(F.col("src").alias("id")), edges).edge_pairs().first()
    assert (row.types, row.line, row.call_text) == (["CALLS", "CREATES", "USES"], 9, "y()")


def test_published_maintenance_isolates_files(spark, files):
    sources = {"a.py": "def one():\n    pass\n", "b.py": "def two():\n    one()\n"}
    found = extract(parse_sources(files(sources)), published=True)
    graph = PropertyGraph(found.entities.drop("scope", "ord"),
                          found.relationships.select("src", "dst", "type", "line", "call_text"))
    state = incremental.entity_state(found.entities).limit(0)
    changed = parse_sources(files({"b.py": "def two():\n    one()\n    return 1\n"}))
    gone = spark.createDataFrame([("a.py",)], "file_path string")
    result = incremental.apply_changes(graph, state, changed, deleted=gone)
    ids = {r.id for r in result.graph.nodes.collect()}
    # The link into the other file has become an unknown function.
    edges = {(r.src, r.dst, r.type) for r in result.graph.edges.collect()}
    assert ("b_py_function_two", "unknown_function_one", "CALLS") in edges
    assert "a_py_function_one" not in ids and "file_a_py" not in ids
    counters = result.counters.first()
    assert (counters.entities_added, counters.entities_removed, counters.files_processed) == (4, 2, 2)


def test_capped_artifacts(spark, tmp_path):
    pulls = [{"number": i, "title": "t", "updated_at": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}"} for i in range(250)]
    (tmp_path / "a.json").write_text(json.dumps({"repository": {"owner": "o", "name": "n"}, "pulls": pulls}))
    capped = artifacts.capped(artifacts.read_artifacts(spark, str(tmp_path / "a.json")))
    row = capped.first()
    assert len(row.pulls) == 200 and row.pulls[0].number == 249 and row.pulls[-1].number == 50
    assert len(artifacts.scanned(artifacts.read_artifacts(spark, str(tmp_path / "a.json"))).first().pulls) == 250
    nodes, _ = artifacts.artifact_graph(capped.withColumn("issues", F.array().cast(capped.schema["issues"].dataType)))
    assert nodes.filter("type = 'repository'").first().id == "repo_o/n"


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    path = str(tmp_path / "cache")
    fill_cache(rows, path, HashingEmbedder(8))
    fill_cache(rows, path, HashingEmbedder(8))
    assert cache_stats(read_cache(spark, path)).first().cached_embeddings == 2


def test_ranking_from_cached_vectors(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("i", "login fails", "issue", ""), ("f", "login", "function", "a.py"), ("g", "logout", "function", "a.py"), ("h", "login", "function", "a.py"),
         ("u", "unreachable", "function", "b.py")],
        "id string, name string, type string, file_path string",
    )
    edges = spark.createDataFrame([("i", "f", "MENTIONS"), ("f", "g", "CALLS"), ("g", "h", "CALLS")], "src string, dst string, type string")
    graph, path, columns = PropertyGraph(nodes, edges), str(tmp_path / "vectors"), ["entity_id", "rank", "total_score", "semantic_similarity"]
    want = relevance.rank(graph, "login fails", with_path_info=False).select(*columns).collect()
    for _ in range(2):
        got = relevance.rank(graph, "login fails", with_path_info=False, embedding_cache=path).select(*columns).collect()
        assert got == want
    # Equal texts are stored once, rows that nothing reaches are not embedded, and the second run added none.
    hashes = [r.text_hash for r in read_cache(spark, path).collect()]
    assert len(hashes) == len(set(hashes)) == 2


def test_snapshots_keep_columns_of_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "a", "class", "x"), ("b", "b", "class", "x")], "id string, name string, type string, file_path string")
    edges = spark.createDataFrame(
        [("a", "b", "CALLS", 3, 0.5, ["p", "q"], "n"), ("b", "a", "USES", None, None, None, None)],
        "src string, dst string, type string, line int, weight double, tags array<string>, name string",
    )
    snapshot.export_snapshot(PropertyGraph(nodes, edges), str(tmp_path / "s"))
    again = snapshot.import_snapshot(spark, str(tmp_path / "s"))
    for n in range(2):
        got = {r.type: (r.line, r.props) for r in again.edges.collect()}
        assert got["CALLS"] == (3, {"weight": "0.5", "tags": '["p","q"]', "name": "n"})
        assert got["USES"][0] is None and not got["USES"][1]
        snapshot.export_snapshot(again, str(tmp_path / f"t{n}"))
        again = snapshot.import_snapshot(spark, str(tmp_path / f"t{n}"))


def test_stream_keeps_the_last_version(spark, tmp_path):
    root, table = tmp_path / "src", str(tmp_path / "events")
    _write(root, {"r1/a.py": "def one():\n    pass\n", "r1/b.py": "x = f()\n"})
    keep_events(str(root), table, str(tmp_path / "cp"), spark).awaitTermination()
    _write(root, {"r2/a.py": "def uno():\n    pass\n"})
    keep_events(str(root), table, str(tmp_path / "cp"), spark).awaitTermination()
    names = {r.name for r in latest_events(spark, table).filter("kind = 'function'").collect()}
    assert names == {"uno"}


def test_stream_of_additions_changes_deletions_and_moves(spark, tmp_path):
    root, table = tmp_path / "src", str(tmp_path / "events")

    def functions():
        keep_events(str(root), table, str(tmp_path / "cp"), spark).awaitTermination()
        return {(r.file_path, r.name) for r in latest_events(spark, table).filter("kind = 'function'").collect()}

    body = "def {}():\n    pass\n".format
    _write(root, {"r1/a.py": body("a1"), "r1/p/b.py": body("b1"), "r1/c.py": body("c1")})
    assert functions() == {("a.py", "a1"), ("p/b.py", "b1"), ("c.py", "c1")}
    _write(root, {"r3/changes.jsonl": '{"old_path": "a.py", "new_path": null}\n{"old_path": "p/b.py", "new_path": "q/b.py"}\n\nbroken', "r3/q/b.py": body("b3")})
    assert functions() == {("q/b.py", "b3"), ("c.py", "c1")}
    # A revision that arrives late changes nothing that a later one has said.
    _write(root, {"r2/a.py": body("a2"), "r2/c.py": body("c2"), "r2/changes.jsonl": '{"old_path": "q/b.py"}'})
    assert functions() == {("q/b.py", "b3"), ("c.py", "c2")}
    # A path may come again, and within the revision that took it away too.
    _write(root, {"r4/a.py": body("a4"), "r4/changes.jsonl": '{"old_path": "a.py", "new_path": "d.py"}', "r4/d.py": body("d4")})
    assert functions() == {("q/b.py", "b3"), ("c.py", "c2"), ("a.py", "a4"), ("d.py", "d4")}


def test_update_of_a_new_attribute_and_statistics_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([("a", "x", "class", "f"), ("b", "y", None, "")], "id string, name string, type string, file_path string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "b", "USES")], "src string, dst string, type string")
    graph = PropertyGraph(nodes, edges)
    rows = {r.id: r.owner for r in graph.update_entity("a", {"owner": "me", "name": "z"}).nodes.collect()}
    assert rows == {"a": "me", "b": None}
    measured = {(r.metric, r.key): r.value for r in graph.statistics().collect()}
    assert measured == {
        ("node_types", "class"): 1, ("node_types", "unknown"): 1, ("total_nodes", ""): 2, ("files_covered", ""): 1,
        ("relationship_types", "CALLS"): 1, ("relationship_types", "USES"): 1, ("total_edges", ""): 1, ("largest_component_size", ""): 2,
    }
    empty = {(r.metric, r.key): r.value for r in graph.cleared().statistics().collect()}
    assert empty == {("total_nodes", ""): 0, ("files_covered", ""): 0, ("total_edges", ""): 0, ("largest_component_size", ""): 0}


def test_source_tree_paths(spark, tmp_path):
    _write(tmp_path / "p", {"a.py": "", "x/B.java": "class B {}", "node_modules/c.py": "", "d.txt": ""})
    got = {r.file_path for r in read_source_tree(spark, str(tmp_path / "p")).collect()}
    assert got == {"a.py", "x/B.java"}
    assert Counter(r.language for r in parse_sources(read_source_tree(spark, str(tmp_path / "p"))).filter("kind = 'file'").collect()) == {
        "python": 1, "java": 1}
    assert snapshot.graph_from_lines(spark.createDataFrame([('{"type": "metadata"}',)], "value string")).nodes.count() == 0


def test_repositories_keep_their_artifacts_apart(spark, tmp_path):
    for name in ("one", "two"):
        document = {
            "repository": {"owner": "o", "name": name, "full_name": f"o/{name}"},
            "pulls": [{"number": 1, "title": name, "updated_at": "2024", "files_changed": [f"{name}.py"]}],
            "issues": [{"number": 2, "title": name, "updated_at": "2024"}],
            "commits": [{"sha": "12345678" + name, "message": name, "files_changed": [f"{name}.py"]}],
        }
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    documents = artifacts.read_artifacts(spark, str(tmp_path))
    nodes, edges = artifacts.artifact_graph(artifacts.scanned(documents))
    assert nodes.count() == 8 and nodes.select("id").distinct().count() == 8
    assert {(r.src, r.dst) for r in edges.collect()} == {
        (f"{kind}_o/{name}{mark}", f"file_{name}_py") for name in ("one", "two") for kind, mark in (("pr", "#1"), ("commit", f"@12345678{name}"))
    }
    short, _ = artifacts.artifact_graph(documents, published=True)
    assert {r.id: r.title for r in short.filter("type = 'pull_request'").collect()} == {"pr_1": "one"}


def test_project_below_a_skipped_folder(spark, tmp_path):
    _write(tmp_path / "build" / "p", {"a.py": "x = 1", "e.py": "", "build/c.py": "y = 1"})
    root = str(tmp_path / "build" / "p")
    assert {r.file_path for r in read_source_tree(spark, root).collect()} == {"a.py", "e.py"}
    assert read_source_tree(spark, root, published=True).count() == 0


def test_long_texts_and_long_lists(spark):
    from loomgraph.functions import text as texts

    row = spark.createDataFrame([("function", "f", "x" * 900)], "type string, name string, code string")
    assert len(row.select(texts.entity_text(row.columns, None)).first()[0]) > 900 > len(row.select(texts.entity_text(row.columns)).first()[0])
    assert len(row.select(texts.problem_text(F.repeat("code", F.lit(5)), None)).first()[0]) == 4500
    nodes = spark.createDataFrame([(f"f{i}", f"login {i}", "function", "") for i in range(40)], "id string, name string, type string, file_path string")
    base = KnowledgeBase(spark)
    base.graph = PropertyGraph(nodes, spark.createDataFrame([], "src string, dst string, type string"))
    assert base.top_functions("login fails", k=30).count() == 30


def test_nothing_runs_before_an_action(spark):
    from loomgraph.plans.catalog import QUERIES
    from loomgraph.session import widen

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plans only")
    QUERIES["name_resolution_first_match"](spark, "/root/testdata/sf0.001")
    parse_sources(widen(spark.range(100).groupBy("id").count().selectExpr("concat(id, '.py') AS file_path", "binary('x') AS content")))
    # Reading a Parquet footer is the only job.
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("build")]
    assert all(len(j.stageIds) == 1 for j in jobs if j) and len(jobs) <= 3
    spark.sparkContext.setJobGroup("tests", "tests")

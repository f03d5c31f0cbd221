"""Paths, similarity and relevance on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import text as texts
from loomgraph.functions.similarity import (
    HashingEmbedder, cosine_similarity, matching_ratio,
)
from loomgraph.operators import paths
from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.text_topk import edit_similarities, edit_topk
from loomgraph.plans import relevance
from loomgraph.plans.registry import query
from loomgraph.plans.star_graph import STAR_SQL, star_graph, star_nodes, table
from loomgraph.session import widen
from loomgraph.session import ensure_checkpoint_dir

TYPED = paths.Weights()
UNIFORM = paths.Weights(uniform=True)

_WEIGHT_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in model.EDGE_WEIGHT_TENTHS.items()) + " ELSE 20 END"


def _arcs(weight: str, directed: bool, edges: str = "edges") -> str:
    """SQL: the lightest weight of every ordered pair."""
    back = "" if directed else f" UNION ALL SELECT dst, src, {weight} FROM {edges}"
    return f"""arcs AS (SELECT src, dst, min(w) AS w FROM (
      SELECT src, dst, {weight} AS w FROM {edges}{back}) x WHERE src <> dst GROUP BY src, dst)"""


def _dist(seeds: str, cutoff: int) -> str:
    """SQL: distances in tenths from the seed rows, relaxed until nothing improves."""
    return f"""dist(id, d) USING KEY (id) AS (
      {seeds}
      UNION
      SELECT a.dst, min(p.d + a.w) FROM dist p JOIN arcs a ON a.src = p.id
      LEFT JOIN recurring.dist cur ON cur.id = a.dst
      WHERE p.d + a.w <= {cutoff} AND (cur.d IS NULL OR p.d + a.w < cur.d) GROUP BY a.dst)"""


def _search_sql(weight: str, directed: bool, seeds: str, cutoff: int, extra: str = "") -> str:
    return f"WITH RECURSIVE {STAR_SQL}, {_arcs(weight, directed)}, {_dist(seeds, cutoff)}{extra}"


def _from(node: str) -> str:
    return f"SELECT '{node}', 0"


# -- distances -----------------------------------------------------------------------

@query("sssp_typed", _search_sql(_WEIGHT_SQL, True, _from("order:0"), 100) + " SELECT id, d / 10.0::DOUBLE AS distance FROM dist")
def sssp_typed(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    return paths.distances_from(graph.nodes, graph.edges, "order:0")


@query("sssp_uniform", _search_sql("20", False, _from("region:0"), 100) + " SELECT id, d / 10.0::DOUBLE AS distance FROM dist")
def sssp_uniform(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    return paths.distances_from(graph.nodes, graph.edges, "region:0", 10.0, UNIFORM, directed=False)


@query(
    "within_distance",
    _search_sql(_WEIGHT_SQL, False, _from("nation:0"), 32) + " SELECT id, d / 10.0::DOUBLE AS distance FROM dist",
)
def within_distance(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    return paths.within_distance(graph.nodes, graph.edges, "nation:0", 3.2, directed=False)


def _path_sql(weight: str, target: str, scale: str, found_only: bool = False) -> str:
    """SQL: walk back from the target along the smallest tight predecessor."""
    return (
        _search_sql(weight, True, _from("order:0"), 1000)
        + f""", back(node, d, path, hops) AS (
      SELECT id, d, id, 0 FROM dist WHERE id = '{target}'
      UNION ALL
      SELECT pick.id, pick.d, pick.id || '>' || back.path, back.hops + 1
      FROM back, LATERAL (SELECT p.id, p.d FROM arcs a JOIN dist p ON p.id = a.src
        WHERE a.dst = back.node AND p.d + a.w = back.d ORDER BY p.id LIMIT 1) pick
      WHERE back.d > 0)
    SELECT 'order:0' AS source, '{target}' AS target,
      coalesce((SELECT d FROM dist WHERE id = '{target}') / {scale}, 'infinity') AS distance,
      coalesce((SELECT path FROM back ORDER BY hops DESC LIMIT 1), '') AS path
    WHERE {not found_only} OR EXISTS (SELECT 1 FROM dist WHERE id = '{target}')"""
    )


@query("shortest_path", _path_sql(_WEIGHT_SQL, "region:1", "10.0::DOUBLE"))
def shortest_path(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    found = paths.shortest_path(graph.nodes, graph.edges, "order:0", "region:1")
    return found.withColumn("path", F.array_join("path", ">"))


@query("shortest_path_hops", _path_sql("1", "nation:2", "1.0::DOUBLE"))
def shortest_path_hops(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    found = paths.shortest_hops(graph.nodes, graph.edges, "order:0", "nation:2")
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "distance_between",
    f"SELECT source, target, distance FROM ({_path_sql(_WEIGHT_SQL, 'region:1', '10.0::DOUBLE')})",
)
def distance_between(spark, sf):
    """The length of ``shortest_path`` by a search from both ends."""
    graph = star_graph(spark, sf, distinct=False)
    return paths.distance_between(graph.nodes, graph.edges, "order:0", "region:1").select("source", "target", "distance")


@query("shortest_path_missing", "SELECT 'region:0' AS source, 'order:0' AS target, 'infinity'::DOUBLE AS distance, 0 AS hops")
def shortest_path_missing(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    found = paths.shortest_path(graph.nodes, graph.edges, "region:0", "order:0")
    return found.select("source", "target", "distance", F.size("path").alias("hops"))


@query("k_shortest_paths", _path_sql(_WEIGHT_SQL, "region:1", "10.0::DOUBLE", found_only=True))
def k_shortest_paths(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    found = paths.k_shortest_paths(graph.nodes, graph.edges, "order:0", "region:1", k=3, published=True)
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "k_shortest_loopless",
    f"""WITH RECURSIVE {STAR_SQL}, {_arcs(_WEIGHT_SQL, True)}, go(id, d, nodes) AS (
      SELECT 'order:0', 0, ['order:0']
      UNION ALL SELECT a.dst, d + a.w, list_append(nodes, a.dst) FROM go JOIN arcs a ON a.src = go.id
      WHERE NOT list_contains(nodes, a.dst) AND go.id <> 'region:1')
    SELECT 'order:0' AS source, 'region:1' AS target, d / 10.0::DOUBLE AS distance, array_to_string(nodes, '>') AS path
    FROM go WHERE id = 'region:1' ORDER BY d, nodes LIMIT 3""",
)
def k_shortest_loopless(spark, sf):
    graph = star_graph(spark, sf, distinct=False)
    found = paths.k_shortest_paths(graph.nodes, graph.edges, "order:0", "region:1", k=3)
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "all_shortest_paths",
    _search_sql(_WEIGHT_SQL, False, _from("nation:0"), 32) + """, par AS (
      SELECT a.dst AS id, min(p.id) AS parent FROM arcs a JOIN dist p ON p.id = a.src JOIN dist t ON t.id = a.dst WHERE p.d + a.w = t.d GROUP BY a.dst),
    way(id, path) AS (SELECT 'nation:0', 'nation:0' UNION ALL SELECT par.id, way.path || '>' || par.id FROM way JOIN par ON par.parent = way.id)
    SELECT id, d / 10.0::DOUBLE AS distance, path FROM way JOIN dist USING (id)""",
)
def all_shortest_paths(spark, sf):
    """A shortest path to every node near a nation."""
    graph = star_graph(spark, sf, distinct=False)
    found = paths.all_shortest_paths(graph.nodes, graph.edges, "nation:0", 3.2, directed=False)
    return found.withColumn("path", F.array_join("path", ">"))


_LINES = """lines AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)"""


@query(
    "path_info",
    f"""WITH {STAR_SQL}, {_arcs(_WEIGHT_SQL, True)}, paths AS (
      SELECT c.c_custkey AS k, 'order:' || o_orderkey AS a, 'customer:' || c_custkey AS b, 'nation:' || c_nationkey AS c
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
    SELECT a AS id, 3 AS length, (x.w + y.w) / 10.0::DOUBLE AS total_weight,
      'CALLS>BELONGS_TO' AS edge_types, 'order>customer>nation' AS node_types
    FROM paths JOIN arcs x ON x.src = a AND x.dst = b JOIN arcs y ON y.src = b AND y.dst = c""",
)
def path_info(spark, sf):
    """Details of the path from every order over its customer to the nation."""
    graph = star_graph(spark, sf)
    calls = graph.relationships(rel_type="CALLS").select(F.col("src").alias("id"), F.col("dst").alias("mid"))
    home = graph.relationships(rel_type="BELONGS_TO").select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    walked = calls.join(home, "mid").select("id", F.array("id", "mid", "end").alias("path"))
    info = paths.path_info(walked, graph.nodes, graph.edges)
    return info.select(
        "id", "length", "total_weight",
        F.array_join(F.transform("edges", lambda e: e["type"]), ">").alias("edge_types"),
        F.array_join("node_types", ">").alias("node_types"),
    )


# -- similarity ------------------------------------------------------------------------

def _first_vector(vectors) -> list[float]:
    return vectors.filter("vec_id = 0").select("embedding").first()[0]


_COSINE_SQL = """SELECT e.vec_id, round(greatest(0, (list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 1) / 2), 6)
      AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


@query("cosine_similarity", _COSINE_SQL)
def cosine_scores(spark, sf):
    vectors = table(spark, sf, "embeddings")
    wanted = F.array(*[F.lit(float(x)) for x in _first_vector(vectors)])
    return vectors.select("vec_id", F.round(cosine_similarity(F.col("embedding"), wanted), 6).alias("similarity"))


@query("cosine_topk", f"SELECT * FROM ({_COSINE_SQL}) ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf):
    return cosine_scores(spark, sf).orderBy(F.desc("similarity"), "vec_id").limit(20)


_PROBLEM = "the order service fails when a cold widget from brand 13 is missing"

# DuckDB's levenshtein counts bytes, Spark's characters.  Mapping each letter of
# the texts that takes several bytes to a control character of one makes the
# byte count the character count.
_LETTERS = "ßäçèéêíñóöü"
_LETTERS_SQL = f"'{_LETTERS}', " + " || ".join(f"chr({i})" for i in range(14, 14 + len(_LETTERS)))


def _one_byte(expression: str) -> str:
    return f"translate(lower({expression}), {_LETTERS_SQL})"


def _edit_similarity(a: str, b: str) -> str:
    left, right = _one_byte(a), _one_byte(b)
    return f"""CASE WHEN greatest(length({left}), length({right})) = 0 THEN 1.0::DOUBLE
      ELSE 1.0::DOUBLE - levenshtein({left}, {right}) / greatest(length({left}), length({right}))::DOUBLE END"""


@query(
    "text_edit_similarity",
    f"""SELECT doc_id, round({_edit_similarity("q.text", "d.text")}, 6) AS similarity
    FROM documents d, (SELECT text FROM benchmark WHERE item_id = 0) q""",
)
def text_edit_similarity(spark, sf):
    """Every document, whole, against one problem text."""
    problem = table(spark, sf, "benchmark").filter("item_id = 0").select("text").first()[0]
    found = edit_similarities(widen(table(spark, sf, "documents")), problem, "doc_id")
    return found.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    "text_edit_topk",
    f"""SELECT doc_id, similarity FROM (SELECT doc_id, round({_edit_similarity("q.text", "d.text")}, 6) AS similarity
    FROM documents d, (SELECT text FROM benchmark WHERE item_id = 0) q) ORDER BY similarity DESC, doc_id LIMIT 20""",
)
def text_edit_topk(spark, sf):
    """One item alone: its distances to all texts are computed side by side, which takes less than the steps of the bounds."""
    return text_edit_similarity(spark, sf).orderBy(F.desc("similarity"), "doc_id").limit(20)


@query(
    "text_edit_topk_items",
    f"""SELECT item_id, doc_id, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS r FROM (
        SELECT item_id, doc_id, round({_edit_similarity("q.text", "d.text")}, 6) AS similarity FROM documents d, benchmark q
        WHERE d.text IS NOT NULL AND q.text IS NOT NULL)) WHERE r <= 20""",
)
def text_edit_topk_items(spark, sf):
    """The documents most similar to every benchmark item."""
    found, _ = edit_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 20, "item_id", "doc_id")
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "similarity")


@query("text_matching_topk")
def text_matching_topk(spark, sf):
    """Ratcliff-Obershelp ratio of one problem text with every conversation turn."""
    found = matching_ratio(F.lit(_PROBLEM), F.col("text"))
    turns = widen(table(spark, sf, "conversations")).select("conv_id", "turn", F.round(found, 6).alias("similarity"))
    return turns.orderBy(F.desc("similarity"), "conv_id", "turn").limit(20)


@query(
    "problem_text",
    r"""SELECT doc_id, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '...' ELSE t END AS problem
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def problem_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", texts.problem_text(F.col("text")).alias("problem"))


@query(
    "entity_text",
    f"""WITH {STAR_SQL} SELECT id, concat_ws(' | ', CASE WHEN name <> '' THEN type || ': ' || name END,
    CASE WHEN file_path <> '' THEN 'in file: ' || file_path END) AS text FROM nodes""",
)
def entity_text(spark, sf):
    nodes = star_nodes(spark, sf)
    return nodes.select("id", texts.entity_text(nodes.columns).alias("text"))


def _hash_vector(text: str) -> str:
    """SQL: token counts over 64 md5 buckets."""
    return f"""list_transform(range(64), lambda b: len(list_filter(
      list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'),
        lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64), lambda h: h = b))::DOUBLE)"""


@query(
    "hashed_embedding",
    f"""SELECT item_id, array_to_string(list_transform({_hash_vector("text")}, lambda v: v::INT), ',') AS embedding
    FROM benchmark""",
)
def hashed_embedding(spark, sf):
    vector = F.transform(HashingEmbedder()(F.col("text")), lambda v: v.cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(vector.cast("array<string>"), ",").alias("embedding"))


@query(
    "embedding_cache_misses",
    """SELECT DISTINCT md5(text) AS text_hash FROM documents WHERE md5(text) NOT IN
    (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
)
def embedding_cache_misses(spark, sf):
    """Distinct texts that a cache filled from the labelled documents does not hold."""
    from loomgraph.sources.embedding_cache import cache_misses

    docs = table(spark, sf, "documents")
    cached = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return cache_misses(docs.select("text"), cached.select(F.md5("text").alias("text_hash"))).select("text_hash")


# -- relevance --------------------------------------------------------------------------

_TYPES = ["part", "supplier", "customer"]
_TYPES_SQL = "('part', 'supplier', 'customer')"


def _score_sql(search: str, limit: str) -> str:
    """SQL: the whole ranking, given a search that ends in ``dist``."""
    return f"""{search}, problem AS (SELECT '{_PROBLEM}' AS p),
    texts AS (SELECT n.*, d.d, concat_ws(' | ', type || ': ' || name,
        CASE WHEN file_path <> '' THEN 'in file: ' || file_path END) AS t
      FROM nodes n LEFT JOIN dist d ON d.id = n.id WHERE type IN {_TYPES_SQL}),
    parts AS (SELECT t.*, coalesce(list_cosine_similarity({_hash_vector("p")}, {_hash_vector("t")}), 0) AS c,
        1 - levenshtein(lower(p), lower(t)) / greatest(length(p), length(t))::DOUBLE AS lev
      FROM texts t, problem),
    scored AS (SELECT id AS entity_id, name AS entity_name, type AS entity_type, file_path,
        CASE WHEN d IS NULL THEN 0 ELSE greatest(0, (c + 1) / 2) END AS sem, CASE WHEN d IS NULL THEN 0 ELSE lev END AS txt,
        CASE WHEN d IS NULL THEN 'infinity'::DOUBLE ELSE d / 10.0::DOUBLE END AS path_length,
        CASE WHEN d IS NULL THEN 0 ELSE pow(0.6, d / 10.0::DOUBLE) END AS decay FROM parts),
    ranking AS (SELECT *, decay * (0.3::DOUBLE * sem + (1 - 0.3::DOUBLE) * txt) AS total FROM scored
      ORDER BY total DESC, entity_id {limit}),
    ranked AS (SELECT entity_id, entity_name, entity_type, file_path, round(total, 6) AS total_score,
        round(sem, 6) AS semantic_similarity, round(txt, 6) AS textual_similarity, path_length,
        round(decay, 6) AS path_decay_factor, total,
        (row_number() OVER (ORDER BY total DESC, entity_id))::INT AS "rank" FROM ranking)"""


def _rounded(ranked):
    names = ["total_score", "semantic_similarity", "textual_similarity", "path_decay_factor"]
    return ranked.withColumns({n: F.round(n, 6) for n in names})


_RANK_COLUMNS = """SELECT entity_id, entity_name, entity_type, file_path, total_score, semantic_similarity,
    textual_similarity, path_length, path_decay_factor, "rank" FROM ranked"""

_RANK_SQL = _score_sql(_search_sql(_WEIGHT_SQL, False, _from("nation:0"), 100), "LIMIT 20")
_HYPER = relevance.Hyperparameters()


def _rank(spark, sf, **options):
    return relevance.rank(
        star_graph(spark, sf, distinct=False), _PROBLEM, options.pop("hyper", _HYPER), start=options.pop("start", "nation:0"),
        types=_TYPES, **options,
    )


@query("relevance_rank", f"{_RANK_SQL} {_RANK_COLUMNS}")
def relevance_rank(spark, sf):
    return _rounded(_rank(spark, sf, with_path_info=False))


@query("relevance_rank_cached", f"{_RANK_SQL} {_RANK_COLUMNS}")
def relevance_rank_cached(spark, sf):
    """The ranking from stored vectors: the first run fills the cache, the second embeds nothing."""
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vectors_{uuid.uuid4().hex}"
    _rank(spark, sf, with_path_info=False, embedding_cache=cache)
    return _rounded(_rank(spark, sf, with_path_info=False, embedding_cache=cache))


@query(
    "relevance_path_info",
    f"""{_RANK_SQL} SELECT entity_id, "rank", path_length AS total_weight FROM ranked""",
)
def relevance_path_info(spark, sf):
    ranked = _rank(spark, sf)
    return ranked.select("entity_id", "rank", "path_info.total_weight")


_VIRTUAL_SEEDS = f"SELECT id, 20 FROM nodes WHERE type IN {_TYPES_SQL}"
_VIRTUAL_SQL = _score_sql(_search_sql(_WEIGHT_SQL, True, _VIRTUAL_SEEDS, 100), "LIMIT 20")


@query("relevance_rank_virtual_root", f"{_VIRTUAL_SQL} {_RANK_COLUMNS}")
def relevance_rank_virtual_root(spark, sf):
    """No issue and no test in the graph, so a virtual root points at every candidate type."""
    mode = relevance.RankingMode(directed=True)
    return _rounded(
        _rank(spark, sf, start=model.VIRTUAL_ROOT_ID, hyper=relevance.Hyperparameters(), mode=mode,
              virtual_types=_TYPES, with_path_info=False)
    )


@query("relevance_rank_published")
def relevance_rank_published(spark, sf):
    """Uniform weights, edges one way and the matching-block ratio."""
    return _rounded(
        _rank(spark, sf, start=model.VIRTUAL_ROOT_ID, hyper=relevance.Hyperparameters(),
              mode=relevance.PUBLISHED, virtual_types=_TYPES, with_path_info=False)
    )


@query(
    "relevance_quality",
    f"""{_RANK_SQL} SELECT count(*) AS total_candidates, count(*) FILTER (total > 0) AS non_zero_scores,
    round(avg(total), 6) AS score_mean, round(stddev_pop(total), 6) AS score_std, round(min(total), 6) AS score_min,
    round(max(total), 6) AS score_max, round(avg(path_length) FILTER (isfinite(path_length)), 6) AS path_length_mean,
    count(*) FILTER (isfinite(path_length)) AS reachable_entities FROM ranked""",
)
def relevance_quality(spark, sf):
    found = relevance.quality(_rank(spark, sf, with_path_info=False))
    doubles = ["score_mean", "score_std", "score_min", "score_max", "path_length_mean"]
    return found.withColumns({n: F.round(n, 6) for n in doubles})


@query(
    "relevance_score_distribution",
    f"""{_score_sql(_search_sql(_WEIGHT_SQL, False, _from("nation:0"), 100), "")} SELECT
    count(*) FILTER (total > 0.5) AS high, count(*) FILTER (total > 0.3) AS medium, count(*) FILTER (total > 0.1) AS low,
    round(max(total), 6) AS max_score, round(min(total), 6) AS min_score, round(avg(total), 6) AS mean_score FROM ranked""",
)
def relevance_score_distribution(spark, sf):
    """Over the scores of every candidate, not only the winners."""
    graph = star_graph(spark, sf, distinct=False)
    found = paths.search(paths.prepare(graph.edges, TYPED, directed=False), paths.seed(graph.nodes, "nation:0"), cutoff=100, parents=False)
    scores = relevance.score(graph.candidates(_TYPES), found, _PROBLEM, _HYPER, relevance.INTENDED)
    spread = relevance.score_distribution(scores)
    return spread.withColumns({n: F.round(n, 6) for n in ("max_score", "min_score", "mean_score")})


_TRUTH = ["supplier:3", "part:7", "supplier:5", "order:1"]


@query(
    "relevance_ground_truth",
    f"""{_RANK_SQL} SELECT count(*) AS found_entities, 4 AS total_entities, round(avg("rank"), 6) AS average_rank,
    min("rank") AS best_rank, coalesce(array_to_string(list_sort(list("rank")), ','), '') AS ranks
    FROM ranked WHERE entity_id IN ({", ".join(f"'{t}'" for t in _TRUTH)})""",
)
def relevance_ground_truth(spark, sf):
    found = relevance.ground_truth_ranks(_rank(spark, sf, with_path_info=False), _TRUTH)
    return found.withColumns(
        {"average_rank": F.round("average_rank", 6), "ranks": F.array_join(F.col("ranks").cast("array<string>"), ",")}
    )


@query(
    "relevance_top_functions",
    f"""{_RANK_SQL} SELECT entity_id, entity_name AS name, entity_type AS type, total_score AS relevance_score,
    semantic_similarity, textual_similarity, path_length FROM ranked WHERE "rank" <= 5""",
)
def relevance_top_functions(spark, sf):
    return relevance.top_functions(_rounded(_rank(spark, sf, with_path_info=False)), 5)


@query(
    "start_node_best_issue",
    f"""SELECT 'conversation:' || conv_id AS start FROM (SELECT conv_id, {_edit_similarity("p", "t")} AS sim FROM
      (SELECT conv_id, '{_PROBLEM}' AS p, 'Conversation ' || conv_id || ' ' || text AS t FROM conversations WHERE turn = 0))
    WHERE sim > 0 ORDER BY sim DESC, 'conversation:' || conv_id LIMIT 1""",
)
def start_node_best_issue(spark, sf):
    """Conversations as issues: the one closest to the problem starts the search."""
    opening = table(spark, sf, "conversations").filter("turn = 0")
    issues = opening.select(
        F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("name"),
        F.lit("issue").alias("type"), F.lit("").alias("file_path"), F.col("text").alias("body"),
    )
    edges = issues.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("type"))
    start = relevance.start_node(PropertyGraph(issues, edges), _PROBLEM)
    return spark.range(1).select(F.lit(start).alias("start"))

"""Top-k by edit similarity against computing every distance."""

import random

from loomgraph.operators import text_topk


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    a, b = a.lower(), b.lower()
    longest = max(len(a), len(b))
    return round(1.0 - edits(a, b) / longest, 6) if longest else 1.0


def brute(queries, texts, k):
    want = []
    for q, a in queries:
        ranked = sorted((-similarity(a, b), key) for key, b in texts if b is not None and key is not None) if a is not None else []
        want += [(q, key, -s) for s, key in ranked[:k]]
    return sorted(want)


def run(spark, queries, texts, k):
    found, distances = text_topk.edit_topk(
        spark.createDataFrame(queries, "item int, text string"), spark.createDataFrame(texts, "id long, text string, query string"), k, "item", "id"
    )
    return sorted((r["query"], r.key, r.similarity) for r in found.collect()), distances


def test_equals_all_distances(spark, monkeypatch):
    monkeypatch.setattr(text_topk, "BLOCK", 2)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß.") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, some(rng.randint(1, 25)), "x") for i in range(300)]
    texts += [(300, None, "x"), (301, "", "x"), (302, texts[7][1], "x"), (303, texts[7][1].upper(), "x")]
    queries = [(0, texts[7][1]), (1, texts[9][1] + " more"), (2, ""), (3, None), (4, texts[20][1][::-1])]
    got, distances = run(spark, queries, texts, 3)
    assert got == brute(queries, [(i, t) for i, t, _ in texts], 3)
    assert distances <= 4 * 303


def test_computes_few_distances_where_near_texts_exist(spark):
    rng = random.Random(10)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    queries = [(q, some(rng.randint(20, 90))) for q in range(6)]
    texts = [(i, some(rng.randint(5, 120)), "") for i in range(200)]
    texts += [(1000 + 10 * q + j, text[:j] + "#" + text[2 * j :], "") for q, text in queries for j in range(4)]
    got, distances = run(spark, queries, texts, 3)
    assert got == brute(queries, [(i, t) for i, t, _ in texts], 3)
    assert distances < 0.1 * 6 * 224


def test_fewer_texts_than_k_and_empty_tables(spark):
    got, _ = run(spark, [(0, "abc")], [(1, "abd", ""), (2, "abc", "")], 5)
    assert got == [(0, 1, 0.666667), (0, 2, 1.0)]
    assert run(spark, [], [(1, "a", "")], 5) == ([], 0)
    assert run(spark, [(0, "a")], [], 5) == ([], 0)


def test_one_pass_gives_the_edits_to_many_queries():
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abß😀") for _ in range(n))
    for _ in range(200):
        queries, text = [some(rng.randint(0, 70)) for _ in range(rng.randint(0, 5))], some(rng.randint(0, 80))
        got = text_topk.edits_to(text, [(len(q), text_topk.letter_places(q)) for q in queries])
        assert got == [edits(q, text) for q in queries]


def test_a_text_travels_once_for_all_queries(spark, monkeypatch):
    passes = spark.sparkContext.accumulator(0)
    one_pass = text_topk.edits_to

    def counted(text, queries):
        passes.add(1)
        return one_pass(text, queries)

    monkeypatch.setattr(text_topk, "edits_to", counted)
    texts = [(i, "ab" * (i % 3 + 1), "") for i in range(30)]
    _, distances = run(spark, [(q, "ab" * (q + 1)) for q in range(6)], texts, 3)
    assert distances >= 60 and 0 < passes.value < distances


def test_one_problem_walks_over_many_texts_side_by_side(spark, monkeypatch):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abß😀\0") for _ in range(n))
    for limit in (1, 60, 1 << 17):
        monkeypatch.setattr(text_topk, "BLOCK_CHARS", limit)
        for _ in range(40):
            problem, texts = some(rng.randint(0, 70)), [some(rng.randint(0, 80)) for _ in range(rng.randint(0, 9))]
            assert text_topk.edits_from(problem, texts) == [edits(problem, text) for text in texts]
    texts = [(i, some(i % 40).upper(), "x") for i in range(50)] + [(50, None, "x"), (None, "Ab", "x")]
    frame = spark.createDataFrame(texts, "id long, text string, query string")
    for problem in ("ABß a", ""):
        got = text_topk.edit_similarities(frame, problem, "id").collect()
        want = [(key, None if text is None else similarity(problem, text)) for key, text, _ in texts]
        assert sorted(map(str, ((r.id, r.similarity and round(r.similarity, 6)) for r in got))) == sorted(map(str, want))
    assert [r.similarity for r in text_topk.edit_similarities(frame, None, "id").collect()] == [None] * 52


def test_queries_of_one_item_make_no_table_per_pair(spark):
    from loomgraph.plans import catalog

    for name in ("text_edit_similarity", "text_edit_topk"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "levenshtein" not in plan

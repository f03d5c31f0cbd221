"""Merkle manifest, ranked lexical search and suffix buckets against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lexical_blas, merkle_log, suffix_buckets


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, index):
    found = []
    for nodes in levels[:-1]:
        start = index - index % 3
        found += [(nodes[start:index], nodes[index + 1 : start + 3])]
        index //= 3
    return found


@pytest.mark.parametrize("size", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82, 245])
def test_positions_are_those_of_a_postorder_walk(size):
    top, order = merkle_log.height(size), []

    def walk(level, index):
        if level:
            for child in range(index * 3, min(index * 3 + 3, merkle_log.level_nodes(size, level - 1))):
                walk(level - 1, child)
        order.append((level, index))

    walk(top, 0)
    assert [merkle_log.position(level, index, size) for level, index in order] == list(range(len(order)))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_equal_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = []
    for i in range(400):
        source = None if i % 7 == 0 else "hot" if i % 3 else f"s{rng.randrange(12)}é"
        text = None if i % 11 == 0 else "" if i % 13 == 0 else "a\nb ü" * rng.randrange(1, 5)
        rows.append((i * 3, source, "en" if i % 2 else None, None if i % 5 == 0 else i, text, "extra"))
    rows += [(0, None, None, 0, "x\n", "twice"), (0, None, None, 0, "x\n", "twice"), (None, "hot", None, None, None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, `index` string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proofs, root = merkle_log.manifest(docs, changed, levels=levels)
    got = [r.asDict(recursive=True) for r in proofs.collect()]

    def leaf(row, text):
        cells = [*row[:4], text]
        return sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {g: levels_of([leaf(r, r[4]) for r in groups[g]]) for g in names}
    over = levels_of([trees[g][-1][0] for g in names])
    assert root == over[-1][0]
    want = []
    for s, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            way = siblings(trees[g], i) + siblings(over, s)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for left, right in way:
                folded = sha("".join([*left, folded, *right]))
            want.append((str(row[0]), leaf(row, row[4]), trees[g][-1][0], "".join("".join(a + b) for a, b in way), folded))
    found = [(str(r["doc_id"]), r["leaf"], r["subroot"], "".join(p["left"] + p["right"] for p in r["path"]), r["folded_root"]) for r in got]
    assert sorted(found) == sorted(want)
    assert {r["root"] for r in got} == {root}
    assert any(r["folded_root"] != root for r in got) and any(r["folded_root"] == root for r in got)


def test_log_is_in_completion_order(spark):
    leaves = spark.range(100).select(F.lit("").alias("g"), F.col("id").alias("index"), F.lit(100).cast("bigint").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    log = merkle_log.append_log(leaves, levels=2)
    rows = sorted((r["position"], r["level"], r["index"], r["digest"]) for tier in log.tiers[:1] for r in tier.collect())
    for more in log.tiers[1:]:
        rows += [(r["position"], r["level"], r["index"], r["digest"]) for r in more.collect() if r["level"] % 2 or r["level"] > 2]
    tree = levels_of([sha(str(i)) for i in range(100)])
    want = {(merkle_log.position(level, i, 100), level, i, d) for level, nodes in enumerate(tree) for i, d in enumerate(nodes)}
    assert set(rows) == want
    assert sorted(p for p, *_ in want) == list(range(len(want)))


def test_empty_manifest(spark, docs):
    proofs, root = merkle_log.manifest(docs([]).withColumn("n_chars", F.lit(1)))
    assert root is None and proofs.count() == 0


def ranked(docs, items, k):
    cut = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    bags = [(d, Counter(cut.findall((t or "").translate(low)))) for d, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        query = Counter(cut.findall((text or "").translate(low)))
        scores = []
        for d, bag in bags:
            score = 0
            for term, times in query.items():
                if term in bag:
                    m = 25 + (75 * sum(bag.values()) * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * (10**9 * bag[term] // (1000 * bag[term] + 8 * m))
            if score > 0:
                scores.append((-score, d))
        out += [(item, n, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_lexical_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "x9", "naïve"]
    text = lambda n: rng.choice([" ", "_", "\x7f", "\n"]).join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    docs = [(i, None if i == 5 else "" if i == 6 else text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[20][1]) for i in range(40)] + [(400, "...")]
    items = [(i, text(rng.randrange(1, 30))) for i in range(20)] + [(50, None), (51, "unheard"), (52, "w1 " * 500)]
    want = ranked(docs, items, 10)
    d = spark.createDataFrame([(*row, 1, 2) for row in docs], "doc_id bigint, text string, score int, `rank` int").repartition(5)
    q = spark.createDataFrame([(*row, "x") for row in items], "item_id bigint, text string, term string")
    for options in ({}, {"tile_terms": 3, "tile_docs": 7}, {"block_items": 4}):
        got = [tuple(r) for r in lexical_blas.rank(d, q, **options).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got) == sorted(want)
    assert lexical_blas.rank(d.limit(0), q).count() == 0
    assert lexical_blas.rank(d, q.limit(0)).count() == 0


def test_tiles_bound_partial_sums():
    most = np.array([2**50, 1, 2**52, 2**40], np.int64)
    at, item, times = np.array([0, 1, 2, 3, 0]), np.array([0, 0, 0, 0, 1]), np.array([20, 5, 3, 1, 7])
    seen = Counter()
    for columns, counts in lexical_blas.tiles(at, item, times, most, 2, tile_terms=2):
        assert len(columns) <= 2 and len(set(columns.tolist())) == len(columns)
        for i in range(2):
            assert sum(int(c) * int(most[p]) for p, c in zip(columns, counts[:, i])) < 2**53
        for row, place in enumerate(columns.tolist()):
            for i in range(2):
                seen[place, i] += int(counts[row, i])
    assert {k: v for k, v in seen.items() if v} == {(0, 0): 20, (1, 0): 5, (2, 0): 3, (3, 0): 1, (0, 1): 7}


def test_repeats_beyond_one_exact_product(spark):
    """Scores stay exact where an item repeats a term more often than one product may hold."""
    docs = [(0, "a b c"), (1, "a a a b"), (2, "c c")] + [(i, "z") for i in range(3, 40)]
    weights = np.array([lexical_blas.weight(40, 2)] * 2)
    n, at, tf, lengths = np.array([3, 4]), np.array([0, 1, 0]), np.array([1, 1, 3]), np.array([2, 1])
    count = 10**9
    blocks = list(lexical_blas.tiles(np.array([0, 1]), np.array([0, 0]), np.array([count, 1]), weights * 10**6, 1))
    assert len(blocks) > 1
    got = lexical_blas.tile_scores(n, at, tf, lengths, weights, 40, 60, blocks)
    m = 25 + (75 * n * 40) // 60
    one = [int(weights[0]) * (10**9 * t // (1000 * t + 8 * int(m[d]))) for d, t in ((0, 1), (0, 1), (1, 3))]
    assert got[:, 0].tolist() == [count * one[0] + one[1], count * one[2]]
    assert lexical_blas.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "a a c")], "item_id int, text string")).count() == 3


def without_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    many = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if many[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((bytes(c for c, g in zip(b, gone) if not g), spans))
    return out


@pytest.mark.parametrize("length,gram", [(24, 8), (20, 16), (200, 64)])
def test_suffix_buckets_equal_brute_force(spark, monkeypatch, length, gram):
    monkeypatch.setattr(suffix_buckets, "PART_BYTES", 500)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdeé\n") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(3, 120))) for _ in range(12)]
    texts = [None, "", "short", "a" * 1500, "ab" * 700, "abc" * (length // 3 + 1)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts += [" ".join(word() for _ in range(rng.randrange(0, 30))), p[a:b] if rng.random() < 0.7 else p]
        texts.append(" ".join(parts))
    texts += [texts[10]] * 3 + [texts[12][:-1], texts[13][1:]]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int, kept int").repartition(4)
    got = {r["row"]["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["removed"]]) for r in suffix_buckets.remove_repeats(docs, length=length, gram=gram).collect()}
    want = dict(enumerate(without_repeats(texts, length)))
    assert got == want
    assert any(spans for _, spans in want.values()) and any(not spans for _, spans in want.values())


def test_suffix_buckets_of_an_empty_table(spark, docs):
    assert suffix_buckets.remove_repeats(docs([])).count() == 0

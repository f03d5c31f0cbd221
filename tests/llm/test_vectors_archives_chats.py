import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_snapshots as cs
from loomgraph.llm import posting_ann as pa
from loomgraph.llm import warc_zstd as wz
from loomgraph.llm.shared import scratch_folder


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double")


def test_search_reaches_the_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    points = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.5).astype(np.float32)
    points[2000:2400] = points[7] + rng.normal(size=(400, 16)) * 0.01
    points *= rng.uniform(0.5, 2, (3000, 1))
    table = vectors(spark, [(i, p.tolist(), 0, 0.5) for i, p in enumerate(points)])
    got = defaultdict(list)
    for r in pa.nearest(table, lambda c: c % 20 == 0).collect():
        got[r.query_id].append(r)
    scores = points.astype(float) @ points.astype(float).T
    hits = 0
    for q in range(0, 3000, 20):
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id)) and all(r.vec_id != q for r in rows)
        own = scores[q].copy()
        own[q] = -np.inf
        hits += len({r.vec_id for r in rows} & set(np.argsort(-own, kind="stable")[:20].tolist()))
    assert len(got) == 150 and hits / (150 * 20) >= 0.9


def test_equal_vectors_and_those_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(i, [1.0, 1.0], 0, 0.0) for i in range(60)] + [(60, [2.0, 0.5], 0, 0.0)] * 2 + [(i, v, 0, 0.0) for i, v in bad]
    got = defaultdict(list)
    for r in pa.nearest(vectors(spark, rows), lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 20, 40, 60}
    assert got[0] == [60, *range(1, 20)] and got[20] == [60, *range(19)] and got[60] == list(range(20))
    assert pa.nearest(vectors(spark, []), lambda c: c >= 0).count() == 0
    assert pa.nearest(vectors(spark, [(0, [1.0], 0, 0.0)]), lambda c: c >= 0).count() == 0


def test_centroids_are_balanced_even_among_equal_points():
    rng = np.random.default_rng(2)
    sample = np.concatenate([rng.normal(size=(400, 4)), np.ones((400, 4))])
    centres = pa.balanced_centroids(sample, 20)
    assert 10 <= len(centres) <= 200 and np.isfinite(centres).all()
    graph = pa.CentroidGraph(centres)
    found = graph.near(sample[:50], 10.0)
    assert np.allclose(found.min(1), np.sqrt(pa.squared_distances(sample[:50], centres)).min(1))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string, payload string")


def test_centroids_are_fitted_with_few_distances_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(6000, 4))
    whole = pa.balanced_centroids(sample, 300)
    sizes, plain = [], pa.squared_distances
    monkeypatch.setattr(pa, "FIT_DISTANCES", 10_000, raising=False)
    monkeypatch.setattr(pa, "squared_distances", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    # One row's distances are the least that is held.
    assert np.allclose(pa.balanced_centroids(sample, 300), whole)
    assert max(sizes) <= 10_000


def test_archives_round_trip(spark):
    import hashlib

    rng = random.Random(1)
    html = ["<p>" + "".join(rng.choice("abc é世") for _ in range(n)) for n in (10, 99, 200, 500, 5000)]
    rows = [(i, f"http://h/{i}" if i % 5 else None, html[rng.randrange(5)] if i % 7 else None, "x", "y") for i in range(300)]
    rows += [(rows[1][0], *rows[1][1:])] * 2 + [(None, None, html[4], "x", "y"), (301, "http://a\r\nX: y", "", "x", "y"), (302, "u", "z" * 3_000_000, "x", "y")]
    folder = scratch_folder(spark, "warc")
    files = wz.archive_pages(pages(spark, rows), folder).collect()
    assert sum(f.records for f in files) == len(rows)
    first = {}
    for page, _, body, *_ in rows:
        if page is not None and len((body or "").encode()) >= wz.MIN_REVISIT:
            first[body] = min(page, first.get(body, page))
    want = Counter()
    for page, _, body, *_ in rows:
        data = (body or "").encode()
        other = body in first and first[body] != page
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", first[body] if other else None] += 1
    assert Counter(tuple(r) for r in wz.page_records(spark, folder).collect()) == want
    full = wz.read_archives(spark, f"{folder}/archives").collect()
    by_page = {(p, u): (b or "").encode() for p, u, b, *_ in rows}
    for r in full:
        if r.record_type == "response" and r.page_id != 301:
            assert bytes(r.payload) == by_page[r.page_id, r.url]
    # Each record can be read alone, by its offset, with the dictionary in front of the file.
    content = {f.path: f.content for f in spark.read.format("binaryFile").load(f"{folder}/archives").collect()}
    some = [r for r in full if r.record_type == "response"][:5]
    for r in some:
        data = bytes(content[r.path])
        assert r.offset in dict(wz.archive_records(data))
        assert int.from_bytes(data[:4], "little") == wz.DICTIONARY_FRAME


def test_no_pages_and_broken_archives(spark):
    folder = scratch_folder(spark, "warc")
    wz.archive_pages(pages(spark, []), folder)
    assert wz.page_records(spark, folder).count() == 0
    whole = wz.archive_bytes([b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"] * 3)
    assert len(list(wz.archive_records(whole))) == 3
    with pytest.raises(ValueError):
        list(wz.archive_records(whole[:-3]))
    with pytest.raises(ValueError):
        list(wz.archive_records(b"\0" * 20))


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint, place string")


def brute_chats(rows):
    held = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        held[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    full = {c: tuple(t[2:] for t in sorted(v)) for c, v in held.items()}
    kept = {}
    for c, turns in full.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in full.values())
        equal = [d for d, o in full.items() if o == turns and d is not None]
        if not longer and c == (min(equal) if equal else None):
            kept[c] = "".join(f"<|{r}|>\n{t}\n" for _, r, _, t in turns)
    return kept


@pytest.mark.parametrize("block", [2, 256])
def test_snapshots_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cs, "BLOCK_TURNS", block)
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        base = random.Random(rng.randint(0, 12))
        turns = [(base.choice(["user", "assistant", None]), base.choice(["hi", "yes", "no", "", None])) for _ in range(8)][: rng.randint(1, 8)]
        rows += [(conv, n * 3 if conv % 2 else n, role, text, 1, "x") for n, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "alone", 1, "x"), (900, None, "user", "hi", 1, "x"), (900, 1, "user", "b", 1, "x"), (900, 1, "user", "b", 1, "x"), (901, 0, "user", "w " * 50_000, 1, "x")]
    got = defaultdict(list)
    for r in cs.collapse(chats(spark, rows)).collect():
        got[r.conv_id].append(r)
    joined = {c: "".join(r.text for r in sorted(v, key=lambda r: r.part)) for c, v in got.items()}
    assert joined == brute_chats(rows)
    assert all(sorted(r.part for r in v) == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("numbers", [range(250, 261), range(600), [n * 1_000_003 for n in range(40)]])
def test_a_conversation_is_one_row(spark, numbers):
    rows = [(conv, n, "user", f"t{n}", 1, "x") for conv in (1, 2) for n in numbers if conv == 1 or n != max(numbers)]
    got = cs.collapse(chats(spark, rows)).collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, len(numbers))]
    assert got[0].text == "".join(f"<|user|>\nt{n}\n" for n in numbers)


def test_no_conversations(spark):
    assert cs.collapse(chats(spark, [])).count() == 0

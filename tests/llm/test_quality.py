import math
import random
import re

import numpy as np

from loomgraph.llm import quality_mcd as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)]


def test_counts_equal_brute_force(docs):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a " * 50, "é# ü$\n\né# ü$\n x", "word " * 30_000]
    texts += ["".join(rng.choice("ab é#\n\t\x0b|") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(8, 80))) for _ in range(100)]
    got = {r.row.doc_id: r for r in q.judge(docs(texts), keep=["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = counts(text)
        assert [got[i][c] for c in q.COUNTS] == want, repr(text[:80])
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].kept and got[i].base_failed)


FLOOR = np.diag(np.array(list(q.FLOORS.values())) ** 2)


def concentrated(x, centre, cov):
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    rank = np.floor(256 * np.log1p(d)).astype(int)
    core = x[rank <= np.sort(rank)[math.ceil(q.CORE_SHARE * len(x)) - 1]]
    centre = core.mean(0)
    return centre, q.CONSISTENCY * (core.T @ core / len(core) - np.outer(centre, centre)) + FLOOR


def converged(x, centre, cov):
    for _ in range(50):
        after = concentrated(x, centre, cov)
        if np.linalg.det(after[1]) >= 0.9999 * np.linalg.det(cov):
            return centre, cov
        centre, cov = after
    return centre, cov


def least_determinant(x):
    """The four starts, two steps each, then steps from the best until its determinant stays."""
    middle = lambda v: np.sort(v, axis=0)[math.ceil(0.5 * len(v)) - 1]
    centre = middle(x)
    scale = np.sqrt((q.NORMAL_MAD * middle(abs(x - centre))) ** 2 + np.diag(FLOOR))
    z = (x - centre) / scale
    norm = np.sqrt((z * z).sum(1))[:, None]
    forms = [np.sign(z), np.clip(z, -q.WINSOR, q.WINSOR), np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)]
    forms = [np.floor(u * q.SCALE + 0.5) / q.SCALE for u in forms]
    found = [np.diag(scale**2)] + [np.outer(scale, scale) * (u.T @ u / len(u) + q.RIDGE * np.eye(len(scale))) for u in forms]
    found = [(centre, cov) for cov in found]
    for _ in range(q.SCREEN_STEPS):
        found = [concentrated(x, *f) for f in found]
    best = min(found, key=lambda f: np.linalg.det(f[1]))
    for _ in range(q.MOST_STEPS):
        after = concentrated(x, *best)
        if np.linalg.det(after[1]) >= q.FALL * np.linalg.det(best[1]):
            break
        best = after
    return best


def reference_verdicts(vectors, groups):
    keep = {}
    for name in set(groups.values()):
        ids = sorted(i for i in groups if groups[i] == name)
        x = np.array([vectors[i] for i in ids]) / q.SCALE
        centre, cov = least_determinant(x)
        final = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        keep |= dict(zip(ids, final <= q.CUTOFF, strict=True))
    return keep


def test_determinant_reaches_that_of_many_random_starts(spark):
    rng = np.random.default_rng(11)
    rows, by_group = [], {}
    for g, share in enumerate([0.0, 0.1, 0.22]):
        mix = rng.normal(size=(5, 5))
        clean = rng.normal(size=(int(600 * (1 - share)), 5)) @ mix
        # Outliers in one place, which pull a mean and hide behind a wide covariance.
        away = rng.normal(size=(600 - len(clean), 5)) * 0.3 + 12 * np.linalg.svd(mix)[2][-1]
        x = np.floor(np.vstack([clean, away]) * q.SCALE).astype(int)
        by_group[str(g)] = (x / q.SCALE, len(clean))
        rows += [(str(g), "s", 0, *map(int, v)) for v in x]
    vectors = spark.createDataFrame(rows, "elang string, esource string, row int, " + ", ".join(f"{x} bigint" for x in q._XS))
    found = {r.elang: r for r in q.estimates(vectors, 3).collect()}
    for g, (x, n_clean) in by_group.items():
        tries = []
        for _ in range(100):
            some = x[rng.choice(len(x), 6, replace=False)]
            tries.append(np.linalg.det(converged(x, *concentrated(x, some.mean(0), np.cov(some.T) + FLOOR))[1]))
        assert found[g].det <= 1.03 * min(tries)
        assert math.isclose(found[g].det, np.linalg.det(least_determinant(x)[1]), rel_tol=1e-6)
        w = np.array([[found[g][f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        m = np.array([found[g][f"m{i}"] for i in range(5)])
        far = (((x - m) @ w.T) ** 2).sum(1) > q.CUTOFF
        assert far[n_clean:].all() and far[:n_clean].mean() < 0.01


def test_verdicts_equal_numpy_and_spare_clean_texts(docs):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 400))) for _ in range(600)]
    junk = [" ".join(rng.choice(words) + "###" for _ in range(100)) for _ in range(30)]
    got = {r.row.doc_id: r for r in q.judge(docs(texts + junk), keep=["doc_id"]).collect()}
    assert all(got[i].kept for i in range(600))
    assert not any(got[i].kept for i in range(600, 630))
    vectors, groups = {}, {}
    for i, r in got.items():
        if not r.base_failed:
            n = r.n_words
            raw = [math.log(r.word_chars / n), *[math.log(1 + 100 * r[c] / n) for c in q.COUNTS[2:]], math.log(n)]
            vectors[i] = [math.floor(v * q.SCALE + 0.5) for v in raw]
            groups[i] = ("en" if i % 3 else None, i % 2)
    assert {i: got[i].kept for i in vectors} == reference_verdicts(vectors, groups)


def test_each_statistic_rejects_alone(docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    clean = [" ".join(some(rng.randint(25, 400))) for _ in range(900)]
    line, passage, short = " ".join(some(9)), some(14), [" ".join(some(2)) for _ in range(20)]
    spared = ["\n".join([line, *(" ".join(some(9)) for _ in range(40)), line]), " ".join([*some(100), "#", *some(100)])]
    planted = {
        "word length": " ".join(a + b for a, b in zip(some(150), some(150), strict=True)),
        "symbols": " ".join(w + "#" * (i % 8 == 0) for i, w in enumerate(some(150))),
        "repeated lines": "\n".join(rng.choice(short) for _ in range(100)),
        "repeated words": " ".join([*passage, *some(72), *passage]),
        "length": " ".join(some(60_000)),
    }
    got = {r.row.doc_id: r for r in q.judge(docs([*clean, *spared, *planted.values()]), keep=["doc_id"]).collect()}
    assert all(got[i].kept for i in range(902))
    assert {name: (got[i].base_failed, got[i].kept) for i, name in enumerate(planted, 902)} == dict.fromkeys(planted, (False, False))


def test_edge_tables(docs, spark):
    assert q.judge(docs([])).count() == 0
    repeated = docs(["one two"] * 3, ids=[None, 1, 1])
    rows = q.judge(repeated).collect()
    assert [r.kept for r in rows] == [False] * 3
    assert set(rows[0].row.asDict()) == set(repeated.columns)


def test_many_groups_are_joined_with_a_salt(docs, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(20, 60))) for _ in range(300)]
    want = sorted((r.row.doc_id, r.kept) for r in q.judge(docs(texts), keep=["doc_id"]).collect())
    monkeypatch.setattr(q, "BROADCAST_GROUPS", 0)
    assert sorted((r.row.doc_id, r.kept) for r in q.judge(docs(texts), keep=["doc_id"]).collect()) == want

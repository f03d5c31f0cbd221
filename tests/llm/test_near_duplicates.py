import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import bag_minhash as b


def bag(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(one, two):
    shared = sum((one & two).values())
    whole = sum((one | two).values())
    return shared / whole if whole else 0.0


def brute_classes(texts, ids):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[root(i)].append(i)
    return Counter((ids[i], min((ids[k] for k in m if ids[k] is not None), default=None)) for m in members.values() for i in m)


def families(seed, n_families, size, edits):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    out = []
    for _ in range(n_families):
        base = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_classes_equal_brute_force(docs):
    texts = families(1, 12, 12, 8) + families(2, 60, 1, 0)
    texts += [None, "", "  ", "a", "a", "A!", "a b c d", "d c b a", "one two three four five", "x y " * 4000, "x y " * 4000 + "z", "..."]
    # Multiplicity counts: the same shingles, once and often.
    texts += ["p q r s t " * 3, "p q r s t " * 40]
    ids = list(range(len(texts)))
    got = Counter((r.doc_id, r.class_id) for r in b.near_duplicates(docs(texts)).collect())
    assert got == brute_classes(texts, ids)


def test_a_large_group_of_varied_copies(docs, monkeypatch):
    """Buckets larger than a block, and classes that a pivot does not connect at once."""
    monkeypatch.setattr(b, "BLOCK_TEXTS", 16)
    texts = families(3, 1, 220, 16)
    got = Counter((r.doc_id, r.class_id) for r in b.near_duplicates(docs(texts)).collect())
    assert got == brute_classes(texts, list(range(len(texts))))


def test_one_row_of_each_class_stays(docs):
    texts = families(4, 5, 6, 3) + ["only one"]
    rows = docs(texts + ["only one", "lonely"], ids=[*range(len(texts)), len(texts) - 1, None])
    found = b.near_duplicates(rows).collect()
    kept = b.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({r.class_id for r in found}, key=str)
    assert b.keep_one(docs([])).count() == 0
    assert b.near_duplicates(docs([None, None], ids=[4, 3])).collect()[0].class_id == 3


def test_a_key_with_different_texts_keeps_each_class(docs):
    one, two = families(7, 2, 1, 1)
    rows = docs([one, two, two, one], ids=[5, 5, 5, 6])
    assert sorted((r.doc_id, r.text) for r in b.keep_one(rows).collect()) == sorted([(5, one), (5, two)])


def test_without_broadcast(docs, monkeypatch):
    texts = families(5, 6, 5, 4)
    monkeypatch.setattr(b, "BROADCAST_NODES", -1)
    monkeypatch.setattr(b, "BROADCAST_TEXT_BYTES", -1)
    got = Counter((r.doc_id, r.class_id) for r in b.near_duplicates(docs(texts)).collect())
    assert got == brute_classes(texts, list(range(len(texts))))


@pytest.mark.parametrize("heavy", [1, 3, 50, 1000])
def test_signatures_estimate_the_weighted_similarity(heavy):
    """The share of equal slots is unbiased, whatever the weights."""
    rng = np.random.default_rng(heavy)
    equal = []
    for _ in range(60):
        hashes = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
        one, two = rng.integers(1, heavy + 1, 40), rng.integers(1, heavy + 1, 40)
        times = b.signatures(np.repeat([0, 1], 40), np.tile(hashes, 2), np.concatenate([one, two]), 2)
        assert np.isfinite(times).all()
        equal.append((times[0] == times[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(equal)) < 4 * 0.5 / (60 * b.SLOTS) ** 0.5


def test_overlap_of_multisets():
    one = np.unique(np.array([1, 1, 2, 3], np.uint64), return_counts=True)
    two = np.unique(np.array([1, 2, 2, 4], np.uint64), return_counts=True)
    assert b.overlap(one, two) == 2 / 6

"""Renames against an exhaustive search on small listings, and through the facade."""

import random
from collections import Counter

from tests.conftest import SAMPLE

from loomgraph.api import KnowledgeBase
from loomgraph.operators import incremental, renames


def listing(spark, files):
    rows = [(p, None if t is None else bytearray(t.encode())) for p, t in files.items()]
    return renames.line_profile(spark.createDataFrame(rows, "file_path string, content binary"))


def brute(old, new):
    gone = {p: t for p, t in old.items() if p not in new and t is not None}
    come = {p: t for p, t in new.items() if p not in old and t is not None}
    lines = lambda t: Counter(t.split("\n"))
    size = lambda c: sum(n * (len(x.encode()) + 1) for x, n in c.items())
    found = []
    for same in (True, False):
        scored = []
        for p in gone:
            for q in come:
                a, b = lines(gone[p]), lines(come[q])
                if same:
                    likeness = float(gone[p] == come[q])
                else:
                    likeness = size(a & b) / max(size(a), size(b))
                if likeness >= (1.0 if same else renames.LEAST_SIMILARITY):
                    scored.append((-likeness, p, q))
        for s, p, q in sorted(scored):
            if p in gone and q in come:
                found.append((p, q, -s))
                del gone[p], come[q]
    return sorted(found)


def found(spark, old, new):
    rows = renames.renames(listing(spark, old), listing(spark, new)).collect()
    return sorted((r.old_path, r.new_path, r.similarity) for r in rows)


def test_renames_equal_brute_force(spark):
    rng = random.Random(4)
    line = lambda: rng.choice("abcdefgh") * rng.randint(1, 9)
    old = {f"a/{i:02}.py": "\n".join(line() for _ in range(rng.randint(1, 8))) for i in range(20)}
    new = {}
    for i, (path, text) in enumerate(old.items()):
        parts = text.split("\n")
        if i % 4 == 1:
            parts.insert(rng.randint(0, len(parts)), line())
        if i % 4 == 2:
            rng.shuffle(parts)
        new[path if i % 4 == 3 else f"b/{19 - i:02}.py"] = "\n".join(parts)
    old |= {"a/e1.py": "", "a/e2.py": "", "a/n.py": None, "a/é.py": "é\né\nx"}
    new |= {"b/e1.py": "", "b/n.py": None, "b/é.py": "é\nx\né"}
    want = brute(old, new)
    assert len(want) > 10
    assert found(spark, old, new) == want


def test_a_line_of_many_files_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(renames, "BLOCK", 4)
    # All files share one long line; sizes tell them apart.
    old = {f"a/{i:02}.py": "common " * 60 + "\n" + "x" * 5 * i for i in range(20)}
    new = {p.replace("a/", "b/"): t + "\ny" for p, t in old.items()}
    got = found(spark, old, new)
    assert len(got) == 20 == len({p for p, *_ in got}) == len({q for _, q, _ in got})
    assert all(s >= renames.LEAST_SIMILARITY for *_, s in got)
    assert [q for _, q, _ in got] == [p.replace("a/", "b/") for p, *_ in got]


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(renames, "BLOCK", 2)
    # All share one line; the best partner of a file is far from it in size, with many of other sizes between.
    old = {f"a/{i:02}.py": "common " * 20 + "\n" + f"{i:02}" * 10 + "\n" + "x" * i for i in range(16)}
    new = {f"b/{i:02}.py": "common " * 20 + "\n" + f"{i:02}" * 10 + "\n" + "y" * (5 * (15 - i)) for i in range(16)}
    # Few of many are left for one that is like all.
    new |= {f"c/{i:02}.py": "common " * 20 + "\n" + "z" * (9 * i + 1) for i in range(16)}
    want = brute(old, new)
    assert len(want) == 16
    assert found(spark, old, new) == want


def test_copies_pair_in_order_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(renames, "BLOCK", 4)
    monkeypatch.setattr(renames, "TIED_FILES", 2)
    written, cut = [], renames.cut_lineage
    monkeypatch.setattr(renames, "cut_lineage", lambda rows: written.append(1) or cut(rows))
    # Copies, each with a line of its own later.
    old = {f"a/{i:02}.py": "copy " * 20 for i in range(20)}
    new = {f"b/{i:02}.py": f"# {i:02}\n" + "copy " * 20 for i in range(24)}
    # Two kinds of old files, in turns, that are equally like every new one.
    old |= {f"c/{i}.py": "common " * 9 + "\n" + "xy"[i % 2] * 9 for i in range(7)}
    new |= {f"d/{i}.py": "common " * 9 + "\n" + "z" * 9 for i in range(5)} | {"d/x.py": "x" * 9 + "\n" + "u" * 30, "d/y.py": "y" * 9 + "\n" + "v" * 30}
    want = brute(old, new)
    assert len(want) == 25
    assert found(spark, old, new) == want
    assert len(written) < 30


def test_without_lines_only_equal_contents(spark):
    old, new = listing(spark, {"a.py": "x\ny", "b.py": "long line\nz"}), listing(spark, {"c.py": "x\ny", "d.py": "long line\nw"})
    rows = renames.renames(old.drop("lines"), new.drop("lines")).collect()
    assert [(r.old_path, r.new_path) for r in rows] == [("a.py", "c.py")]
    assert renames.renames(old.limit(0), new).isEmpty() and renames.renames(old, new.limit(0)).isEmpty()


def test_feed_keeps_renames_to_or_from_python(spark):
    old, new = {"a.py": "x\ny", "b.txt": "p\nq", "c.txt": "r\ns", "d.py": "t"}, {"a.txt": "x\ny", "b.py": "p\nq", "d.txt": "r\ns", "e.py": "u"}
    before, after = listing(spark, old), listing(spark, new)
    feed = incremental.change_feed(before, after, python_only=False)
    rows = renames.with_renames(feed, renames.renames(before, after)).collect()
    assert sorted((r.file_path, r.change_type, r.old_path or "") for r in rows) == [
        ("a.txt", "renamed", "a.py"), ("b.py", "renamed", "b.txt"), ("d.py", "deleted", ""), ("e.py", "added", ""),
    ]


def test_update_project_follows_renames(spark, tmp_path):
    root = tmp_path / "project"
    for path, text in SAMPLE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    base = KnowledgeBase(spark)
    base.analyze_project(str(root))
    (root / "src/calc.py").unlink()
    (root / "src/core.py").write_text(SAMPLE["src/calc.py"])
    (root / "tests/test_calc.py").unlink()
    (root / "tests/test_core.py").write_text(SAMPLE["tests/test_calc.py"].replace("from calc", "from core"))
    assert base.update_project(str(root)) == {"files_added": 0, "files_modified": 0, "files_deleted": 0, "files_renamed": 2}
    fresh = KnowledgeBase(spark)
    fresh.analyze_project(str(root))
    edges = lambda b: sorted(tuple(r) for r in b.graph.edges.select("src", "dst", "type").collect())
    assert edges(base) == edges(fresh)
    assert sorted(r.id for r in base.graph.nodes.collect()) == sorted(r.id for r in fresh.graph.nodes.collect())

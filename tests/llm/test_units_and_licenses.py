import random
import re
from collections import Counter

import pytest

from loomgraph.llm import license_scan as ls
from loomgraph.llm import unit_dedup as u


def brute(texts, ids, unit, least):
    ends, first, out = re.compile(u.DELIMITERS[unit]), {}, {}
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0))
    norm = lambda s: tuple(s.lower().split())
    for i in order:
        for a, b in u.cut_units(texts[i] or "", ends):
            first.setdefault(norm(texts[i][a:b]), ids[i])
    for i in range(len(texts)):
        seen, spans = set(), []
        for a, b in u.cut_units(texts[i] or "", ends):
            key = norm(texts[i][a:b])
            if len(key) >= least:
                if first[key] != ids[i] or key in seen:
                    spans.append((a, b))
                seen.add(key)
        out[i] = spans
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_spans_equal_brute_force(docs, unit):
    rng = random.Random(1)
    pool = [" ".join(rng.choice(["Ab", "cé", "d", "ef"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [None, "", "\n\n", "no end of it all in one very long text without end " * 500]
    texts += ["".join(rng.choice(pool) + rng.choice([". ", "\n", "\n\n", "? ", ".", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    rows = u.remove_repeats(docs(texts), unit=unit).collect()
    want = brute(texts, list(range(len(texts))), unit, u.MIN_WORDS)
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(s.start, s.end) for s in r.removed]
        assert spans == want[r.doc_id]
        text, at, kept = texts[r.doc_id], 0, []
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        assert r.text == (text if not spans else "".join(kept) + text[at:])
        assert r.n_words == 7


def test_keys_that_are_null_or_repeat(docs):
    line = "one two three four five six seven\n"
    rows = u.remove_repeats(docs([line, line, line, line], ids=[2, 2, 3, None])).collect()
    assert Counter((r.doc_id, len(r.removed)) for r in rows) == {(2, 0): 2, (3, 1): 1, (None, 1): 1}
    assert u.remove_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        u.remove_repeats(docs([line]), removed="n_words")


@pytest.mark.parametrize(("unit", "end"), [("line", "\n"), ("paragraph", "\n\n"), ("sentence", "。")])
@pytest.mark.parametrize("body", ["机器学习需要大量干净的数据", "これは繰り返される長い文です", "ข้อความนี้ซ้ำกันในหลายเอกสาร"])
def test_texts_without_spaces(docs, unit, end, body):
    rows = u.remove_repeats(docs([f"一{end}{body}{end}二", f"三{end}{body}{end}四"]), unit=unit).collect()
    assert {r.doc_id: r.text for r in rows} == {0: f"一{end}{body}{end}二", 1: f"三{end}四"}


def test_short_lines_on_request(docs):
    texts = ["Home\nAll rights reserved.\none", "All  Rights reserved.\n\ntwo\nhome\n\n"]
    rows = u.remove_repeats(docs(texts), unit="line", min_words=1).collect()
    assert {r.doc_id: r.text for r in rows} == {0: texts[0], 1: "\ntwo\n\n"}


def brute_licenses(texts):
    out = set()
    for i, text in enumerate(texts):
        words = ls.template_words(text or "")
        parts = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        for name, template in ls.TEMPLATES.items():
            own = ls.template_words(template)
            wanted = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            stride = ls.stride_of(len(wanted))
            found = [(len(wanted & set(parts[a : a + 2 * stride])), a) for a in range(0, len(parts), stride)]
            found = [f for f in found if f[0] >= ls.CONTAINMENT * len(wanted)]
            if found:
                out.add((i, name, max(f[0] for f in found), len(wanted), min(f[1] for f in found)))
    return out


def test_licences_equal_brute_force(docs):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["und", "la", "the", "license", "software"]) for _ in range(n))
    texts = [None, "", "Released under the MIT License.", "released under the mit", filler(20_000)]
    for template in ls.TEMPLATES.values():
        words = template.split()
        for lost in (0, 1, 3, 8):
            cut = [w for k, w in enumerate(words) if k not in set(rng.sample(range(len(words)), min(lost, len(words) - 1)))]
            texts.append(f"{filler(rng.randint(0, 300))} {' '.join(cut).upper()}\n{filler(rng.randint(0, 50))}")
    got = {tuple(r) for r in ls.scan(docs(texts)).collect()}
    assert got == brute_licenses(texts)
    assert {x[1] for x in got} == set(ls.TEMPLATES)


def test_license_edges(docs, spark):
    assert ls.scan(docs([])).count() == 0
    rows = ls.scan(docs([ls.TEMPLATES["MIT"]] * 3, ids=[None, 1, 1])).collect()
    assert Counter(r.doc_id for r in rows) == {None: 1, 1: 1}
    with pytest.raises(ValueError):
        ls.scan(docs(["x"]), templates={"short": "one two"})


OTHERS = {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "under the terms of the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007",
    "Apache-2.0-text": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0-text": "Creative Commons Legal Code\n\nCC0 1.0 Universal",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-3-Clause": "and/or other materials provided with the distribution.\n3. Neither the name of the University nor the names",
    "BSD-2-Clause": "and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE AUTHOR",
    "GPL-2.0-or-later-header": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    "LGPL-3.0-or-later-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or",
}


def test_each_licence_has_its_own_name(docs):
    """Texts of the licences under their own names alone, each template among them."""
    names = [*OTHERS, *ls.TEMPLATES]
    got = {(r.doc_id, r.license) for r in ls.scan(docs([*OTHERS.values(), *ls.TEMPLATES.values()])).collect()}
    family = lambda name: name.removesuffix("-header").removesuffix("-text").removesuffix("-notice").removesuffix("-short").removesuffix("-or-later")
    assert {(i, n) for i, n in enumerate(names)} <= got
    assert {(i, name) for i, name in got if family(name) != family(names[i])} == set()


def test_other_versions_are_not_named(docs):
    texts = ["Licensed under the Apache License, Version 1.1.", "under the GNU General Public License, version 4", "Licensed under CC BY-NC 2.5."]
    assert ls.scan(docs(texts)).count() == 0

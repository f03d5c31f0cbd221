"""Columns whose names clash with those of the operators, or hold dots, pass through every document operator."""

import pytest

import corpus_pipeline
from loomgraph.llm import bag_minhash, merkle_log, quality_mcd, suffix_buckets, token_counts, unit_dedup
from loomgraph.llm.shared import tokenizer_path

EXTRA = {
    "a.b": 1, "_gone": 2, "gone": 3, "_k": 4, "_n": 5, "_times": 6, "k": 7, "key": 8, "node": 9, "row": 10, "class": 11, "body": 12, "kept": 13, "n_words": 14,
    "content_digest": 15, "g": 16, "t1": 17, "removed": 18, "index": 19, "order": 20, "base_failed": 21, "`q`": 22,
}


@pytest.fixture(scope="module")
def rows(spark):
    text = " ".join(f"word{i % 40}" for i in range(90))
    base = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "a b.c\nline", "en", "s", 9)]
    columns = ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *[f"`{c.replace('`', '``')}` int" for c in EXTRA]]
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in base], ", ".join(columns))


def test_near_duplicates(rows):
    kept = bag_minhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert bag_minhash.near_duplicates(rows).count() == 5


def test_units(rows):
    found = unit_dedup.remove_repeats(rows, removed="cut")
    assert found.columns == [*rows.columns, "cut"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[2]["text"] == "" and got[1]["text"] and got[1]["_gone"] == 2 and got[2]["a.b"] == 1


def test_quality(rows):
    judged = quality_mcd.judge(rows)
    assert judged.select("row.*").columns == rows.columns and judged.count() == 5


def test_token_counts(rows, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    first = token_counts.count_tokens(rows, path, str(tmp_path / "a"), key="content_digest").collect()
    assert {r[0] for r in first} == {15} and len(first) == 5
    again = token_counts.count_tokens(rows, path, str(tmp_path / "a")).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in again) == sorted((r["n_bytes"], r["n_tokens"]) for r in first)


def test_manifest_and_suffixes(rows):
    assert merkle_log.manifest(rows)[0].count() == 5
    got = suffix_buckets.remove_repeats(rows)
    assert got.select("row.*").columns == rows.columns
    assert {r["row"]["doc_id"]: bytes(r["kept"]) for r in got.collect()}[1] == b""


def test_stages(rows, spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, "").columns == rows.columns

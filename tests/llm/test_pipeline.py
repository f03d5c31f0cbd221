import duckdb
import pytest

import corpus_pipeline
from loomgraph.llm import queries, unit_dedup
from loomgraph.llm.shared import written
from tests.llm.test_near_duplicates import brute_classes
from tests.llm.test_tokens import check_packing
from tests.llm.test_units_and_licenses import brute
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.dtypes, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        tables.append(docs)
    assert [t.dtypes == columns for t in tables] == [True, True, True, False]
    quality, single, cut, packed = tables
    kept = {r[0] for r in duckdb.execute(
        "WITH documents AS (FROM read_parquet('%s/documents.parquet')) SELECT doc_id FROM (%s) WHERE kept" % (SF, queries.SQL["op2_quality_outliers"])
    ).fetchall()}
    rows = quality.orderBy("doc_id").collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)
    classes = brute_classes([r.text for r in rows], [r.doc_id for r in rows])
    rows = single.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted({c for _, c in classes})
    spans = brute([r.text for r in rows], [r.doc_id for r in rows], "sentence", unit_dedup.MIN_WORDS)
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert len(texts) == len(rows)
    for i, r in enumerate(rows):
        want = list(r.text)
        for a, b in reversed(spans[i]):
            del want[a:b]
        assert texts[r.doc_id] == ("".join(want), len(want) if spans[i] else r.n_chars)
    order = sorted(texts)
    found = [r.asDict() | {"doc_id": order.index(r.doc_id)} for r in packed.collect()]
    check_packing([type("Row", (), f) for f in found], [texts[d][0] for d in order], 4096)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF) is None


def test_every_operator_has_a_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert {int(name[2:].split("_")[0]) for name in set(queries.QUERIES) - set(queries.SQL)} == {3, 4, 5, 6, 7, 13}

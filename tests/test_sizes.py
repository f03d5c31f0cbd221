"""Tables that grow on the way are not broadcast on the planner's guess of the scan they come from."""

import time

from pyspark.sql import functions as F

from loomgraph.operators.ranges import first_covering


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_intervals_are_not_broadcast(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 5).alias("k"), F.col("id").alias("low"), (F.col("id") + 1000).alias("high"))
    met = first_covering(rows, rows, ["k"], "low", "low", "high", F.col("id"), F.col("id"), "found", ["id", "k"])
    assert "BroadcastExchange" not in _plan(met)


def test_stored_rows_have_their_size(spark):
    from loomgraph.session import stored

    def many(batches):
        for batch in batches:
            yield batch.loc[batch.index.repeat(500)].assign(text="x" * 90)

    rows = stored(spark.range(100).mapInPandas(many, "id long, text string"), sized=True)
    assert rows.count() == 50_000
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 50_000 * 90


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    return {found.apply(i).getPath() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def _left_behind(spark, made):
    """Shuffle files that ``made`` leaves; what is dropped goes a little later."""
    before = _shuffle_files(spark)
    made()
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from loomgraph.operators.graph import PropertyGraph
    from loomgraph.session import bucketed, stored
    from loomgraph.sources.merge_store import MergeStore

    rows = spark.range(5000).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", (F.col("id") * 7) % 5000).alias("dst"), F.lit("CALLS").alias("type"))
    nodes = rows.select(F.col("src").alias("id"), F.lit("x").alias("name"), F.lit("class").alias("type"), F.lit("").alias("file_path"))
    assert not _left_behind(spark, lambda: stored(rows.repartition(4, "dst")))
    assert not _left_behind(spark, lambda: bucketed(rows, ["src"]))
    store = MergeStore(spark, str(tmp_path / "store"))
    assert not _left_behind(spark, lambda: store._write(rows, "edges_by_src", str(tmp_path / "edges")))
    store.save(PropertyGraph(nodes, rows))
    edges = store.load().edges
    assert not _left_behind(spark, lambda: store._write(edges, "edges_by_dst", str(tmp_path / "back"), files=True))


def test_a_layout_in_passes_is_that_in_one(spark):
    from loomgraph.session import bucketed

    rows = spark.range(2000).select((F.col("id") % 97).alias("src"), F.col("id").alias("dst"))
    once, thrice = bucketed(rows, ["src"]), bucketed(rows, ["src"], 3)
    assert thrice.exceptAll(once).isEmpty() and thrice.count() == 2000
    parts = lambda df: {(r.src, r.p) for r in df.groupBy("src").agg(F.count("*")).select("src", F.spark_partition_id().alias("p")).collect()}
    assert {s for s, _ in parts(thrice)} == set(range(97))
    assert "Exchange" not in thrice.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()


def test_large_sized_tables_stay_compressed(spark, monkeypatch):
    from loomgraph import session

    rows = spark.range(20_000).select(F.lit("text " * 20).alias("text"), "id")
    plain = session._bytes(session.stored(rows, sized=True))
    monkeypatch.setattr(session, "_SIZED_BROADCASTS", 0, raising=False)
    assert session._bytes(session.stored(rows, sized=True)) < plain / 5

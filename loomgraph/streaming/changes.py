"""Keep a stored event table up to date while source files arrive.

Every pull drops its added, modified and moved files into a folder of its own,
``root/<revision>/<path>``, with revisions that sort by age: a file stream reads
a path once, so a new version needs a new one.  Paths that went are listed in
``root/<revision>/changes.jsonl``, one ``{"old_path": ..., "new_path": ...}`` a line,
``new_path`` being null for a deletion.  Each micro-batch parses what arrived and
stores the events, and a tombstone for every path that went.

The state of a path is what its highest revision says, whatever order revisions
arrive in.  A path that went and came again within a revision is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph import model
from loomgraph.functions.predicates import is_source_path
from loomgraph.sources.source_tree import parse_sources

#: The list of a revision's deletions and moves, and the kind of the rows it becomes.
CHANGES, TOMBSTONE = "changes.jsonl", "deleted"
_CHANGE = "old_path STRING, new_path STRING"
_BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def source_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """``file_path, revision, content`` of source files, and of lists of changes, as they appear under ``root``."""
    stream = (
        spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{*.py,*.java," + CHANGES + "}").option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.substring("path", F.locate(base, F.col("path")) + len(base), F.length("path"))
    revision = F.substring_index(relative, "/", 1)
    file_path = F.substring(relative, F.length(revision) + 2, F.length("path"))
    return stream.filter(is_source_path(F.col("path")) | (file_path == CHANGES)).select(
        file_path.alias("file_path"), revision.alias("revision"), "content"
    )


def tombstones(lists: DataFrame) -> DataFrame:
    """One row of kind ``TOMBSTONE`` for every path that ``lists(revision, content)`` says has gone."""
    line = F.explode(F.split(F.col("content").cast("string"), "\r?\n"))
    read = lists.select("revision", line.alias("line")).select("revision", F.from_json("line", _CHANGE).alias("change"))
    gone = read.filter("change.old_path IS NOT NULL").groupBy(F.col("change.old_path").alias("file_path"))
    return gone.agg(F.max("revision").alias("revision")).withColumn("kind", F.lit(TOMBSTONE))


def keep_events(root: str, table: str, checkpoint: str, spark: SparkSession) -> StreamingQuery:
    """Append events of arriving files to the Parquet ``table``; returns the running query.

    Rows carry the batch that wrote them; a batch that runs again after a failure
    rewrites its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        # One version per path and batch: the newest.
        arrived, lists = batch.filter(F.col("file_path") != CHANGES), batch.filter(F.col("file_path") == CHANGES)
        newest = arrived.groupBy("file_path").agg(F.max("revision").alias("revision"))
        current = arrived.join(newest, ["file_path", "revision"])
        events = parse_sources(current.select("file_path", "content")).join(newest, "file_path")
        events.unionByName(tombstones(lists), allowMissingColumns=True).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        source_stream(spark, root).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_events(spark: SparkSession, table: str) -> DataFrame:
    """The events of every file as of its last version, without files that have gone."""
    stored = spark.read.parquet(table)
    newest = stored.groupBy("file_path").agg(F.max("revision").alias("revision"))
    current = stored.join(newest, ["file_path", "revision"]).filter(F.col("kind") != TOMBSTONE)
    return current.select(*model.SYNTAX_SCHEMA.fieldNames())

"""Session defaults and the folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only a local session may get a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table of more files than so many broadcasts would fill is broadcast on no size of its files.
_SIZED_BROADCASTS = 64


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files as they end, not when the driver next collects garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def stored(df: DataFrame, sized: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder as Parquet and go on from the files.

    The planner takes a checkpoint for as large as its guess of the plan before it, and rows that a parser
    makes or an array holds count for little in that guess; large tables were broadcast on it.  Files have a size.
    ``sized`` leaves a table that might be broadcast neither compressed nor coded, so that its files are about what
    the rows take in memory.
    """
    found = _stored(df, compression="zstd")
    if not sized or _bytes(found) > _SIZED_BROADCASTS * _broadcast_bytes(df.sparkSession):
        return found
    plain = _stored(found, **{"compression": "none", "parquet.enable.dictionary": "false"})
    discard(found)
    return plain


def _stored(df: DataFrame, **options: str) -> DataFrame:
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(folder)
    found = spark.read.schema(df.schema).parquet(folder)
    found.stored_folder = folder
    return found


def _bytes(df: DataFrame) -> int:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_folder)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def _broadcast_bytes(spark: SparkSession) -> int:
    return max(0, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, keys: list[str], passes: int = 1) -> DataFrame:
    """Write ``df`` to the checkpoint folder in buckets by ``keys``.

    Joins on these keys then shuffle their other side only.  (A plain checkpoint
    forgets its partitioning under adaptive execution.)  ``passes`` reads ``df`` so often and shuffles
    the rows of some keys each time, so that less lies on the disks at once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"buckets_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    passes = max(1, passes)
    with shuffles_dropped(spark):
        for at in range(passes):
            some = df if passes == 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(passes)) == at)
            # Rows of one source together take less room.
            placed = some.repartition(parts, *keys).write.format("parquet").option("compression", "zstd").mode("append")
            placed.bucketBy(parts, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
    table = spark.table(name)
    # Only the catalog entry goes; the files stay with the folder.
    spark.sql(f"DROP TABLE {name}")
    return table


def planned_bytes(df: DataFrame) -> int:
    """The size that the planner estimates; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def widen(scan: DataFrame) -> DataFrame:
    """Spread a plain table scan over all cores before costly work per row.

    A scan that fills a split per core, as any large table does, stays as it is; a
    small file with one row group would otherwise run in one task.  The size is what
    the planner estimates, so nothing runs here; results do not depend on it.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = planned_bytes(scan)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return scan.repartition(cores) if size < cores * split else scan

"""Helpers of this subpackage: tables, written steps and Arrow stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.session import ensure_checkpoint_dir

ship_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


#: Rows of a step whose rows are long, a text's words or so, that go to a Python worker at a time.
LONG_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later steps read only the columns that they need, and a lost executor costs no recomputation
    beyond the running step.  ``batch_rows``: at most so many rows are handed to a Python worker at a time.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    before = spark.conf.get(_BATCH)
    if batch_rows is not None and not 0 < int(before) <= batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_BATCH, before)
    found = spark.read.schema(df.schema).parquet(folder)
    found.scratch_folder = folder
    return found


def forget(*tables: DataFrame) -> None:
    """Delete the folders of ``written`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def named(column: str) -> Column:
    """The column of this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one, so that none can clash with those of an operator; ``select("row.*")`` unpacks it."""
    return F.struct(*[named(c) for c in df.columns]).alias(name)


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Joins against one-row-per-key tables that hold up when a few keys dominate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A broadcast is asked for only when the row count is known to be below this.
BROADCAST_ROWS = 200_000
# Rows of one key that one task should join.
ROWS_PER_TASK = 1_000_000


def first_by(df: DataFrame, keys: list[str], order: Column, **values: Column) -> DataFrame:
    """The values of the row lowest in ``order`` per key.

    ``min_by`` combines on the map side, so a key that owns a third of the rows
    reaches the shuffle as one row per map task.
    """
    return df.groupBy(*keys).agg(
        *[F.min_by(value, order).alias(name) for name, value in values.items()]
    )


def heavy_keys(rows: DataFrame, keys: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Every key with more than ``rows_per_task`` rows, and the number of tasks ``_parts`` its rows should spread over.

    Counts combine on the map side.  No job runs until the lookup does, and ``rows`` should be a
    stored table, as it is read once more.  At most one key per ``rows_per_task`` rows is heavy.
    """
    most = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return counts.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))


def _with_parts(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    # A row per million rows at most: small enough to broadcast.
    return rows.join(F.broadcast(heavy), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def spread_rows(rows: DataFrame, heavy: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    return _with_parts(rows, heavy, keys).withColumn("_salt", F.pmod(spread, F.col("_parts")).cast("int")).drop("_parts")


def repeat_rows(table: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    return _with_parts(table, heavy, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def salted_lookup(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", spread: Column | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``, which holds at most one row per key.

    With ``heavy`` (see ``heavy_keys``) the rows of a heavy key are spread over as many tasks as they
    need by ``spread``, by default a hash of their other columns, and its one row on the other side is
    repeated for each.  The result equals the plain join.  Without it the join is left to adaptive
    execution, which splits partitions that turn out large where both sides are plain tables.
    """
    others = [c for c in rows.columns if c not in keys]
    if heavy is None or (spread is None and not others):
        return rows.join(table, keys, how)
    left = spread_rows(rows, heavy, keys, F.xxhash64(*others) if spread is None else spread)
    return left.join(repeat_rows(table, heavy, keys), [*keys, "_salt"], how).drop("_salt")

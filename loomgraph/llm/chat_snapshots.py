"""Collapse of cumulative conversation snapshots, then chat formatting.

A logger that stores a conversation again after each turn leaves conversations that
are prefixes of longer ones.  Every turn gets a hash of its place, role and text; the
exclusive-or of the hashes up to a turn is the rolling hash of that prefix.  A
conversation is dropped if its whole hash is that of a proper prefix of another one
(anti-join), and of equal conversations the one with the smallest id stays.

Turns are ordered by turn, role and text, nulls first.  Windows never span a whole
conversation but blocks of turn numbers, with what came before carried over, so one
conversation may hold a third of all turns; only rows with equal conversation and turn
number meet in one task.  Prefixes and equal conversations are grouped on the map side
first.

A conversation that stays is one row, whatever its turn numbers: blocks are rendered
first, then joined in order.  Null role and text render as empty and differ from empty ones in
the hash; rows without an id are one conversation; repeated rows are turns of their own;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import written

#: Turn numbers of a block.
BLOCK_TURNS = 256


def _carried(blocks: DataFrame, **sums: Column) -> DataFrame:
    """What the earlier blocks of a conversation hold together."""
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(F.col("conv").alias("cconv"), F.col("block").alias("cblock"), *[F.coalesce(c.over(before), F.lit(0)).alias(n) for n, c in sums.items()])


def rolling(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, block, place, role, text`` and the rolling hashes ``p1, p2`` of every turn; ``place`` from 1."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("bigint"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(inside))
    here = lambda c: F.col("conv").eqNullSafe(F.col("cconv")) & (F.col("block") == F.col("cblock"))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    met = placed.join(_carried(sizes, before=F.sum("n")), here("n")).withColumn("place", (F.col("place") + F.col("before")).cast("bigint")).drop("cconv", "cblock", "before")
    marks = [F.lit(s) for s in (1, 2)]
    key = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = written(met.withColumns({f"h{n}": F.xxhash64(m, *key) for n, m in enumerate(marks, 1)}), "turn_hashes")
    xors = hashed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    up_to = Window.partitionBy("conv", "block").orderBy("place")
    run = hashed.withColumns({f"r{n}": F.bit_xor(f"h{n}").over(up_to) for n in (1, 2)})
    full = run.join(_carried(xors, c1=F.bit_xor("x1"), c2=F.bit_xor("x2")), here("x"))
    return full.select("conv", "block", "place", "role", "text", *[F.col(f"r{n}").bitwiseXOR(F.col(f"c{n}")).alias(f"p{n}") for n in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv`` of the conversations that are no proper prefix of another, one of each set of equals."""
    last = prefixes.groupBy(F.col("conv").alias("cconv")).agg(F.max("place").alias("n"))
    ends = prefixes.join(last, F.col("conv").eqNullSafe(F.col("cconv")) & (F.col("place") == F.col("n"))).select("conv", "n", "p1", "p2")
    keys = ["n", "p1", "p2"]
    # Every prefix with the number of conversations that have it, and of those that end there.
    having = prefixes.groupBy(F.col("place").alias("n"), "p1", "p2").agg(F.count("*").alias("c"))
    ending = ends.groupBy(*keys).agg(F.count("*").alias("e"), F.min("conv").alias("conv"))
    longer = having.join(ending, keys).filter(F.col("c") > F.col("e")).select(*keys)
    return ending.join(longer, keys, "left_anti").select("conv")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, part, n_turns, text`` of the conversations that stay, a row each; ``part`` is 0."""
    prefixes = written(rolling(turns, conv, turn, role, text), "turn_prefixes")
    stay = maximal(prefixes.select("conv", "place", "p1", "p2")).toDF("kept")
    rows = prefixes.join(stay, F.col("conv").eqNullSafe(F.col("kept")), "left_semi")
    blocks = rows.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t")))).alias("ts")
    ).select("conv", "block", F.size("ts").cast("bigint").alias("n"), F.array_join("ts.t", "").alias("t"))
    whole = blocks.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("block", "t"))).alias("ts"))
    return whole.select(
        F.col("conv").alias(conv), F.lit(0).cast("bigint").alias("part"), "n_turns", F.array_join("ts.t", "").alias(text)
    )

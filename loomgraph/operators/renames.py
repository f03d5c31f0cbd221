"""Renamed files: deleted paths matched one to one with added paths.

Equal contents are paired first.  What is left is compared by lines: the similarity
of two files is the share of the larger one's bytes that lie in lines of both, and a
pair counts from ``LEAST_SIMILARITY`` on.  The best pair is taken, both its files
leave, and so on; ties go to the smaller old path, then to the smaller new one.

Files of one side that agree in size and in the lines that the other side has too are
alike to all files there.  They are one class, however many copies there are: classes
are compared, and the files of two classes are paired in the order of their paths.

Candidates come from rare lines.  All lines are ordered from rare to frequent, those
that the other side lacks first, and a class is looked up by its first lines only, up
to the point where the rest is too short to reach the least similarity, so every pair
that can count shares such a line.  Two classes meet at a line if what each holds from it
on, and so all that they can share when it is the first line of both, is half of the larger
one.  A line that more than ``BLOCK`` classes share is cut into blocks by size, and all blocks
of sizes that can count together meet, each two of them apart: many classes of like size and
one frequent line are as many pairs as they are, spread over tasks.

Null paths and null contents take no part; a path in both listings was not renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

LEAST_SIMILARITY = 0.5
BLOCK = 64
#: Files that a pair of classes goes through at most in a round when another class of the same similarity may come between.
TIED_FILES = 1000

_TAKEN = ["old", "old_at", "old_path", "new", "new_at", "new_path", "similarity"]


def line_profile(files: DataFrame) -> DataFrame:
    """``file_path, content_hash, lines`` of ``files(file_path, content)``.

    ``lines`` holds ``h``, a line's digest, and ``w``, its bytes with the line break,
    for every line with its repeats.
    """
    lines = F.split(F.col("content").cast("string"), "\n")
    held = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.octet_length(x) + 1).cast("bigint").alias("w")))
    return files.select("file_path", F.md5("content").alias("content_hash"), held.alias("lines"))


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``n``, the place of every row among those of its key, from 0.

    Rows are cut into ranges, so a key with very many rows is numbered by many tasks.
    """
    placed = cut_lineage(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    return placed.withColumn("_within", within).join(starts, [key, "_range"]).select(
        *rows.columns, (F.col("_start") + F.col("_within")).alias("n")
    )


def exact_renames(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """The first deleted path of a content with its first added one, the second with the second, and so on."""
    old = _numbered(deleted.select("file_path", "content_hash"), "content_hash", ["file_path"])
    new = _numbered(added.select("file_path", "content_hash"), "content_hash", ["file_path"])
    return old.withColumnRenamed("file_path", "old_path").join(
        new.withColumnRenamed("file_path", "new_path"), ["content_hash", "n"]
    ).select("old_path", "new_path", F.lit(1.0).alias("similarity"))


def _features(listing: DataFrame, side: str) -> DataFrame:
    """``side, file_path, size, h, w``: the bytes that every different line has in a file."""
    size = F.aggregate("lines", F.lit(0).cast("bigint"), lambda held, x: held + x["w"])
    rows = listing.select(F.lit(side).alias("side"), "file_path", size.alias("size"), F.explode("lines").alias("line"))
    return rows.groupBy("side", "file_path", "size", F.col("line.h").alias("h")).agg(F.sum("line.w").alias("w"))


def _classes(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files alike to all files of the other side: ``class, n, file_path``, and ``side, class, size, own, h, w`` of each class.

    Likeness follows from the size and from the lines of both sides, so files that agree in these are one class.
    ``own`` are the bytes of lines that the other side lacks.  A file that has more of them than a pair may have
    is in no class.
    """
    sides = features.groupBy("h").agg(*[F.bool_or(F.col("side") == side).alias(side) for side in ("old", "new")])
    # Written first, so that the join splits a line of very many files.
    shared = cut_lineage(sides.filter("old AND new").select("h"))
    both = cut_lineage(features.join(shared, "h", "left_semi"))
    # The lines of one file are a bounded group.
    held = F.array_sort(F.collect_list(F.struct("h", "w"))).cast("string")
    files = both.groupBy("side", "file_path", "size").agg(F.sum("w").alias("_w"), F.md5(held).alias("_held"))
    files = files.withColumn("own", F.col("size") - F.col("_w")).filter(F.col("own") <= (1 - LEAST_SIMILARITY) * F.col("size"))
    named = files.select("side", "file_path", "own", F.concat_ws(":", "size", "_held", "side").alias("class"))
    placed = cut_lineage(_numbered(named, "class", ["file_path"]))
    first = placed.filter("n = 0").select("side", "file_path", "own", "class")
    lines = both.join(first, ["side", "file_path"]).select("side", "class", "size", "own", "h", "w")
    return placed.select("class", "n", "file_path"), cut_lineage(lines)


def _looked_up(lines: DataFrame) -> DataFrame:
    """The lines by which classes are looked up; those that the other side lacks count as the rarest."""
    classes = cut_lineage(lines.groupBy("h").agg(F.count("*").alias("classes")))
    rare_first = Window.partitionBy("class").orderBy("classes", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("own") + F.coalesce(F.sum("w").over(rare_first), F.lit(0))
    known = lines.join(classes, "h").withColumn("before", before)
    least = F.col("before") <= (1 - LEAST_SIMILARITY) * F.col("size")
    return known.filter(least).select("side", "class", "size", "h", (F.col("size") - F.col("before")).alias("rest"))


def _candidates(prefixes: DataFrame) -> DataFrame:
    """Distinct ``old, new`` of all classes that meet at a line."""
    numbered = cut_lineage(_numbered(prefixes, "h", ["size", "class"]).withColumn("block", F.floor(F.col("n") / BLOCK)))

    def side(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("block", "size", "rest")]
        return numbered.filter(F.col("side") == name).select("h", F.col("class").alias(name), *columns)

    def near(old_least: str, old_most: str, new_least: str, new_most: str) -> Column:
        return (F.col(old_most) >= LEAST_SIMILARITY * F.col(new_least)) & (F.col(new_most) >= LEAST_SIMILARITY * F.col(old_least))

    old, new = side("old"), side("new")
    if numbered.filter("block > 0").isEmpty():
        met = old.join(new, "h")
    else:
        blocks = [
            rows.groupBy("h", f"{name}_block").agg(F.min(f"{name}_size").alias(f"{name}_least"), F.max(f"{name}_size").alias(f"{name}_most"))
            for name, rows in (("old", old), ("new", new))
        ]
        cells = blocks[0].join(blocks[1], "h").filter(near("old_least", "old_most", "new_least", "new_most"))
        cells = cut_lineage(cells.select("h", "old_block", "new_block"))
        met = cells.join(old, ["h", "old_block"]).join(new, ["h", "new_block"])
    most = F.least("old_rest", "new_rest")
    return met.filter(most >= LEAST_SIMILARITY * F.greatest("old_size", "new_size")).select("old", "new").distinct()


def _scored(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("size", "w")]
        return lines.filter(F.col("side") == name).select(F.col("class").alias(name), "h", *columns)

    met = pairs.join(side("old"), "old").join(side("new"), ["new", "h"])
    shared = met.groupBy("old", "new", "old_size", "new_size").agg(F.sum(F.least("old_w", "new_w")).alias("shared"))
    similarity = F.col("shared") / F.greatest("old_size", "new_size")
    return shared.select("old", "new", similarity.alias("similarity")).filter(F.col("similarity") >= LEAST_SIMILARITY)


def _heads(rows: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """``rows`` with the path of the member ``{side}_at`` of ``side``; rows without such a member leave."""
    found = members.select(F.col("class").alias(side), F.col("n").alias(f"{side}_at"), F.col("file_path").alias(f"{side}_path"))
    return rows.drop(f"{side}_path").join(found, [side, f"{side}_at"])


def best_pairs(scored: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of files that taking the best first leaves, each file in one at most, from ``old, new, similarity``
    of classes: ``old, old_at, old_path, new, new_at, new_path, similarity``.

    The files of a class are taken in the order of their paths.  A round takes every pair of classes that is the best of
    both, file by file up to the first that would rather go with a class of the same similarity; the best pair of all
    is one of them, so rounds end.
    """
    left = scored
    for side in ("old", "new"):
        first = members.groupBy(F.col("class").alias(side)).agg(F.min("n").alias(f"{side}_at"), F.max("n").alias(f"{side}_last"))
        left = _heads(left.join(first, side), members, side)
    left = cut_lineage(left)
    taken = None
    while taken is None or not left.isEmpty():
        ranked = left
        for side, other in (("old", "new"), ("new", "old")):
            best_first = Window.partitionBy(side).orderBy(F.desc("similarity"), f"{other}_path")
            tied = F.lead("similarity").over(best_first) == F.col("similarity")
            ranked = ranked.withColumn(f"{other}_rank", F.row_number().over(best_first)).withColumn(
                f"{other}_next", F.when(tied, F.lead(f"{other}_path").over(best_first))
            )
        mutual = ranked.filter("old_rank = 1 AND new_rank = 1")
        more = F.least(F.col("old_last") - F.col("old_at"), F.col("new_last") - F.col("new_at"))
        alone = F.col("old_next").isNull() & F.col("new_next").isNull()
        step = F.explode(F.sequence(F.lit(0), F.when(alone, more).otherwise(F.least(more, F.lit(TIED_FILES - 1)))))
        steps = mutual.withColumn("step", step)
        for side in ("old", "new"):
            steps = _heads(steps.withColumn(f"{side}_at", F.col(f"{side}_at") + F.col("step")), members, side)
        turn = [F.col(f"{side}_next").isNull() | (F.col(f"{side}_path") < F.col(f"{side}_next")) for side in ("old", "new")]
        fresh = cut_lineage(steps.filter(turn[0] & turn[1]).select(*_TAKEN))
        taken = fresh if taken is None else taken.unionByName(fresh)
        for side in ("old", "new"):
            # A class is in one pair of a round at most.
            moved = fresh.groupBy(side).agg((F.max(f"{side}_at") + 1).alias("_at"))
            left = left.join(moved, side, "left").withColumn(f"{side}_at", F.coalesce("_at", f"{side}_at")).drop("_at")
            left = _heads(left, members, side)
        left = cut_lineage(left)
    return taken


def similar_renames(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs by their lines, from ``file_path, lines`` of either side."""
    members, lines = _classes(cut_lineage(_features(deleted, "old").unionByName(_features(added, "new"))))
    pairs = _candidates(cut_lineage(_looked_up(lines)))
    return best_pairs(_scored(pairs, lines), members).select("old_path", "new_path", "similarity")


def _left(listing: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    return listing.join(pairs.select(F.col(column).alias("file_path")), "file_path", "left_anti")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_path, new_path, similarity`` between two listings of ``file_path, content_hash`` and,
    for edited files, ``lines`` (without them only equal contents are found)."""
    usable = F.col("file_path").isNotNull() & F.col("content_hash").isNotNull()
    old, new = old.filter(usable), new.filter(usable)
    deleted = cut_lineage(old.join(new.select("file_path"), "file_path", "left_anti"))
    added = cut_lineage(new.join(old.select("file_path"), "file_path", "left_anti"))
    same = cut_lineage(exact_renames(deleted, added))
    if "lines" not in old.columns or "lines" not in new.columns:
        return same
    return same.unionByName(similar_renames(_left(deleted, same, "old_path"), _left(added, same, "new_path")))


def with_renames(feed: DataFrame, pairs: DataFrame, python_only: bool = True) -> DataFrame:
    """``file_path, change_type, old_path`` of a change feed in which a deleted and an added path of a pair are one
    row ``renamed`` under the new path.

    ``python_only`` keeps the Python files, and renames to or from one.
    """
    gone = feed.filter("change_type = 'deleted'").join(pairs.select(F.col("old_path").alias("file_path")), "file_path", "left_anti")
    come = feed.filter("change_type = 'added'").join(pairs.select(F.col("new_path").alias("file_path")), "file_path", "left_anti")
    rest = feed.filter("change_type NOT IN ('deleted', 'added')").unionByName(gone).unionByName(come)
    moved = pairs.select(F.col("new_path").alias("file_path"), F.lit("renamed").alias("change_type"), "old_path")
    found = rest.select("file_path", "change_type", F.lit(None).cast("string").alias("old_path")).unionByName(moved)
    return found.filter(_python("file_path") | F.coalesce(_python("old_path"), F.lit(False))) if python_only else found


def _python(column: str) -> Column:
    return F.col(column).endswith(".py")

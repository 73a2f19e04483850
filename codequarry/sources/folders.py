"""A tree of digests by folder, compared from the root, so that equal subtrees are never read.

A row of a tree is a file or a folder: level (parts of its path, the root has none), parent, path,
is_file, n_files, digest. A folder's digest is the sum of 48-bit hashes of the (path, digest) pairs of
all files below it: it needs no order, adds up within tasks, and repeated files don't cancel. Files
without a digest count with their path alone. Folders follow the slashes of the paths, empty parts
included.

A stored tree lies in folders by level and by a hash of the parent, so that the children of a few
folders are a few files. A comparison goes down level by level: of the folders that differ it reads
the children, of all others nothing. What is read grows with the changes, not with the corpus; the
folders that differ stay a table, and the driver sees their hash numbers only, PARTS at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.storage import stored, written

PARTS = 64  # hash folders of a level
SALTS = 8  # tasks that share the children of one folder when a tree is stored
TREE = "parent string, path string, is_file boolean, n_files bigint, digest string, level int, part int"
KEY = ["parent", "path", "is_file"]


def folder_tree(files: DataFrame) -> DataFrame:
    """level, parent, path, is_file, n_files, digest for rows of (path, content_md5); rows without a path take no part."""
    parts = F.split("path", "/")
    pair = F.md5(F.concat_ws("::", "path", "content_md5"))
    rows = files.filter(F.col("path").isNotNull()).select(
        parts.alias("parts"), F.conv(F.substring(pair, 1, 12), 16, 10).cast("decimal(38,0)").alias("digest")
    )
    head = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    level = F.explode(F.sequence(F.lit(0), F.size("parts")))
    above = rows.select("parts", "digest", level.alias("level")).select(
        "level", F.when(F.col("level") > 0, head(F.col("level") - 1)).alias("parent"), head(F.col("level")).alias("path"),
        (F.col("level") == F.size("parts")).alias("is_file"), "digest",
    )
    summed = above.groupBy("level", *KEY).agg(F.count("*").alias("n_files"), F.sum("digest").cast("string").alias("digest"))
    return summed


def store_tree(tree: DataFrame, root: str) -> None:
    """Write a tree to ``root``; the folder of a task that died is never taken for a tree."""
    dealt = tree.withColumn("part", _part("parent"))
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    (
        dealt.repartition("level", "part", salt).sortWithinPartitions("level", "part", "parent")
        .write.mode("overwrite").partitionBy("level", "part").parquet(f"{root}/rows")
    )
    tree.sparkSession.range(1).write.mode("overwrite").parquet(f"{root}/built")


def _part(column: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(""))), F.lit(PARTS)).cast("int")


def _stored_tree(spark: SparkSession, root: str) -> DataFrame:
    if stored(spark, f"{root}/built") is None:
        raise ValueError(f"no tree of digests at {root}")
    if stored(spark, f"{root}/rows") is None:  # no file at all
        return spark.createDataFrame([], TREE)
    return spark.read.schema(TREE).parquet(f"{root}/rows")


def compare_trees(spark: SparkSession, old: str, new: str) -> DataFrame:
    """level, path, is_file, change (added, removed, changed) of all that differs between two stored trees.

    Folders that exist on both sides and have the same digest and number of files are not entered.
    """
    trees = [_stored_tree(spark, root) for root in (old, new)]
    level, parts, frontier, found = 0, [_root_part(spark)], None, []
    while parts:
        was, now = (
            t.filter((F.col("level") == level) & F.col("part").isin(parts)).select(*KEY, F.struct("n_files", "digest").alias(name))
            for t, name in zip(trees, ("was", "now"))
        )
        if frontier is not None:
            # only children of the folders that differ; the others of the same part were read but are left out
            was, now = (side.join(frontier, "parent", "left_semi") for side in (was, now))
        both = was.withColumn("parent", F.coalesce("parent", F.lit(""))).join(now.withColumn("parent", F.coalesce("parent", F.lit(""))), KEY, "full")
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        differ = both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(
            F.lit(level).alias("level"), "path", "is_file", change.alias("change")
        )
        differ = written(differ, "differ")
        found.append(differ)
        frontier = differ.filter(~F.col("is_file")).select(F.col("path").alias("parent")).distinct()
        parts = [r[0] for r in frontier.select(_part("parent").alias("part")).distinct().collect()]
        level += 1
    every = found[0]
    for differ in found[1:]:
        every = every.unionByName(differ)
    return every


def _root_part(spark: SparkSession) -> int:
    return spark.range(1).select(F.lit(None).cast("string").alias("parent")).select(_part("parent")).first()[0]

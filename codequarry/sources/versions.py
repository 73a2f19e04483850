"""A stored index that follows its files: a full build, then deltas and tombstones, merged on read.

Below ``root``, one folder per version N:

* ``paths/version=N``: path, content_md5 of what changed; a null digest is a tombstone.
* ``rows/version=N``: what ``build`` made of the added and changed files, and ``since`` = N.
* ``log/version=N``: one row, written last. A version without it doesn't exist: a job that died
  half-way leaves folders that the next one overwrites, and two jobs can't both commit N.

A reader takes the rows of a base version and those of later ones, leaves out what later versions
say of the same paths, and so sees exactly the rows of a full build. ``compact`` writes that down as
a new base. Versions stay readable. ``build`` must work file by file: its rows carry ``path`` and
depend on that file alone. Paths are unique in a table of files. Cost of a change: one pass over
the digests, and a build of the changed files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.files import changed_files
from codequarry.sources.storage import stored

# Changed paths, as the log counts them, up to which they are broadcast; longer lists are shuffled.
BROADCAST_PATHS = 200_000
PATHS = "path string, content_md5 string"
LOG = "base int, upserts bigint, removals bigint, batch bigint"

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    number: int
    base: int  # the version from which a reader starts
    upserts: int
    removals: int
    batch: int | None  # the stream's batch that it came from

    @property
    def changes(self) -> int:
        return self.upserts + self.removals


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All committed versions in order, from a log of one row each."""
    log = stored(spark, f"{root}/log")
    rows = [] if log is None else log.orderBy("version").collect()
    return [Version(r.version, r.base, r.upserts, r.removals, r.batch) for r in rows]


def _visible(spark: SparkSession, root: str, number: int | None) -> list[Version]:
    """The base and the later versions that a reader of ``number`` (the last, if None) needs."""
    known = [v for v in versions(spark, root) if number is None or v.number <= number]
    if not known or number is not None and known[-1].number != number:
        raise ValueError(f"no version {number if number is not None else ''} of an index at {root}")
    return [v for v in known if v.number >= known[-1].base]


def _table(spark: SparkSession, root: str, kind: str, parts: list[Version]) -> DataFrame:
    """The folders of some versions, with their ``version``."""
    folders = [f"{root}/{kind}/version={v.number}" for v in parts]
    return spark.read.option("basePath", f"{root}/{kind}").parquet(*folders)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_PATHS else df


def _latest(spark: SparkSession, root: str, deltas: list[Version]) -> DataFrame:
    """path, content_md5, version: what the last of the deltas that names a path says."""
    said = _table(spark, root, "paths", deltas)
    if len(deltas) == 1:
        return said
    last = said.groupBy("path").agg(F.max(F.struct("version", "content_md5")).alias("last"))
    return last.select("path", "last.content_md5", "last.version")


def state(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """path, content_md5 of the files that a version covers."""
    base, *deltas = _visible(spark, root, number)
    first = _table(spark, root, "paths", [base]).select("path", "content_md5")
    if not deltas:
        return first
    size, latest = sum(v.changes for v in deltas), _latest(spark, root, deltas)
    kept = first.join(_sized(latest.select("path"), size), "path", "left_anti")
    return kept.unionByName(latest.filter("content_md5 IS NOT NULL").select("path", "content_md5"))


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of a version, as one full build would give them, and the version they were built in (``since``)."""
    base, *deltas = _visible(spark, root, number)
    first = _table(spark, root, "rows", [base]).drop("version")
    if not deltas:
        return first
    size, latest = sum(v.changes for v in deltas), _latest(spark, root, deltas)
    kept = first.join(_sized(latest.select("path"), size), "path", "left_anti")
    built = [v for v in deltas if v.upserts]
    if not built:
        return kept
    current = _sized(latest.select("path", "version"), size)
    return kept.unionByName(_table(spark, root, "rows", built).join(current, ["path", "version"], "left_semi").drop("version"))


def _commit(spark: SparkSession, root: str, number: int, base: int, upserts: int, removals: int, batch: int | None = None) -> int:
    row = spark.createDataFrame([(base, upserts, removals, batch)], LOG)
    row.coalesce(1).write.mode("error").parquet(f"{root}/log/version={number}")
    return number


def _with_digest(files: DataFrame) -> DataFrame:
    return files if "content_md5" in files.columns else files.withColumn("content_md5", F.md5("content"))


def _store(spark: SparkSession, root: str, number: int, changes: DataFrame, files: DataFrame, build: Build) -> tuple[int, int]:
    """Write changed paths and the rows of those that have contents; how many came and went."""
    changes.select("path", "content_md5").write.mode("overwrite").parquet(f"{root}/paths/version={number}")
    said = spark.read.schema(PATHS).parquet(f"{root}/paths/version={number}")
    counts = said.agg(F.count("content_md5").alias("upserts"), F.count("*").alias("all")).first()
    if counts.upserts or not number:
        wanted = said.filter("content_md5 IS NOT NULL").select("path")
        changed = files if not number else files.join(_sized(wanted, counts.upserts), "path", "left_semi")
        build(changed).withColumn("since", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/version={number}")
    return counts.upserts, counts.all - counts.upserts


def create(spark: SparkSession, root: str, files: DataFrame, build: Build) -> int:
    """Version 0: an index of all ``files`` (path, content and, if known, content_md5)."""
    return _commit(spark, root, 0, 0, *_store(spark, root, 0, _with_digest(files), files, build))


def _differences(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """path, content_md5 of added and changed files, and tombstones of those that are gone."""
    now = _with_digest(files).select("path", "content_md5")
    change = changed_files(state(spark, root), now)
    return change.join(now, "path", "left").select("path", F.when(F.col("change") != "removed", F.col("content_md5")).alias("content_md5"))


def apply_changes(spark: SparkSession, root: str, files: DataFrame, build: Build) -> int:
    """Bring the index to ``files``, all of them: the number of the version that covers them.

    Only added and changed files are built. Nothing changed: no new version. No index yet: version 0.
    """
    known = versions(spark, root)
    if not known:
        return create(spark, root, files, build)
    number = known[-1].number + 1
    upserts, removals = _store(spark, root, number, _differences(spark, root, files), files, build)
    if not upserts + removals:
        return known[-1].number
    return _commit(spark, root, number, known[-1].base, upserts, removals)


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, build: Build, batch_id: int) -> int:
    """Bring the files named in ``batch`` (path, content; null content: gone) up to date, once per ``batch_id``.

    Other files stay as they are. If a path comes several times, the greatest ``seq`` counts, if the
    batch has that column. A batch that was committed before, as after a restart, changes nothing.
    """
    known = versions(spark, root)
    if any(v.batch == batch_id for v in known):
        return next(v.number for v in known if v.batch == batch_id)
    if "seq" in batch.columns:
        last = batch.groupBy("path").agg(F.max_by(F.struct("content"), "seq").alias("last"))
        batch = last.select("path", "last.content")
    files = batch.withColumn("content_md5", F.md5("content"))
    number = known[-1].number + 1 if known else 0
    if known:
        before = state(spark, root).withColumnRenamed("content_md5", "was")
        said = files.select("path", "content_md5").join(before, "path", "left").filter("NOT content_md5 <=> was")
    else:
        said = files.filter("content IS NOT NULL")
        files = said
    upserts, removals = _store(spark, root, number, said, files, build)
    return _commit(spark, root, number, known[-1].base if known else 0, upserts, removals, batch_id)


def compact(spark: SparkSession, root: str) -> int:
    """Write the merged index as a new base, so that readers need no deltas; earlier versions stay."""
    number = versions(spark, root)[-1].number + 1
    state(spark, root).write.mode("overwrite").parquet(f"{root}/paths/version={number}")
    read(spark, root).write.mode("overwrite").parquet(f"{root}/rows/version={number}")
    return _commit(spark, root, number, number, 0, 0)

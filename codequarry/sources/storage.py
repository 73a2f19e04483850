"""Where intermediate tables go.

On a cluster that is the shared folder named by ``spark.checkpoint.dir``; without it nothing can be
written that all executors see, so the call fails. Only a session on one machine (``local[...]``)
falls back to a temporary folder. Folders carry a random name and stay until the job's owner clears
the shared folder: a table that was handed out may be read at any time. States of a loop that no
one else sees are deleted by it (``replaced``, ``forget``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow.fs as fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """A write inside deletes what it shuffled as soon as it ends; nothing reads that again. Otherwise
    it stays on the executors' disks until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut lineage that survives
    the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    with own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` gave. Only for tables that nothing reads any more: not handed out,
    and not the source of one that is held."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def replaced(old: DataFrame | None, df: DataFrame, purpose: str) -> DataFrame:
    """Write the next state of something, then delete the one before, so that steps don't add up on disk."""
    new = written(df, purpose)
    if old is not None:
        forget(old)
    return new


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a plain uri, and the path in it; any character may stand in a name."""
    return fs.FileSystem.from_uri(quote(uri, safe="/:@"))

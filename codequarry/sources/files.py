"""Source files as a table: scan, quarantine, fingerprint and the stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.storage import located, stored, written


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every file below ``root``, whatever its name or length.

    Each level of folders is listed by tasks; the driver holds no list.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = located(uri)
                found = system.get_file_info(fs.FileSelector(path))
                head = uri.removesuffix("/") + "/"
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([head + f.base_name for f in found], pa.string()),
                    "length": pa.array([f.size for f in found], pa.int64()),
                    "folder": pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                })

    level = spark.createDataFrame([(root if "://" in root or root.startswith("file:") else f"file://{root}",)], "path string")
    found = None
    while True:
        inside = written(level.repartition("path").mapInArrow(entries, "path string, length bigint, folder boolean"), "listing")
        files = inside.filter("NOT folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = inside.filter("folder").select("path")
        if level.isEmpty():
            return found


def read_raw(spark: SparkSession, path: str, suffix: str = "java") -> DataFrame:
    """Every ``*.suffix`` file below ``path`` as ``(path, bytes)``, hidden and empty ones too.

    A file beyond the 2 GB that a value can hold has null bytes.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = None
                if length < 1 << 31:
                    system, name = located(uri)
                    with system.open_input_stream(name) as f:
                        data = f.read()
                yield pa.RecordBatch.from_pydict({"path": pa.array([uri], pa.string()), "bytes": pa.array([data], pa.binary())})

    wanted = list_files(spark, path).filter(F.col("path").endswith(f".{suffix}"))
    return wanted.repartition("path").mapInArrow(contents, "path string, bytes binary")


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw bytes into readable files and a quarantine of undecodable ones."""
    ok = F.coalesce(F.is_valid_utf8(F.col("bytes").cast("string")), F.lit(False))
    good = raw.filter(ok).select(
        "path",
        F.col("bytes").cast("string").alias("content"),
        F.md5("bytes").alias("content_md5"),
    )
    bad = raw.filter(~ok).select("path", F.length("bytes").cast("bigint").alias("length"))
    return good, bad


def scan_files(spark: SparkSession, path: str, suffix: str = "java") -> DataFrame:
    """Readable files below ``path``: ``path, content, content_md5``."""
    return split_valid(read_raw(spark, path, suffix))[0]


def drop_empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.length("content") > 0)


def content_digest(files: DataFrame) -> DataFrame:
    return files.select("path", F.md5("content").alias("content_md5"))


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """One digest over all (path, content) pairs, whatever order they are read in.

    A sum of 48-bit hash prefixes: equal pairs add up rather than cancel, partial sums
    combine on the map side, and nothing is collected.
    """
    pair = F.md5(F.concat_ws("::", "path", F.md5("content")))
    part = F.conv(F.substring(pair, 1, 12), 16, 10).cast("decimal(38,0)")
    return files.select(part.alias("part")).agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("part").cast("string"), F.lit("0")).alias("digest"),
    )


def load_or_create(
    spark: SparkSession,
    files: DataFrame,
    root: str,
    build: Callable[[DataFrame], DataFrame],
    force_rebuild: bool = False,
    version: str = "1",
) -> DataFrame:
    """Read the index stored for exactly these files, or build and store it first.

    ``version`` names what ``build`` does; another version is another index. A folder counts as
    an index only once its marker table is there, so a job that died half-way is rebuilt.
    """
    mark = corpus_fingerprint(files).first()
    target = f"{root.rstrip('/')}/v={version}/fp={mark['n_files']}-{mark['digest']}"
    if force_rebuild or stored(spark, f"{target}/built") is None:
        build(files).write.mode("overwrite").parquet(f"{target}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{target}/built")
    return spark.read.parquet(f"{target}/rows")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an index must do to go from ``old`` to ``new``: ``path, change``.

    Compares digests only, never contents.
    """
    was = old.select("path", F.col("content_md5").alias("was"))
    now = new.select("path", F.col("content_md5").alias("now"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .otherwise("changed")
    )
    return (
        was.join(now, "path", "full")
        .filter(~F.col("was").eqNullSafe(F.col("now")))
        .select("path", change.alias("change"))
    )

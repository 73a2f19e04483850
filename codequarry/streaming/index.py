"""A stored index kept up to date by a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.sources import versions


def follow_files(spark: SparkSession, folder: str, root: str, build: versions.Build, state: str, schema: str = "path string, content string") -> None:
    """Apply all files that have arrived in ``folder`` (Parquet: path, content; null content: gone) to the index at ``root``.

    Every batch becomes one version. The stream's progress is in ``state``; a batch that runs again
    after a failure finds its number in the index's log and changes nothing. The digests by path that
    tell whether a file changed are the index's own, so no second copy of that state can disagree.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        versions.apply_batch(batch.sparkSession, root, batch, build, batch_id)

    arrived = spark.readStream.schema(schema).parquet(folder)
    arrived.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

"""Prompts to responses with a function the user supplies."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.plans.skew import hot_keys, salted_join
from codequarry.sources.storage import located, written

ANSWERS = pa.schema([("digest", pa.string()), ("response", pa.string())])


def _responses(fn: Callable[[list[str]], list[str]], texts: list[str]) -> list[tuple[str | None, str | None]]:
    """Response and error of each prompt. If ``fn`` fails on the batch, or answers another number
    of prompts, each one is sent again alone."""

    def answers(part: list[str]) -> list[str]:
        found = list(fn(part))
        if len(found) != len(part):
            raise ValueError(f"{len(found)} answers to {len(part)} prompts")
        return found

    def alone(text: str) -> tuple[str | None, str | None]:
        try:
            return answers([text])[0], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    try:
        return [(r, None) for r in answers(texts)]
    except Exception:
        return [alone(t) for t in texts]


def generate(prompts: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """``query_id, response, error``.

    ``fn`` answers a batch of prompts. If it fails on a batch, or answers another number of
    prompts, each prompt of the batch is sent again alone, so that one bad prompt costs one
    response; its error is kept and the job goes on.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = _responses(fn, batch["prompt"].tolist())
            yield pd.DataFrame(
                {
                    "query_id": batch["query_id"],
                    "response": [r for r, _ in pairs],
                    "error": [e for _, e in pairs],
                }
            )

    id_type = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(
        answer, f"query_id {id_type}, response string, error string"
    )


def _asking(fn: Callable[[list[str]], list[str]], folder: str, batch: int):
    """A task that keeps its answers: each batch is a file in the folder of its partition before
    the next one is asked, and a later attempt of the task begins by reading them."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        system, path = located(f"{folder}/{context.partitionId() if context else 0}")
        system.create_dir(path, recursive=True)
        kept = {}
        for file in system.get_file_info(fs.FileSelector(path)):
            if file.path.endswith(".parquet"):
                with system.open_input_file(file.path) as source:
                    kept.update(zip(*pq.read_table(source).to_pydict().values()))
        for frame in frames:
            for begin in range(0, len(frame), batch):
                part = frame.iloc[begin:begin + batch]
                new = part[~part["digest"].isin(kept.keys())]
                pairs = dict(zip(new["digest"], _responses(fn, new["prompt"].tolist()))) if len(new) else {}
                good = [(d, r) for d, (r, e) in pairs.items() if e is None]
                if good:
                    name = uuid.uuid4().hex
                    with system.open_output_stream(f"{path}/_{name}") as sink:
                        pq.write_table(pa.table(list(map(list, zip(*good))), schema=ANSWERS), sink)
                    system.move(f"{path}/_{name}", f"{path}/{name}.parquet")
                found = [pairs.get(d) or (kept.get(d), None) for d in part["digest"]]
                yield pd.DataFrame({
                    "digest": part["digest"].to_numpy(), "response": [r for r, _ in found], "error": [e for _, e in found]
                })

    return ask


def answer_once(
    prompts: DataFrame, fn: Callable[[list[str]], list[str]], store: str, batch: int = 256, tasks: int | None = None
) -> DataFrame:
    """``query_id, response, error, reused``: like ``generate``, but no prompt is asked twice.

    ``store`` is a folder that all executors share; it holds the responses by the prompts' SHA-256.
    Prompts found there are ``reused``; of the others each different one is asked once, ``batch`` at a
    time. An answered batch is stored at once, so neither a retried task nor a call after a failed
    one asks for it again; only the batch at hand when a task dies is. Two attempts of one task
    that run at the same time both ask, so leave speculation off. Errors are returned, not stored, and asked
    again by the next call. A null prompt has no response and no error.
    """
    spark = prompts.sparkSession
    keyed = prompts.select("query_id", "prompt", F.sha2("prompt", 256).alias("digest"))
    system, path = located(store)
    system.create_dir(path, recursive=True)
    known = (
        spark.read.schema("digest string, response string").option("recursiveFileLookup", True).parquet(store)
        .groupBy("digest").agg(F.min("response").alias("response"))
    )
    known = written(known.select("digest", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("reused")), "known-answers")
    wanted = keyed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("prompt").alias("prompt"))
    # An explicit count, so that a partition is the same one in every attempt.
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing = wanted.join(known, "digest", "left_anti").repartition(tasks, "digest")
    asked = missing.mapInPandas(_asking(fn, f"{store}/{uuid.uuid4().hex}", batch), "digest string, response string, error string")
    asked = written(asked.withColumn("reused", F.lit(False)), "new-answers")
    answers = known.unionByName(asked)
    found = salted_join(keyed.drop("prompt"), answers, "digest", ["query_id"], hot_keys(keyed, "digest"), "left")
    return found.select("query_id", "response", "error", F.coalesce("reused", F.lit(False)).alias("reused"))

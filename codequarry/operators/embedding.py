"""Texts to vectors and pooled vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import token_windows, word_array
from codequarry.plans.placement import place


def word_bucket(term: Column, dim: int) -> Column:
    """Bucket of a word: 32 bits of its md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def embed(texts: DataFrame, dim: int = 256, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, embedding`` of ``id, text``.

    ``model`` is a Pandas UDF over the text column (the iterator form loads a model once
    per task). Without one, words are hashed into ``dim`` counts and scaled to unit length;
    a text without words gets the zero vector.
    """
    if model is not None:
        return texts.select("id", model(F.col("text")).alias("embedding"))
    return place(texts.select("id", "text"), "id").groupBy("id").agg(_counted(F.collect_list("text"), dim).alias("embedding"))


def _counted(texts: Column, dim: int) -> Column:
    """The unit vector of word counts of a list of texts read as one."""

    @F.arrow_udf("array<double>")
    def scaled(buckets: pa.Array) -> pa.Array:
        n, lengths = len(buckets), buckets.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
        cells = np.repeat(np.arange(n), lengths) * dim + buckets.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(cells, minlength=n * dim).astype("float64").reshape(n, dim)
        norm = np.sqrt((counts * counts).sum(axis=1))
        vectors = counts / np.where(norm > 0, norm, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(vectors.reshape(-1)))

    words = F.flatten(F.transform(F.array_compact(texts), lambda t: word_array(t)))
    return scaled(F.transform(words, lambda w: word_bucket(w, dim)))


def embed_rows(rows: DataFrame, keys: Sequence[str], text: str, dim: int = 256) -> DataFrame:
    """The rows with the ``embedding`` of their ``text``; the texts of rows of one key are read as one.

    Rows placed by some of the keys stay where they are.
    """
    rest = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("held"))
    vectors = held.withColumn("embedding", _counted(F.col(f"held.{text}"), dim))
    return vectors.select(*keys, "embedding", F.inline("held")).select(*rows.columns, "embedding")


def mean_pool(vectors: DataFrame) -> DataFrame:
    """``id, embedding``: the mean vector per id.

    Whole vectors are added up in each task before the shuffle, so an id with very many
    vectors is no burden and no vector is taken apart into rows.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    pooled = vectors.filter(F.col("embedding").isNotNull()).groupBy("id").agg(Summarizer.mean(array_to_vector(doubles)).alias("mean"))
    return pooled.select("id", vector_to_array("mean").alias("embedding"))


def embed_windows(windows: DataFrame, dim: int = 256, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, embedding``: the mean over the windows ``id, part, text`` of each text, however they were cut."""
    vectors = embed(windows.select(F.struct("id", "part").alias("id"), "text"), dim, model)
    return mean_pool(vectors.select(F.col("id.id").alias("id"), "embedding"))


def embed_long(texts: DataFrame, window: int = 512, dim: int = 256) -> DataFrame:
    """Whole texts through an encoder that reads ``window`` words at a time, mean-pooled."""
    parts = texts.select("id", F.posexplode(token_windows(F.col("text"), window)).alias("part", "text"))
    return embed_windows(parts, dim)

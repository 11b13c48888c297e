"""Text to vectors: the default hashed embedding, user models, and the incremental job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import l2_normalize
from ..functions.text import dealt_texts, explode_tokens

DIMS = 64
BATCH = 100

Embedder = Callable[[list[str]], "np.ndarray"]


def bucket(term: Column, dims: int) -> Column:
    """First 32 bits of the term's MD5, modulo ``dims``."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dims


def hashed_weights(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """Long form (id, bucket, n): how many tokens of the text fall into each bucket.

    A text without tokens has one row with a null bucket.

    The tokens of a text are counted where the text is dealt to, so only the texts are shuffled, in tasks
    that do not grow with the table.
    """
    return (
        explode_tokens(dealt_texts(texts.select("id", "text"), "id", "text"), "text", "id", keep_empty=True)
        .select("id", bucket(F.col("term"), dims).alias("bucket"))
        .groupBy("id", "bucket")
        .agg(F.count("bucket").alias("n"))
    )


def hashed_embedding(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """(id, embedding) at unit length; a text without tokens gets a zero vector."""
    entry = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n"))
    packed = (
        hashed_weights(texts, dims)
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("n_of"))
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
        lambda i: F.coalesce(F.col("n_of")[i], F.lit(0)).cast("double"),
    )
    return packed.select("id", l2_normalize(dense).alias("embedding"))


def embed_with(texts: DataFrame, embedder: Embedder, dims: int, batch: int = BATCH) -> DataFrame:
    """(id, embedding) from a user model called with ``batch`` texts at a time, normalised.

    The model's output size is checked; a zero vector stays zero.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                out = np.asarray(embedder(part["text"].tolist()), dtype=np.float64)
                if out.shape != (len(part), dims):
                    raise ValueError(f"embedder returned {out.shape}, expected {(len(part), dims)}")
                norms = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, norms, out=out.copy(), where=norms > 0)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(out)})

    return texts.select("id", "text").mapInPandas(run, f"id {id_type}, embedding array<double>")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def pending(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts whose (id, content) is not in ``stored`` (id, content_hash): new or changed."""
    hashed = texts.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.join(stored.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def latest_vectors(stored: DataFrame) -> DataFrame:
    """The newest vector per id of an append-only vector table (column ``written_at``)."""
    return (
        stored.groupBy("id")
        .agg(F.max_by(F.struct("content_hash", "embedding"), "written_at").alias("_row"))
        .select("id", "_row.*")
    )


def update_vectors(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> int:
    """Embed what is missing in the vector table at ``path`` and append it; returns the row count.

    A rerun after a failure embeds only what the failed run did not append.  Nothing pending means
    nothing is written.
    """
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType.simpleString()
    columns = f"id {id_type}, content_hash string, embedding array<double>, written_at timestamp"
    empty = spark.createDataFrame([], columns)
    empty.write.mode("append").parquet(path)
    stored = spark.read.schema(columns).parquet(path)
    current = stored.groupBy("id").agg(
        F.max_by("content_hash", "written_at").alias("content_hash")
    )
    todo = pending(texts, current)
    if todo.isEmpty():
        return 0
    vectors = embed(todo.select("id", "text"))
    before = stored.count()
    (
        todo.select("id", "content_hash")
        .join(vectors, "id")
        .select("id", "content_hash", "embedding", F.current_timestamp().alias("written_at"))
        .write.mode("append")
        .parquet(path)
    )
    return spark.read.schema(columns).parquet(path).count() - before

"""Users' own functions as columns: encoders, token counters and rerankers, in batches, with the checks that their results must pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(text: Column, encode: Callable[[list[str]], list[list[float]]], dim: int) -> Column:
    """array<double> of each text by ``encode``, which gets a batch of texts; null for null texts.

    An error unless there is a vector for each text, of ``dim`` finite numbers.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.drop_null().to_pylist()
            made = np.asarray(encode(texts), np.float64).reshape(len(texts), -1) if texts else np.empty((0, dim))
            if made.shape != (len(texts), dim) or not np.isfinite(made).all():
                raise ValueError(f"the encoder must give {dim} finite numbers for each text")
            rows = iter(made.tolist())
            yield pa.array([next(rows) if v.is_valid else None for v in batch], pa.list_(pa.float64()))

    return run(text)


def counted(text: Column, count: Callable[[str], int]) -> Column:
    """Units of each text by ``count``; null for null texts.  An error unless they are whole and not negative."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            units = [count(v.as_py()) if v.is_valid else None for v in batch]
            if any(u is not None and (type(u) is not int or u < 0) for u in units):
                raise ValueError("the counter must give whole numbers, none negative")
            yield pa.array(units, pa.int64())

    return run(text)


def reranked(query: Column, text: Column, score: Column, rerank: Callable[[str, str, float], float]) -> Column:
    """A new score of each (query, text, score) by ``rerank``.  An error unless it is from 0 to 1."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts in batches:
            scores = [float(rerank(*row)) for row in zip(*(p.to_pylist() for p in parts), strict=True)]
            if not all(0 <= s <= 1 for s in scores):
                raise ValueError("the reranker must give scores from 0 to 1")
            yield pa.array(scores, pa.float64())

    return run(query, text, score)


def rerank_ambiguous(rows, rerank: Callable[[str, str, float], float], gap: float = 0.1):
    """``rows`` (query_id, query, text, score, ...) with the scores of ambiguous lists made by ``rerank``, and ``reranked``.

    A list is ambiguous if its second score is within ``gap`` of its first.
    """
    best = rows.groupBy("query_id").agg(F.max("score").alias("__one"), F.count("*").alias("__n"))
    over = rows.join(best, "query_id")
    # the second best: the first itself where it is there twice
    second = over.groupBy("query_id").agg(F.max(F.when(F.col("score") < F.col("__one"), F.col("score"))).alias("__two"), F.count_if(F.col("score") == F.col("__one")).alias("__same"))
    judged = over.join(second, "query_id").withColumn("reranked", (F.col("__n") > 1) & ((F.col("__same") > 1) | (F.col("__one") - F.col("__two") <= gap)))
    judged = judged.drop("__one", "__n", "__two", "__same")
    again = judged.where("reranked").withColumn("score", reranked(F.col("query"), F.col("text"), F.col("score"), rerank))
    return judged.where("not reranked").unionByName(again.select(*judged.columns))

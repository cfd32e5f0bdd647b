"""The residual index: exact results, and whole blocks ruled out on clustered vectors."""

import numpy as np
from evidencelake.operators import residual
from pyspark.sql import functions as F


def table(spark, x):
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("short", [1.0]), ("nan", [float("nan")] * x.shape[1])]
    return spark.createDataFrame(rows + odd, "vec_id string, v array<double>").repartition(4)


def check(spark, x, k, every, **options):
    items = table(spark, x)
    index = residual.build(items, **options)
    queries = items.where(F.expr("coalesce(try_cast(substring(vec_id, 2, 9) as int), 1)") % every == 0).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in residual.search(queries, index, items, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    for i in range(0, len(x), every):
        best = sorted((-round(float(x[i] @ x[j]), 9), f"v{j:04d}") for j in range(len(x)) if j != i)[:k]
        assert got[f"v{i:04d}"] == [(n, -s) for s, n in best]
    asks, pairs = residual.meetings(queries, index, k)
    return pairs.count() / (asks.count() * index.blocks.count()), index


def test_clustered_vectors_skip_blocks(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(30, 24))
    x = np.repeat(middles, 40, axis=0) + 0.1 * rng.normal(size=(1200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    share, index = check(spark, x, 5, 40, size=40)
    assert share < 0.5 and index.blocks.agg(F.sum("n")).first()[0] == 1200
    assert index.blocks.agg(F.max("n")).first()[0] < 120


def test_unclustered_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(150, 6)) * rng.uniform(0.1, 5, size=(150, 1)), np.ones((80, 6)), np.zeros((5, 6))])
    check(spark, x, 7, 15, size=25)
    check(spark, x[:4], 7, 2, size=25)


def test_no_rows(spark):
    items = table(spark, np.ones((3, 2)))
    none = items.limit(0)
    assert residual.search(none.withColumnRenamed("vec_id", "query_id"), residual.build(items), items, 3).count() == 0
    assert residual.search(items.withColumnRenamed("vec_id", "query_id"), residual.build(none), none, 3).count() == 0

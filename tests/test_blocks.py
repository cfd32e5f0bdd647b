"""Block searches with eligibility, ids of any type and odd vectors."""

import numpy as np
import pytest
from evidencelake.operators import blocks, retrieval
from pyspark.sql import functions as F


def table(spark, n=90, dim=6):
    x = np.random.default_rng(1).normal(size=(n, dim))
    rows = [(f"d/{i:02d}.md", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("short", [1.0]), ("nan", [float("nan")] * dim), ("hole", [None] * dim), ("inf", [float("inf")] * dim)]
    return x, spark.createDataFrame(rows + odd, "vec_id string, v array<double>")


def wanted(x, names, may, k=4):
    out = {}
    for i in range(0, len(x), 9):
        scored = sorted((-round(float(x[i] @ x[j]), 9), names[j]) for j in range(len(x)) if j != i and may(i, j))[:k]
        if scored:
            out[names[i]] = [n for _, n in scored]
    return out


@pytest.mark.parametrize("which", ["every", "rows", "lists", "none"])
def test_dense_search(spark, which):
    x, rows = table(spark)
    names = [f"d/{i:02d}.md" for i in range(len(x))]
    queries = rows.where(F.col("vec_id").isin([names[i] for i in range(0, 90, 9)] + ["null", "short"])).withColumnRenamed("vec_id", "query_id")
    may = {"every": lambda i, j: True, "rows": lambda i, j: j % 3 == 0, "lists": lambda i, j: (i + j) % 7 == 0 and i != 9, "none": lambda i, j: False}[which]
    pairs = [(names[i], names[j]) for i in range(0, 90, 9) for j in range(90) if may(i, j)]
    if which == "every":
        eligible = blocks.EVERY
    elif which == "rows":
        eligible = spark.createDataFrame([(names[j],) for j in range(0, 90, 3)] * 2, "vec_id string")
    else:
        eligible = spark.createDataFrame(pairs * 2 + [("stranger", "d/00.md")], "query_id string, vec_id string")
    got = {}
    for r in retrieval.dense_topk(queries, rows, 4, eligible=eligible, block=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == wanted(x, names, may)


def test_eligibility_must_be_said(spark):
    _, rows = table(spark)
    with pytest.raises(ValueError):
        retrieval.dense_topk(rows.withColumnRenamed("vec_id", "query_id"), rows, 4, eligible=None)
